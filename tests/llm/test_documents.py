"""Operators on documents against brute force, on a fixture of hard cases, and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from orbweave.llm import attention, chunked_bpe, lm_score, merkle, minhash, packing, recompress, toxicity
from orbweave.llm.subwords import byte_bpe, default_tokenizer
from orbweave.llm.textscan import scan_words

from .conftest import prose


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_near_duplicates_equal_brute_force(docs):
    got = {}
    for r in minhash.near_duplicates(docs, k=4).collect():
        got.setdefault(r.doc_id, (r.n_shingles, r.component_id, r.kept))
    sets = {}
    for i, t in rows_of(docs):
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in parent:
        for b in parent:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for i in parent:
        assert got[i] == (len(sets[i]), root(i), root(i) == i), i
    assert got[None] == (len(sets[None]), None, False)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_families_equal_brute_force(spark):
    """Near copies of a base, of a far variant of it, and of its parts: groups beyond what is compared as it is."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base = [words[i] for i in rng.integers(0, 3000, 120)]
    variant = [words[j] if rng.random() < 0.09 else w for w, j in zip(base, rng.integers(0, 3000, 120), strict=True)]
    rows = []
    for i in range(420):
        text = list((base, variant, base, base)[i % 4])
        for at in rng.integers(0, len(text), rng.integers(0, 7)):
            text[at] = words[rng.integers(0, 12)]  # few words, so that edits recur
        if i % 4 == 2:
            cut = int(rng.integers(0, 40))
            text = text[cut : len(text) - int(rng.integers(0, 30))]
        rows.append((i * 3 + 1, " ".join(text)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 100 * len(a & b) >= 80 * len(a | b) and root(i) != root(j):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in sets}
    assert len(set(got.values())) > 3


def test_repeats_equal_brute_force(docs):
    words = [(i, t.encode().split()) for i, t in rows_of(docs)]
    first = {}
    for i, w in sorted(((i, w) for i, w in words if i is not None)):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    expected = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        expected[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompress.drop_repeats(docs).collect())
    assert got == expected
    assert recompress.drop_repeats(docs.limit(0)).count() == 0


def test_equal_windows_share_supported_symbols():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 5, 400).astype(np.uint64)
    other = np.concatenate([rng.integers(0, 5, 37).astype(np.uint64), words[100:220], rng.integers(0, 5, 50).astype(np.uint64)])
    a, b = (recompress.parse(w, np.array([0, len(w)])) for w in (words, other))
    inside = lambda p, lo, hi, shift: {(s, l - shift, h - shift) for s, l, h in zip(*(x.tolist() for x in p)) if l >= lo and h <= hi}
    assert inside(a, 100, 220, 100) == inside(b, 37, 157, 37) != set()


def test_encoding_equals_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    expected = Counter()
    for i, t in rows_of(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in chunked_bpe.encode_documents(docs).collect())
    assert got == expected
    assert chunked_bpe.encode_documents(docs.limit(0)).count() == 0


def test_joins_are_repaired(monkeypatch):
    monkeypatch.setattr(chunked_bpe, "MOST_BYTES", 24)
    bpe = byte_bpe(default_tokenizer())
    for text in ("don't stop" * 40, "漢字かな交じり文" * 30, "a b c " * 50 + "word" * 60 + " end of it", "x  \n y" * 40):
        assert chunked_bpe.ChunkEncoder(bpe).encode(text.encode()).tolist() == bpe.encode(text).tolist()


def test_packing_is_whole_and_tight(docs):
    got = packing.pack_documents(docs, 256).collect()
    bpe = byte_bpe(default_tokenizer())
    pieces = Counter()
    for i, t in rows_of(docs):
        ids = np.append(bpe.encode(t), np.uint32(2)).astype("<u4")
        at, piece = 0, 0
        while at < len(ids):
            end = at + (len(ids) % 256 or 256) if piece == 0 else at + 256
            pieces[i, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())] += 1
            at, piece = end, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.05 * sum(r.length for r in got) / 256 + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_plan_near_the_bound():
    rng = np.random.default_rng(5)
    lengths = Counter(rng.integers(1, 1025, 20000).tolist())
    plan = packing.pack_histogram(lengths, 1024)
    held = Counter()
    for content, times in plan:
        assert sum(x * n for x, n in content) <= 1024
        for x, n in content:
            held[x] += n * times
    assert held == lengths
    assert sum(t for _, t in plan) <= 1.02 * sum(x * n for x, n in lengths.items()) / 1024 + 1


HISTOGRAMS = {
    "300..700": {x: 50 for x in range(300, 701)}, "uniform": {x: 20 for x in range(1, 1025)},
    "two": {400: 1000, 300: 777}, "thirds": {x: 33 for x in range(250, 400)}, "one": {17: 5}, "lognormal": dict(Counter(np.clip(np.random.default_rng(1).lognormal(5.5, 0.8, 9000).astype(int), 1, 1023).tolist())),
}


@pytest.mark.parametrize("name", [*HISTOGRAMS, "sf0.01"])
def test_program_carries_the_packing(spark, name):
    """Every piece once, never more sequences than best-fit, most of them from the program, none below its bound."""
    if name in HISTOGRAMS:
        histogram = HISTOGRAMS[name]
    else:
        pieces = packing.cut_documents(spark.read.parquet(f"/root/testdata/{name}/documents.parquet"))
        histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect() if r[0] < 1024}
    made, rest, bound = packing.program(dict(histogram), 1024)
    held, total = Counter(), 0
    for content, times in made + rest:
        assert times > 0 and sum(x * n for x, n in content) <= 1024
        total += times
        for x, n in content:
            held[x] += n * times
    assert held == histogram
    alone = sum(n for _, n in packing.best_fit(dict(histogram), 1024))
    assert bound - 1e-6 <= total <= alone
    assert sum(n for _, n in made) > 0.5 * total
    if name in ("two", "thirds"):  # where best-fit pairs badly
        assert total < 0.97 * alone


def test_fingerprints(docs):
    got = sorted(merkle.fingerprint_pairs(docs).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    order = sorted(rows_of(docs), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    expected = Counter()

    def dice(a, b):
        """Common clauses of two texts, without any tree."""
        x, y = (Counter(zlib.crc32(c.encode()) for line in t.splitlines(keepends=True) for c in re.findall(r"[^.!?]{1,40}[.!?]*\s*|[.!?]+\s*", line)) for t in (a, b))
        return 1.0 if a == b else 2 * (x & y).total() / max(1, x.total() + y.total())

    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = merkle.edited_by(t, following)
        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(edited), dice(t, edited), dice(t, following)] += 1
    assert Counter(tuple(r) for r in got) == expected
    a = "\n".join(f"Paragraph number {i} is here." for i in range(40))
    assert merkle.differing_paragraphs(merkle.fingerprint(a), merkle.fingerprint(a.replace("number 7 ", "number seven "))) == [7]
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1 and merkle.likeness(merkle.fingerprint("a"), merkle.fingerprint("")) == 0
    assert merkle.fingerprint_pairs(docs.limit(0)).count() == 0


def test_likeness_descends_only_into_differing_branches():
    lines = [f"Line {i} of the text. It goes on, and ends here.\n" for i in range(60)]
    a, b = merkle.fingerprint("".join(lines)), merkle.fingerprint("".join([*lines[:50], "Other words.\n", *lines[51:]]))
    before = merkle.likeness(a, b)
    assert 0.9 < before < 1
    head, first, rest = b[:33], merkle.sections(b)[0], b[33 + len(merkle.sections(b)[0]) :]
    assert first == merkle.sections(a)[0]
    # Leaves under an equal section are not looked at: spoiling them changes nothing.
    spoilt = first[: -merkle.CLAUSE] + "0" * merkle.CLAUSE
    assert merkle.likeness(a, head + spoilt + rest) == before
    # With another node the section differs, and its leaves count; a spoilt one among them is missed.
    node = "0" * merkle.NODE
    paragraph_nodes_too = node + "=" + ",".join(node + p[merkle.NODE :] for p in merkle.paragraphs(spoilt))
    assert merkle.likeness(a, head + node + first[merkle.NODE :] + rest) == before
    assert merkle.likeness(a, head + paragraph_nodes_too + rest) < before


def test_base_scores_equal_brute_force(docs):
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_score.score_documents(docs).collect())
    tokens = [(i, [*t.encode().lower().split(), None]) for i, t in rows_of(docs)]
    c = Counter(w for i, ws in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = c.total(), len(c)
    expected = Counter()
    for i, ws in tokens:
        out = i is None or zlib.crc32(str(i).encode()) % 7 == 2
        expected[i, out, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws), 6)] += 1
    assert got == expected
    assert lm_score.score_documents(docs.limit(0)).count() == 0


def small_net(ids=9):
    """A model of few ids whose classes are ids, and a laid-out text with other texts around it."""
    classes = np.arange(ids) % attention.CLASSES
    w = attention.first_weights(ids, np.bincount(classes, minlength=attention.CLASSES) + 1.0)
    sizes = [3, 0, 45, 1, 32]
    tokens = np.array([(i * i + 3 * i) % ids for i in range(sum(sizes))])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return w, tokens, bounds, classes


def test_attention_scores_sum_to_one_and_gradients_hold():
    w, tokens, bounds, classes = small_net()
    inputs, targets, _ = attention.layout(tokens, bounds, classes, 9)
    assert (targets >= 0).sum() == len(tokens)
    _, e, total, _ = attention.forward(w, inputs)
    assert np.allclose(e.sum(-1), total, rtol=1e-5)
    loss = lambda w: -attention.score(w, inputs, targets).sum(dtype=np.float64) / len(tokens)
    g, ids, rows = attention.gradients(w, inputs, targets)
    slopes = {n: x for n, x in g.items()} | {"embed": np.zeros_like(w["embed"])}
    slopes["embed"][ids] = rows
    for name, at in (("out", (2, 5)), ("out", (12, 3)), ("qkv", (5, 3)), ("qkv", (2, 11)), ("qkv", (7, 20)), ("query_at", (4, 2)), ("key_at", (17, 3)), ("embed", (3, 5)), ("embed", (9, 1))):
        up, down = ({n: x.copy() for n, x in w.items()} for _ in range(2))
        up[name][at] += 0.02
        down[name][at] -= 0.02
        assert slopes[name][at] == pytest.approx((loss(up) - loss(down)) / 0.04, abs=2e-3), (name, at)


def test_windows_score_each_token_once_as_one_by_one():
    w, tokens, bounds, classes = small_net()
    inputs, targets, at = attention.layout(tokens, bounds, classes, 9)
    got = attention.score(w, inputs, targets)[at]
    c, width = attention.CONTEXT, attention.WIDTH
    for a, b in zip(bounds[:-1], bounds[1:]):
        before = [9, *tokens[a : b - 1]]  # the start mark, then the token before
        for j in range(b - a):
            low = max(0, j - j % c - c)
            seen = w["embed"][before[low : j + 1]] @ w["qkv"]
            place = np.arange(low, j + 1) - (j - j % c - c)
            q = seen[-1, :width] + w["query_at"][j % c]
            s = (seen[:, width : 2 * width] + w["key_at"][place]) @ q / width**0.5
            p = np.exp(s - s.max())
            z = np.concatenate((p / p.sum() @ seen[:, 2 * width :], w["embed"][before[j]], [1]))
            logits = z @ w["out"]
            assert got[a + j] == pytest.approx(logits[classes[tokens[a + j]]] - np.log(np.exp(logits).sum()), abs=1e-4)


def test_held_out_scores_beat_the_model_without_attention(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1)
    bpe = byte_bpe(default_tokenizer())
    packs = lm_score.write_packs(df, lm_score.PACK_BYTES).select("pack", "ids", "lengths", "blob")
    tokens = packs.mapInArrow(lm_score._cut(default_tokenizer(), 2), lm_score.CUT)
    counts = np.zeros(bpe.size, np.int64)
    for r in tokens.mapInArrow(lm_score._count_subwords(bpe.size), "id long, n long").collect():
        counts[r[0]] += r[1]
    classes = lm_score.classes_of(counts, 2)
    w = lm_score.train(tokens, classes, counts)
    without = {n: x.copy() for n, x in w.items()}
    without["out"][: attention.WIDTH] = 0
    sums = {True: 0.0, False: 0.0}
    for _, ids, toks, bounds in lm_score._read(iter(tokens.toArrow().to_batches())):
        out = np.repeat([not lm_score.is_training(i) for i in ids], np.diff(bounds))
        inputs, targets, at = attention.layout(toks.astype(np.int64), bounds, classes, bpe.size)
        for whole, weights in ((True, w), (False, without)):
            sums[whole] += attention.score(weights, inputs, targets)[at][out].sum()
    first = attention.first_weights(bpe.size, np.bincount(classes, counts, attention.CLASSES))
    assert sums[True] > 0.99 * sums[False] and not np.array_equal(first["embed"], w["embed"])


def test_restoration_and_scores(spark):
    words = {w: 50 for w in "the idiot moron loser garden window is a good day and".split()}
    grams = toxicity.gram_model(words)
    kept = {}
    assert toxicity.restore_word("1d10t", grams, kept) == "idiot"
    assert toxicity.restore_word("m-o-r-o-n", grams, kept) == "moron"
    assert toxicity.restore_word("looooser!!", grams, kept) == "loser"
    assert "idiot" in toxicity.restored_words("you i d i o t there", grams, kept)
    clean = [(i, f"the garden and window number{i} is good a day {i}") for i in range(300)]
    bad = [(1000 + i, f"what{i} a loser and idiot is here day {i}") for i in range(150)]
    docs = spark.createDataFrame([*clean, *bad, (5000, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, 0) for i, _ in clean), *((i, 1) for i, _ in bad), (7777, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model, restored=True).collect()
    held = [r for r in rows if r.held_out and r.doc_id and r.doc_id < 5000]
    assert len(held) > 80 and all(r.predicted == (r.doc_id >= 1000) for r in held)
    assert len(rows) == 452 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in toxicity.keep_harmless(docs, model).collect()} == {i for i, _ in clean} | {5000, None}
    assert {r.score < 0.01 for r in toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {True}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    source = spark.read.parquet(f"{sf}/documents.parquet")
    left = source
    for _, stage in corpus_pipeline.STAGES[:1]:
        left = stage(spark, left, sf)
    toxic = source.join(spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1"), "doc_id").count()
    assert source.count() - toxic - 10 <= left.count() <= source.count()
    assert out.select("doc_id").distinct().count() == minhash.near_duplicates(left, 5).filter("kept").count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").isEmpty()


def test_every_training_document_reaches_the_trainer(docs):
    path = default_tokenizer()
    bpe = byte_bpe(path)
    tokens = lm_score.write_packs(docs, 20_000).select("pack", "ids", "lengths", "blob").mapInArrow(lm_score._cut(path, 2), lm_score.CUT)
    batches = tokens.toArrow().to_batches()
    w = attention.first_weights(bpe.size, np.ones(attention.CLASSES))
    seen, place = 0, sum(int(np.prod(s)) for s in attention.SMALL.values())
    for turn in range(lm_score.ROUNDS):
        for b in lm_score._trainer(w, np.zeros(bpe.size, np.int64), turn)(iter(batches)):
            seen += int(np.concatenate([np.frombuffer(x, np.float32) for x in b.column("sums").to_pylist()])[place])
    sizes = [sum(len(bpe.plain(" " + w.decode())) for w in t.encode().lower().split()) + 1 for i, t in rows_of(docs) if lm_score.is_training(i)]
    assert seen == sum(sizes)


def test_base_probabilities_sum_to_one(docs):
    got = Counter((r.doc_id, round(r.base_score, 6)) for r in lm_score.score_documents(docs).collect())
    tokens = [(i, [*t.encode().lower().split(), None]) for i, t in rows_of(docs)]
    c = Counter(w for i, ws in tokens if lm_score.is_training(i) for w in ws)
    p = {w: (c[w] + 1) / (c.total() + len(c) + 1) for w in [*c, "unseen"]}
    assert sum(p.values()) == pytest.approx(1)
    assert got == Counter((i, round(sum(math.log10(p.get(w, p["unseen"])) for w in ws), 6)) for i, ws in tokens)


def test_restoration_of_long_spaced_doubled_and_edge_signs():
    grams = toxicity.gram_model({w: 50 for w in "you the idiot moron loser garden window letter is a good day and".split()})
    kept = {}
    assert toxicity.restore_word("l" + "o" * 60 + "ser", grams, kept) == "loser"
    assert {"you", "moron", "idiot"} <= toxicity.restored_words(" ".join("youmoronidiotmoronidiot"), grams, kept)
    assert toxicity.restored_text("x " + " ".join("idiotmoron"), grams, kept).endswith("idiot moron")
    assert [toxicity.restore_word(w, grams, kept) for w in ("iiddiioott", "letter", "!diot", "!!diot", "garden!", '("garden"')] == ["idiot", "letter", "idiot", "idiot", "garden", "garden"]


def test_labels_of_texts_with_one_opening_all_count(spark):
    head = "This text was published under a license that all pages of the site share. "
    rows = [(i, head + ("what a loser" if i % 2 else "a good garden") + f" {i}") for i in range(120)]
    docs = spark.createDataFrame([*rows, *rows[:30], (500, rows[1][1]), (501, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, i % 2) for i, _ in rows), (500, 1), (501, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.odds["loser"] > 2.5 and "garden" not in model.odds and "published" not in model.odds
    assert model == toxicity.fit(docs.repartition(7), labels)
    assert {r.doc_id for r in toxicity.score_documents(docs, model).filter("predicted = 1").collect()} == {i for i in range(1, 120, 2)} | {500}


def test_every_labelled_row_is_learnt_from(spark):
    """2,500 words that stand in four of 10,000 toxic texts each: with any row left out one of them would be too rare."""
    ids = [i for i in range(45_000) if zlib.crc32(str(i).encode()) % 3 != 1][:26_000]
    word = lambda n: "q" + "".join(chr(97 + int(c)) + "x" for c in str(n))
    rows = [(i, f"{word(n // 4)} day {i}" if n < 10_000 else f"a garden {i}", int(n < 10_000)) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert {word(n) for n in range(2500)} <= model.odds.keys()


def test_letters_of_every_text_and_labels_of_every_row_are_learnt_from(spark, monkeypatch):
    """Unlabelled texts count for the letters, and the pipeline's stage leaves out no label; op6's fold leaves out held-out rows."""
    import corpus_pipeline

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, f"a zzloser {i}" if i in held[:60] else f"a garden {i}", int(i in held[:60])) for i in range(400)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(1000, "qxqxqx alone"), (None, "jyjyjy alone"), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(held[0], 0)], "doc_id long, toxic int")
    whole, folded = toxicity.fit(docs, labels, fold=False), toxicity.fit(docs, labels)
    assert "zzloser" in whole.odds and "zzloser" not in folded.odds
    assert {"^^^q", "qxqx", "xqx$", "^^^j", "yjy$"} <= whole.grams.keys() and "^^^q" not in folded.grams
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)
    assert {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, "").collect()} == {*range(400), 1000, 1001, None} - set(held[:60])


def test_grams_are_counted_as_one_by_one(monkeypatch):
    words = {"garden": 3, "a": 2, "été": 1, "漢字": 5, "": 4, "\U00020000x": 7, "aaaaaa": 2} | {chr(0x4E00 + i) * (1 + i % 5): i + 1 for i in range(3000)}
    want = Counter()
    for w, n in words.items():
        s = "^^^" + w + "$"
        for i in range(len(s) - 3):
            want[s[i : i + 4]] += n
    assert toxicity.longest_grams(words) == want and toxicity.longest_grams({}) == Counter()
    monkeypatch.setattr(toxicity, "GRAM_SIGNS", 50)
    assert toxicity.longest_grams(words) == want


def test_logistic_by_sums(spark):
    """Weights are those of plain Newton steps over all rows in one place, however the rows are dealt."""
    rng = np.random.default_rng(3)
    x = rng.random((400, 2)) * [60, 1]
    y = (x[:, 0] / 30 + x[:, 1] + rng.standard_normal(400) > 1.5).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, y int")
    full, w, ridge = np.column_stack([np.ones(400), x]), np.zeros(3), np.diag([0.01, 0.1, 0.1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        w = w + np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge, full.T @ (y - p) - ridge @ w)
    got = toxicity.logistic(df, ["a", "b"], "y")
    assert got == pytest.approx(tuple(w), abs=1e-6) and got == toxicity.logistic(df.repartition(5), ["a", "b"], "y")


def test_edits_are_located_on_both_sides():
    lines = [f"Paragraph {i} tells of {i * i}.\n" for i in range(40)]
    edits = lambda other: merkle.located_edits(merkle.fingerprint("".join(lines)), merkle.fingerprint("".join(other)))
    assert edits(lines) == {"removed": [], "added": [], "moved": []}
    assert edits(lines[:17] + lines[18:]) == {"removed": [17], "added": [], "moved": []}
    assert edits([*lines[:9], "New.\n", *lines[9:]]) == {"removed": [], "added": [9], "moved": []}
    assert edits([*lines[:30], "Other.\n", *lines[31:]]) == {"removed": [30], "added": [30], "moved": []}
    assert edits([*lines[:3], *lines[4:35], lines[3], *lines[35:]]) == {"removed": [], "added": [], "moved": [(3, 34)]}
    assert edits([]) == {"removed": list(range(40)), "added": [], "moved": []}
    empty = merkle.fingerprint("")
    assert merkle.located_edits(empty, merkle.fingerprint("a\na\n")) == {"removed": [], "added": [0, 1], "moved": []}
    assert merkle.located_edits(empty, empty) == {"removed": [], "added": [], "moved": []}


def test_repeats_leave_with_any_extra_columns(spark):
    """Columns named like the stage's own are carried along, and rows keep their own values."""
    shared = prose(50, 60)
    rows = [(1, prose(1, 20) + " " + shared, "k1", 7, "s", 5), (2, prose(2, 20) + " " + shared, "k2", 8, None, 6), (3, None, "k3", None, "t", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, found_id long, text_sha1 string, row int")
    got = {r.doc_id: r for r in recompress.without_repeats(df, 50).collect()}
    assert [f.name for f in recompress.without_repeats(df, 50).schema] == df.columns
    assert {i: tuple(r)[2:] for i, r in got.items()} == {r[0]: r[2:] for r in rows}
    assert (got[1].text, got[2].text, got[3].text) == (rows[0][1], prose(2, 20), None)


@pytest.mark.parametrize("special", [{}, {"<|a|>": 1, "<|a|>b": 2, "::": 3}])
def test_chunks_with_any_special_tokens(special):
    """None, or several of which one begins like another: the longest counts."""
    bpe = byte_bpe(default_tokenizer())
    other = type("Other", (), {"special": special, "plain": staticmethod(bpe.plain), "width": bpe.width})()
    parts = ["The old ", "<|a|>b", " fox ", "<|a|>", "jumps::", " over", "::", "::"] * 3
    want = []
    for piece in re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", "".join(parts)) if special else ["".join(parts)]:
        want += [special[piece]] if piece in special else bpe.plain(piece).tolist()
    assert chunked_bpe.ChunkEncoder(other).encode("".join(parts).encode()).tolist() == want


def test_a_pack_is_scanned_once_for_ids_and_counts(spark):
    """With buckets, the pass that makes subword ids also gives the words to count; the ids are those of the pass without."""
    docs = spark.createDataFrame([(i, f"A word{i % 7} a  Word{i % 7}\tend{i}") for i in range(60)] + [(99, None), (None, "a lost word")], "doc_id long, text string").coalesce(1)
    packs = lm_score.write_packs(docs, 20_000).select("pack", "ids", "lengths", "blob")
    plain, both = (packs.mapInArrow(lm_score._cut(default_tokenizer(), 2, *b), s).collect() for b, s in (((), lm_score.CUT), ((3,), f"{lm_score.CUT}, {lm_score.ASKED}")))
    assert [r[:5] for r in both] == [tuple(r) for r in plain]
    counts = Counter()
    for r in both:
        assert len(r.bucket) == len(set(r.bucket)) == len(r.keys) == len(r["counts"])
        for k, n in zip(r["keys"], r["counts"]):
            counts.update(dict(zip(np.frombuffer(k, np.uint64).tolist(), np.frombuffer(n, np.uint32).tolist(), strict=True)))
    want = Counter()
    for d, t in docs.collect():
        want.update(t.lower().split() if t and lm_score.is_training(d) else [])
    assert sorted(n for n in counts.values() if n) == sorted(want.values())


def test_texts_are_read_once_and_told_by_the_numbers_of_their_words(spark):
    """Packs are cut from documents as from written packs; their words' numbers and keys tell every place's word."""
    texts = [f"A word{i % 7} a  Word{i % 7}\tend{i} " + "x" * (i * 37 % 5000) for i in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    packs = lm_score.write_packs(docs, 200_000).select("pack", "ids", "lengths", "blob")
    schema, path = f"{lm_score.CUT}, {lm_score.ASKED}", default_tokenizer()
    rows = docs.mapInArrow(lm_score._cut(path, 2, 3, 200_000), schema).collect()
    assert len(rows) > 1 and rows == packs.mapInArrow(lm_score._cut(path, 2, 3), schema).collect()
    for r in rows:
        lower = [(texts[i] or "").lower().encode() for i in r.ids]
        bounds, starts, ends, hashes, buffer = scan_words(lower)
        mine = lm_score.scanned(lower)
        assert all(np.array_equal(x, y) for x, y in zip(mine[:4], (bounds, starts, ends, hashes))) and mine[4] == buffer
        keys = np.frombuffer(b"".join(r["keys"]), np.uint64)
        places = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.places), np.uint32)
        assert r.word_bounds == bounds.tolist() and np.array_equal(keys[places], hashes)
        assert [len(k) for k in r["keys"]] == [8 * n for n in r.sizes]


def test_gradients_are_those_of_plain_steps():
    """Weights of windows whose rows are shared by two windows, against one window after the other."""
    rng = np.random.default_rng(4)
    classes = rng.integers(0, attention.CLASSES, 40)
    inputs, targets, _ = attention.layout(rng.integers(0, 40, 400), np.array([0, 150, 151, 400]), classes, 40)
    w = attention.first_weights(40, np.bincount(classes, minlength=attention.CLASSES))
    g, ids, rows = attention.gradients(w, inputs, targets)
    c, used = attention.CONTEXT, (targets[attention.CONTEXT :] >= 0).sum()
    want = {n: np.zeros(x.shape) for n, x in w.items()}
    for a in range(0, len(inputs) - c, c):
        t = targets[a : a + 2 * c].copy()
        t[:c] = -1
        share = (t >= 0).sum() / used
        part, at, own = attention.gradients(w, inputs[a : a + 2 * c], t)
        for n, x in part.items():
            want[n] += share * x
        want["embed"][at] += share * own
    got = g | {"embed": np.zeros(w["embed"].shape)}
    got["embed"][ids] = rows
    assert all(np.allclose(got[n], x, atol=1e-6) for n, x in want.items())


def test_distinct_words_are_those_of_a_stable_sort():
    words = np.random.default_rng(8).integers(0, 50, 3000).astype(np.uint64)
    for x in (words, words[:0]):
        distinct, place, number = lm_score.distinct_words(x)
        assert distinct.tolist() == np.unique(x).tolist() and (x[place] == distinct).all() and (distinct[number] == x).all()


def test_training_steps_are_adam_on_each_weight():
    rng = np.random.default_rng(9)
    classes = rng.integers(0, attention.CLASSES, 40)
    inputs, targets, _ = attention.layout(rng.integers(0, 40, 300), np.array([0, 120, 121, 300]), classes, 40)
    w = attention.first_weights(40, np.bincount(classes, minlength=attention.CLASSES))
    trainer, mine = attention.Trainer(w, 0.01), {n: x.copy() for n, x in w.items()}
    mean, square = ({n: np.zeros(s) for n, s in attention.SMALL.items()} for _ in range(2))
    seen = np.full(len(w["embed"]), 1e-8)
    for step in (1, 2, 3):
        g, ids, rows = attention.gradients(mine, inputs, targets)
        assert ids.tolist() == sorted(set(inputs.tolist()))
        for n, x in g.items():
            mean[n], square[n] = 0.9 * mean[n] + 0.1 * x, 0.99 * square[n] + 0.01 * x * x
            mine[n] = (mine[n] - 0.01 * mean[n] / (1 - 0.9**step) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        seen[ids] += (rows * rows).mean(1)
        mine["embed"][ids] -= 0.05 * rows / np.sqrt(seen[ids])[:, None]
        trainer.step(inputs, targets)
        for n, x in mine.items():
            assert trainer.w[n] == pytest.approx(x, abs=2e-4)
    assert not np.array_equal(trainer.w["out"], w["out"])
