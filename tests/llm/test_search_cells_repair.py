"""Ranked search, embedding near-duplicates and conversation repair against plain versions."""

import functools
import hashlib
import math
import os
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest

from orbweave.llm import cells, ranked, repair


def fold(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain_search(docs, items, k):
    docs = [(i, fold(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    count, total = len(docs), sum(len(t) for _, t in docs)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(fold(t))
    weight = {x: math.floor(1000 * math.log((2 * count + 2) / (2 * sum(x in t for _, t in docs) + 1))) for x in set().union(*asked.values())}
    out = set()
    for item, terms in asked.items():
        scored = []
        for n, (i, t) in enumerate(docs):
            m = 10 + 90 * len(t) * count // total
            score = sum(weight[x] * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in terms if x in t)
            if score > 0:
                scored.append((-score, i is None, i or 0, n))
        out |= {(item, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("settings", [{}, {"BROADCAST_TERMS": 0, "BROADCAST_ROWS": 0, "BUNDLE_ITEMS": 2}])
def test_ranked_search_equals_a_plain_one(spark, docs, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ranked, name, value)
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma", "ünï", "x1", "z-z", "it's", "漢字", "the", "THE", "of"]
    more = [(1000 + i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(150)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + more + more[:3]
    items = [(1, "alpha Beta the ünï"), (2, "the of"), (3, None), (4, ""), (5, "nowhere-to-be-found"), (None, "gamma x1"), (7, "漢字 z"), (7, "it the"), (8, "quick1 the fox33 lazy")]
    wide = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, score string, block int")
    got = ranked.search(wide, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, weight int"), 10, block_docs=40)
    assert {tuple(r) for r in got.collect()} == plain_search(rows, items, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0
    assert ranked.search(docs.filter("text is null"), items).count() == 0


def plain_groups(vectors, threshold):
    units = {}
    for n, (i, v) in enumerate(vectors):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            units[n] = x / np.linalg.norm(x)
    near = {a: [b for b in units if a != b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold] for a in units}
    out = []
    for n, (i, _) in enumerate(vectors):
        seen, todo = {n}, [n]
        while todo:
            for b in near.get(todo.pop(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = None if i is None else min(vectors[b][0] for b in seen)
        out.append((i, len(near.get(n, [])), low, i is not None and i == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"CELL_ROWS": 20, "CHUNK_ROWS": 50, "BLOCK_ROWS": 16}])
def test_cells_equal_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(cells, name, value)
    rng = np.random.default_rng(3)
    free, tight, chain = rng.normal(size=(150, 16)), rng.normal(size=16) + rng.normal(scale=0.05, size=(80, 16)), []
    for a in np.linspace(0, 1.2, 12):  # neighbours link, the ends do not
        chain.append([math.cos(a), math.sin(a), *[0.0] * 14])
    values = [*free.tolist(), *tight.tolist(), *chain, *[free[3].tolist()] * 5, (free[4] * 1e300).tolist(), (free[5] * 1e-300).tolist(), [1.0, 2.0], [2.0, 4.0], [0.0] * 16, [0.0] * 16, None, [], [None] * 16, [float("nan")] * 16, [float("inf")] * 16]
    rows = [(7 * i % 1009, v) for i, v in enumerate(values)] + [(None, free[3].tolist()), (7, free[1].tolist())]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, n int")
    got = sorted((tuple(r) for r in cells.near_vectors(df).collect()), key=str)
    assert got == plain_groups(rows, 0.95)
    assert cells.near_vectors(df.limit(0)).count() == 0 and cells.near_vectors(df.filter("embedding is null")).count() == 1


def test_cells_find_pairs_at_the_threshold(spark, monkeypatch):
    """Recall of partners that differ from random vectors by just the allowed angle, in many dimensions and many cells."""
    monkeypatch.setattr(cells, "CELL_ROWS", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    y = 0.951 * x + math.sqrt(1 - 0.951**2) * r
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate((x, y)))], "vec_id long, embedding array<double>")
    found = cells.near_vectors(df).filter("n_links = 1").count()
    assert found >= 0.999 * 3000


def test_cells_settle_pairs_that_16_bits_cannot(spark):
    """Partners whose cosine is a ten-millionth above or below the threshold."""
    rng = np.random.default_rng(5)
    values = []
    for n in range(60):
        x, r = rng.normal(size=(2, 24))
        x /= np.linalg.norm(x)
        r -= (r @ x) * x
        r /= np.linalg.norm(r)
        c = 0.95 + (1e-7 if n % 2 else -1e-7)
        values += [(x * 3).tolist(), (c * x + math.sqrt(1 - c * c) * r).tolist()]
    rows = list(enumerate(values)) + [(500, values[3])]
    got = sorted((tuple(r) for r in cells.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == plain_groups(rows, 0.95) and sum(r[1] for r in got) == 64


def test_cells_move_little(spark, monkeypatch):
    """What is written to the shared folder and shuffled stays near the input, however many cells a vector visits."""
    monkeypatch.setattr(cells, "CELL_ROWS", 128)
    x = np.random.default_rng(6).normal(size=(6000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    stored, kept = [], cells.materialize

    def keep(df, name, compression="snappy"):
        out = kept(df, name, compression)
        stored.extend(out.inputFiles())
        return out

    monkeypatch.setattr(cells, "materialize", keep)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = shuffled()
    assert cells.near_vectors(df).filter("n_links = 0 and kept").count() == 6000
    moved = sum(n for stage, n in shuffled().items() if stage not in before)
    written = sum(os.path.getsize(urllib.parse.unquote(urllib.parse.urlparse(f).path)) for f in stored)
    assert moved + written <= 6 * x.nbytes, (moved, written, x.nbytes)


LEGAL = re.compile("(s?(ua)+)?")


def plain_repair(turns):
    by, out = {}, {}
    for conv, turn, role, text in turns:
        rows = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha1(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        @functools.cache
        def best(i, initials, rows=tuple(rows), faults=tuple(faults)):
            """Least (cost, audit, lines) from row i on, after initials in the shortest form that means the same."""
            ways = [(0, "", ())] if i == len(rows) and LEGAL.fullmatch(initials) else []

            def go(cost, letter, initial, lines, to):
                after = initials + initial
                if any(LEGAL.fullmatch(after + rest) for rest in ("", "a", "ua")):
                    after = re.sub("^(s?)(ua)+(u?)$", r"\1ua\3", after)
                    c, letters, more = best(to, after)
                    ways.append((c + cost, letter + letters, lines + more))

            if i < len(rows):
                _, role, text = rows[i]
                go(2, "D", "", (), i + 1)
                if faults[i] not in ("blank", "duplicate"):
                    extra = 5 * (faults[i] == "truncated")
                    go(extra, "K", role[:1], (f"{role}:{text}",), i + 1)
                    for new in ("user", "assistant"):
                        go(1 + extra, "R", new[0], (f"{new}:{text}",), i + 1)
            for letters in ("u", "a", "ua", "au", "uau", "aua"):  # chains of insertions, then a row or the end
                after = initials + letters
                if not any(LEGAL.fullmatch(after + rest) for rest in ("", "a", "ua")):
                    continue
                after = re.sub("^(s?)(ua)+(u?)$", r"\1ua\3", after)
                lines = tuple({"u": "user:", "a": "assistant:"}[x] for x in letters)
                for c, marks, more in taken(i, after, rows, faults):
                    ways.append((c + 5 * len(letters), "I" * len(letters) + marks, lines + more))
            return min(ways) if ways else (math.inf, "", ())

        def taken(i, initials, rows, faults):
            if i == len(rows):
                return [(0, "", ())] if LEGAL.fullmatch(initials) else []
            _, role, text = rows[i]
            found = [(2, "D", initials, ())]
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                found += [(extra, "K", initials + role[:1], (f"{role}:{text}",)), *((1 + extra, "R", initials + new[0], (f"{new}:{text}",)) for new in ("user", "assistant"))]
            out = []
            for cost, letter, after, lines in found:
                if any(LEGAL.fullmatch(after + rest) for rest in ("", "a", "ua")):
                    c, letters, more = best(i + 1, re.sub("^(s?)(ua)+(u?)$", r"\1ua\3", after))
                    out.append((cost + c, letter + letters, lines + more))
            return out

        cost, audit, lines = best(0, "")
        known = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment", [3, 4096])
def test_repair_equals_a_plain_search(spark, segment):
    rng = random.Random(segment)
    turns = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 11)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "no", "Why?", "", " \t", None, "Well, é!  ", f"line {turn}.", f"open {turn}"])
            turns.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    turns += [(900, i, "user", "Same.") for i in range(40)] + [(901, i, "assistant" if i % 2 else "user", f"Line {i}.") for i in range(40)] + [(902, 5, "user", "Twice.")] * 3
    turns += [(c, 0, "user", "Gone.") for c in range(2000, 2400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, kind string, n int")
    got = {r[0]: tuple(r)[1:] for r in repair.repair_conversations(df, segment).collect()}
    want = plain_repair(turns)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_repair_of_long_runs_and_nothing(spark):
    turns = [(1, i, "user", f"Line {i}.") for i in range(9000)] + [(2, i, "user", "Same.") for i in range(9000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in repair.repair_conversations(df).collect()}
    left = sum(zlib.crc32(f"2:{i}".encode()) % 20 != 0 for i in range(9000)) + sum(zlib.crc32(f"2:{i}".encode()) % 20 == 3 for i in range(9000))
    assert len(rows[2].audit.replace("I", "")) == left and rows[2].duplicate + rows[2].blank + rows[2].truncated >= left - 1
    assert rows[1].audit.startswith("KR") and set(rows[1].audit) <= set("DIKR")
    assert repair.repair_conversations(df.limit(0)).count() == 0
