"""Language-model scores of whole texts: corpus word counts for a base score, a causal attention model for the score.

Texts are read once: packs of documents are kept as subword ids and as numbers of their distinct words. Word counts are
exchanged between packs: a pack sends each of its distinct words once, with its count in training documents, and gets
back the corpus count. The attention model learns from
every training document: the rounds share them out, so each is learnt from once. In a round each pack is one local pass
from the same weights, and Spark averages what the passes end with, by their tokens. The next subword's class comes from
the model, the subword inside it from corpus counts; classes are equal weights of the ids in order of their counts.

A text's tokens are its words (A-Z lower-cased) and one end; its subword ids are those of each word after a space, then
the tokenizer's end id. Defined cases: a null or empty text is its end alone; repeated rows are scored (and, as training
documents, counted) once each; a null doc_id is scored as held out; without training documents all counts are 0; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import attention as net
from .packs import answered, bucket_count, deal, dealt_texts, pack_rows, write_packs  # noqa: F401 (_cut also takes written packs)
from .subwords import ByteBpe, byte_bpe, default_tokenizer
from .textscan import U64, give_back, groups, scan_words
from .workspace import materialize

PACK_BYTES = 4 << 20
#: Bytes of texts that are scanned at once: few, so that they stay in the processor's cache.
SCAN_BYTES = 1 << 17
#: Bytes of text for each key of the word counts, about; only the number of buckets follows from it.
KEY_BYTES = 24
#: Rounds of training; parts of the weights that are summed apart.
ROUNDS, SLICES = 2, 16
HELD_OUT = (7, 2)


def is_training(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT[0] != HELD_OUT[1]


def distinct_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique: (sorted hashes, a place of each, number of each word's hash), by a sort that need not be stable."""
    order = np.argsort(words)
    ordered = words[order]
    new = np.ones(len(words), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(words), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def scanned(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """As scan_words, some texts at a time."""
    parts, words, size = [], 0, 0
    for a, b in groups(texts, SCAN_BYTES):
        bounds, starts, ends, hashes, buffer = scan_words(texts[a:b])
        parts.append((bounds[1:] + words, starts + size, ends + size, hashes, buffer))
        words, size = words + len(starts), size + len(buffer)
    if not parts:
        return scan_words(texts)
    bounds, starts, ends, hashes, buffers = zip(*parts, strict=True)
    return np.concatenate(([0], *bounds)), np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes), b"".join(buffers)


class PackWords:
    """Distinct words of a pack, in bucket order, and where they stand."""

    def __init__(self, ids: list, texts: list[bytes], buckets: int):
        self.bounds, starts, ends, words, buffer = scanned([t.lower() for t in texts])
        self.training = np.array([is_training(i) for i in ids], bool)
        distinct, first, inverse = distinct_words(words)
        order, self.where, self.cut = deal(distinct, buckets)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys, self.inverse = distinct[order], rank[inverse] if len(inverse) else inverse
        self.spans = starts[first][order], ends[first][order]
        self.buffer = buffer
        trained = np.repeat(self.training, np.diff(self.bounds))
        self.counts = np.bincount(self.inverse[trained], minlength=len(self.keys)).astype(np.int64)

    def subwords(self, bpe: ByteBpe) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the distinct words, each encoded after a space."""
        words = [self.buffer[a:b].decode() for a, b in zip(*(x.tolist() for x in self.spans), strict=True)]
        odd = [i for i, w in enumerate(words) if w[0].isspace() or w[-1].isspace()]
        plain = set(odd)
        chain = [i for i in range(len(words)) if i not in plain]
        # Words without white space at their ends are encoded in one go: a space between two of them is always a cut.
        ids = bpe.plain("".join([" " + words[i] for i in chain]))
        ends = np.searchsorted(np.cumsum(bpe.width[ids]), np.cumsum([len(words[i].encode()) + 1 for i in chain])) + 1
        size = np.zeros(len(words), np.int64)
        size[chain] = np.diff(np.concatenate(([0], ends))) if chain else 0
        rest = {i: bpe.plain(" " + words[i]) for i in odd}
        for i, x in rest.items():
            size[i] = len(x)
        bounds = np.concatenate(([0], np.cumsum(size)))
        out = np.zeros(bounds[-1], np.int64)
        if rest:
            mask = np.ones(len(out), bool)
            for i, x in rest.items():
                out[bounds[i] : bounds[i + 1]] = x
                mask[bounds[i] : bounds[i + 1]] = False
            out[mask] = ids
        else:
            out[:] = ids
        return out, bounds

    def sequences(self, ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(subword ids of all documents in a row, an end after each; bounds of the documents)."""
        ids, size = np.append(ids, end), np.append(np.diff(bounds), 1)
        begin = np.append(bounds[:-1], len(ids) - 1)
        words = np.insert(self.inverse, self.bounds[1:], len(size) - 1)
        length = size[words]
        stop = np.cumsum(length)
        flat = ids[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - length - begin[words], length)]
        last = self.bounds[1:] + np.arange(len(self.bounds) - 1)
        return flat, np.concatenate(([0], stop[last]))


def _total(table: pa.Table) -> pa.Table:
    """Answers each pack of a bucket with the corpus counts of its words, in their order; one more row has the sums."""
    packs, bucket = table.column("pack").to_pylist(), table.column("bucket")[0].as_py()
    keys = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
    found, cut = total[inverse], np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    head = np.array([bucket], np.int64).tobytes()
    small = total.max(initial=0) < 1 << 32
    rows = [head + (found[a:b].astype(np.uint32) if small else found[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    n = len(rows)
    return pa.table({"pack": pa.array([*packs, None], pa.int64()), "answer": pa.array([*rows, None], pa.binary()), "n": pa.array([0] * n + [int(total.sum())], pa.int64()), "v": pa.array([0] * n + [int((total > 0).sum())], pa.int64())})


def _cut(path: str, end: int, buckets: int = 0, size: int = 0) -> Callable:
    """Packs as subword ids, which the model reads.

    With buckets also their distinct words by these, with their counts, and the number of the word at each place. With
    size, rows are documents (doc_id, text), and so many bytes of them make a pack.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, zip_ = byte_bpe(path), zstandard.ZstdCompressor(level=1)
        for pack, ids, texts in dealt_texts(batches, size) if size else (x[:3] for x in pack_rows(batches)):
            w = PackWords(ids, texts, buckets or 1)
            tokens, bounds = w.sequences(*w.subwords(bpe), end)
            kind = np.uint16 if bpe.size <= 1 << 16 else np.uint32
            cut = list(zip(w.cut[:-1].tolist(), w.cut[1:].tolist(), strict=True))
            part = lambda x: pa.array([[x[a:b].tobytes() for a, b in cut]], pa.list_(pa.binary()))  # noqa: B023, E731
            longs = lambda x: pa.array([x], pa.list_(pa.int64()))
            own = {"pack": pa.array([pack], pa.int64()), "ids": longs(ids), "bounds": longs(bounds), "tokens": [zip_.compress(tokens.astype(kind).tobytes())], "width": pa.array([np.dtype(kind).itemsize], pa.int32())}
            asked = {"bucket": longs(w.where), "keys": part(w.keys), "counts": part(w.counts.astype(np.uint32))} if buckets else {}
            placed = {"sizes": longs(np.diff(w.cut)), "word_bounds": longs(w.bounds), "places": [zip_.compress(w.inverse.astype(np.uint32).tobytes())]} if buckets else {}
            yield pa.RecordBatch.from_pydict(own | asked | placed)
        give_back()

    return run


CUT = "pack long, ids array<long>, bounds array<long>, tokens binary, width int"
ASKED = "bucket array<long>, keys array<binary>, counts array<binary>, sizes array<long>, word_bounds array<long>, places binary"
PLACED = ("pack", "ids", "bucket", "sizes", "word_bounds", "places")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(pack, doc_ids, tokens, bounds) of every pack of subword ids."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            pack, ids, bounds, tokens, width = (batch.column(c)[i].as_py() for c in range(5))
            yield pack, ids, np.frombuffer(unzip.decompress(tokens), np.uint16 if width == 2 else np.uint32), np.array(bounds, np.int64)


def _count_subwords(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for _, ids, tokens, bounds in _read(batches):
            trained = np.repeat([is_training(i) for i in ids], np.diff(bounds))
            counts += np.bincount(tokens[trained], minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used), "n": pa.array(counts[used])})

    return run


def classes_of(counts: np.ndarray, end: int) -> np.ndarray:
    """Class of each subword id: by falling count, classes of equal weight; the end id is the last class alone."""
    order = np.argsort(-counts, kind="stable")
    order = order[order != end]
    weight = np.cumsum(counts[order] + 1.0)
    out = np.zeros(len(counts), np.int64)
    out[order] = np.minimum((weight - weight[0]) / weight[-1] * (net.CLASSES - 1), net.CLASSES - 2).astype(np.int64)
    out[end] = net.CLASSES - 1
    return out


def _trainer(w: net.Weights, classes: np.ndarray, turn: int) -> Callable:
    """Sums over packs of the weights that each pack's own pass ends with, weighted by its tokens, cut into SLICES parts.

    Every pass starts from the same weights, so the sums do not depend on how packs are dealt to tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = {n: np.zeros(s) for n, s in net.SMALL.items()}
        embed, seen, total = np.zeros(w["embed"].shape), np.zeros(len(w["embed"])), 0
        for _, ids, tokens, bounds in _read(batches):
            # Every training document has its round.
            chosen = np.array([is_training(i) and zlib.crc32(b"%d" % i) // 7 % ROUNDS == turn for i in ids])
            size = np.diff(bounds)
            tokens = tokens[np.repeat(chosen, size)].astype(np.int64)
            if not len(tokens):
                continue
            inputs, targets, _ = net.layout(tokens, np.concatenate(([0], np.cumsum(size[chosen]))), classes, len(classes))
            trainer = net.Trainer(w, 0.01 / (1 + turn))
            n = trainer.learn(inputs, targets)
            for x in small:
                small[x] += n * trainer.w[x].astype(float)
            own = np.bincount(inputs, minlength=len(embed))
            used = np.flatnonzero(own)
            embed[used] += own[used, None] * trainer.w["embed"][used]
            seen, total = seen + own, total + n
        if total:
            flat = np.concatenate([small[x].ravel() for x in net.SMALL] + [[total], seen, embed.ravel()]).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(SLICES), pa.int32()), "sums": pa.array([x.tobytes() for x in np.array_split(flat, SLICES)], pa.binary())})
        give_back()

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float32).astype(float) for x in table.column("sums").to_pylist())
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def train(tokens: DataFrame, classes: np.ndarray, counts: np.ndarray) -> net.Weights:
    """Weights after ROUNDS rounds: local passes over all packs, averaged by Spark; rows of unseen ids stay as they were."""
    w = net.first_weights(len(classes), np.bincount(classes, counts, net.CLASSES))
    for turn in range(ROUNDS):
        made = tokens.mapInArrow(_trainer(w, classes, turn), "part int, sums binary").groupBy("part").applyInArrow(_add, "part int, sums binary")
        rows = sorted(made.collect())  # one vector of the model's size, whatever the corpus
        if not rows:
            return w
        flat, at, mean = np.concatenate([np.frombuffer(r[1]) for r in rows]), 0, {}
        for n, s in net.SMALL.items():
            mean[n], at = flat[at : at + int(np.prod(s))].reshape(s), at + int(np.prod(s))
        total, seen, embed = flat[at], flat[at + 1 : at + 1 + len(w["embed"])], flat[at + 1 + len(w["embed"]) :].reshape(w["embed"].shape)
        w |= {n: (x / total).astype(np.float32) for n, x in mean.items()}
        w["embed"] = np.where(seen[:, None] > 0, embed / np.maximum(seen, 1)[:, None], w["embed"]).astype(np.float32)
    return w


def _model_scores(w: net.Weights, classes: np.ndarray, inside: np.ndarray) -> Callable:
    """(pack, natural log probability of each of its documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, _, tokens, bounds in _read(batches):
            tokens = tokens.astype(np.int64)
            inputs, targets, at = net.layout(tokens, bounds, classes, len(classes))
            each = net.score(w, inputs, targets)[at] + inside[tokens]
            yield pa.RecordBatch.from_pydict({"pack": pa.array([pack], pa.int64()), "scores": pa.array([np.add.reduceat(each, bounds[:-1])], pa.list_(pa.float64()))})
        give_back()

    return run


def _scorer(n: int, v: int, ends: int) -> Callable:
    """Final rows from (PLACED, answers, scores) of packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, unzip = float(n) + float(v + 1), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, where, sizes, bounds, places, answers, scores = (c[i].as_py() for c in batch.columns)
                cut = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
                corpus = np.zeros(cut[-1], np.int64)
                place = {b: (x, y) for b, x, y in zip(where, cut[:-1].tolist(), cut[1:].tolist(), strict=True)}
                for a in answers or ():
                    x, y = place[int.from_bytes(a[:8], "little")]
                    corpus[x:y] = np.frombuffer(a, np.uint32 if len(a) == 8 + 4 * (y - x) else np.int64, offset=8)
                words, bounds = np.frombuffer(unzip.decompress(places), np.uint32), np.array(bounds, np.int64)
                logs = np.concatenate(([0.0], np.cumsum(np.log10((corpus + 1.0) / base)[words])))
                known = np.concatenate(([0], np.cumsum((corpus > 0)[words])))
                a, b = bounds[:-1], bounds[1:]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(ids, pa.int64()), "held_out": [not is_training(i) for i in ids], "n_tokens": b - a + 1, "n_known": known[b] - known[a] + (ends > 0), "train_tokens": pa.array([n] * len(ids), pa.int64()), "base_score": logs[b] - logs[a] + np.log10((ends + 1.0) / base), "score": np.array(scores) / np.log(10)}
                )
        give_back()

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    path = tokenizer or default_tokenizer()
    bpe = byte_bpe(path)
    end = next(iter(bpe.special.values()))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = bucket_count((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // KEY_BYTES)
    cut = materialize(docs.mapInArrow(_cut(path, end, buckets, PACK_BYTES), f"{CUT}, {ASKED}"), "lm-tokens", "none")
    asked = cut.select("pack", F.explode(F.arrays_zip("bucket", "keys", "counts")).alias("a")).select("pack", "a.*")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_total, "pack long, answer binary, n long, v long"), "word-counts", "none")
    sums = answers.filter("pack is null").agg(F.sum("n"), F.sum("v")).first()
    tokens = cut.select("pack", "ids", "bounds", "tokens", "width")
    rows = tokens.mapInArrow(_count_subwords(bpe.size), "id long, n long").groupBy("id").agg(F.sum("n")).collect()  # at most one row per id
    counts = np.zeros(bpe.size, np.int64)
    for r in rows:
        counts[r[0]] = r[1]
    ends = int(counts[end])
    n, v = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    classes = classes_of(counts, end)
    inside = np.log(counts + 1.0) - np.log(np.maximum(np.bincount(classes, counts + 1.0, net.CLASSES), 1.0))[classes]
    w = train(tokens, classes, counts)
    scores = materialize(tokens.mapInArrow(_model_scores(w, classes, inside), "pack long, scores array<double>"), "lm-scores")
    placed = answered(cut.select(*PLACED), answers.filter("pack is not null").select("pack", "answer")).join(scores, "pack")
    return placed.mapInArrow(_scorer(n, v, ends), SCORED)
