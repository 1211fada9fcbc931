"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks of at most BLOCK_DOCS rows: for each block and term of an item one row with the places,
occurrences and lengths. Terms are dealt to STAGES owners by weight, the rarest first. Items travel in bundles: at each
owner the sparse accumulators of a bundle over a block meet the owner's rows of that block in a cogroup, whole-number
contributions are added, and the accumulators go on to the next owner. Between owners an accumulator is dropped when even
the largest scores of all later terms could not lift it to the score that ten others of its block have already; equal
scores stay, so the selection at the end is exact.

Defined cases: a null text has no terms; a document without terms counts for nothing; rows of one doc_id are documents of
their own, a null doc_id comes after all others at equal scores; the rows of one item_id are one item with the terms of all
of them, a null item_id is an item; an item without terms has no rows; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .textscan import groups, scan_words, slices, text_bytes
from .workspace import materialize

STAGES = 4
#: Rows of a block at most, and hits after which a block ends early; items of a bundle, about.
BLOCK_DOCS, BLOCK_HITS, BUNDLE_ITEMS = 1 << 16, 1 << 22, 256
#: Distinct terms of all items up to which they are broadcast to the scan, and rows of the owners' tables up to which these are.
BROADCAST_TERMS, BROADCAST_ROWS = 1 << 20, 1 << 20
#: No term gives more than its weight times this.
MOST = 1_000_000
INDEX = "block long, term string, docs binary, tf binary, n binary, ids array<long>"

#: Bytes outside terms become spaces, capital ASCII letters small; all bytes of other letters stay.
_FOLD = bytes(
    32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c
    for c in range(256)
)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, column in slices(batches, 1):
        found = [sorted(set(t.translate(_FOLD).split())) for t in text_bytes(column)]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([t.decode() for f in found for t in f], pa.string())], names=["item_id", "term"])


class _Terms:
    """Finds words among known terms: by hash, then by all their bytes."""

    def __init__(self, terms: list[str]):
        data = [t.encode() for t in terms]
        _, starts, ends, hashes, buffer = scan_words([b" ".join(data)])
        order = np.argsort(hashes)
        self.hashes, self.names = hashes[order], [terms[i] for i in order.tolist()]
        self.starts, self.length = starts[order], (ends - starts)[order]
        self.buf = np.frombuffer(buffer, np.uint8)

    def find(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of words that are terms, their numbers)."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        word = np.flatnonzero((self.hashes[at] == hashes) & (self.length[at] == ends - starts))
        term, length = at[word], (ends - starts)[word]
        if not len(word):
            return word, term
        begin = np.cumsum(length) - length
        inside = np.arange(int(length.sum())) - np.repeat(begin, length)
        same = buf[np.repeat(starts[word], length) + inside] == self.buf[np.repeat(self.starts[term], length) + inside]
        whole = np.logical_and.reduceat(same, begin)
        return word[whole], term[whole]


def _indexer(known: Broadcast | None, block_docs: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(known.value) if known is not None and known.value else None
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        lengths: list[np.ndarray] = []
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names: dict[str, int] = {}

        def made() -> pa.RecordBatch:
            nonlocal block
            n = np.concatenate(lengths)
            term, doc, tf = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.argsort(term, kind="stable")
            term, doc, tf = term[order], doc[order], tf[order]
            first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            edges = np.append(first, len(term)).tolist()
            all_names = terms.names if terms else list(names)
            parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            # The last row is the block's head: its rows' doc_ids and lengths, without a term.
            out = {
                "block": pa.array([block] * (len(parts) + 1), pa.int64()), "term": pa.array([*(all_names[i] for i in term[first].tolist()), None], pa.string()),
                "docs": pa.array([*(doc[p].astype("<u4").tobytes() for p in parts), None], pa.binary()), "tf": pa.array([*(tf[p].astype("<u4").tobytes() for p in parts), None], pa.binary()),
                "n": [*(n[doc[p]].astype("<u4").tobytes() for p in parts), n.astype("<u4").tobytes()], "ids": pa.array([*[None] * len(parts), ids.copy()], pa.list_(pa.int64())),
            }
            block += 1
            for kept in (ids, lengths, hits, names):
                kept.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch, column in slices(batches, 1):
            texts = [t.translate(_FOLD) for t in text_bytes(column)]
            for a, b in groups(texts):
                bounds, starts, ends, hashes, buffer = scan_words(texts[a:b])
                if terms:
                    word, term = terms.find(hashes, starts, ends, np.frombuffer(buffer, np.uint8))
                elif known is None:  # too many terms to broadcast: every word goes on
                    word = np.arange(len(starts))
                    term = np.array([names.setdefault(buffer[s:e].decode(), len(names)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
                else:
                    word = term = np.zeros(0, np.int64)
                doc = np.searchsorted(bounds, word, "right") - 1 + len(ids)
                key, tf = np.unique(term.astype(np.int64) << 32 | doc, return_counts=True)
                hits.append((key >> 32, key & 0xFFFFFFFF, tf))
                ids.extend(batch.column(0)[a:b].to_pylist())
                lengths.append(np.diff(bounds))
                if len(ids) >= block_docs or sum(len(h[0]) for h in hits) >= BLOCK_HITS:
                    yield made()
        if ids:
            yield made()

    return run


def _best(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by falling score, then doc_id, nulls last."""
    return np.lexsort((ids, nulls, -scores))[:k]


def _stage(k: int, mean: tuple[int, int], last: bool) -> Callable:
    """Adds an owner's contributions to the accumulators of one bundle over one block."""
    documents, total = mean

    def run(gone_by: pa.Table, owned: pa.Table) -> pa.Table:
        acc: dict = {}
        for item, rest, docs, scores in zip(*(gone_by.column(c).to_pylist() for c in ("item", "rest", "docs", "scores")), strict=True):
            acc[item] = [rest, [np.frombuffer(docs, "<u4").astype(np.int64)], [np.frombuffer(scores, "<i8")]]
        ids = None
        for term, weight, items, rests, docs, tf, n, found in zip(*(owned.column(c).to_pylist() for c in ("term", "weight", "items", "rests", "docs", "tf", "n", "ids")), strict=True):
            if term is None:
                ids = found
                continue
            docs, tf, n = (np.frombuffer(x, "<u4").astype(np.int64) for x in (docs, tf, n))
            m = 100 - 90 + (90 * n * documents) // total
            gain = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            for item, rest in zip(items, rests, strict=True):
                own = acc.setdefault(item, [rest, [], []])
                own[0] = min(own[0], rest)
                own[1].append(docs)
                own[2].append(gain)
        out: dict[str, list] = {"item": [], "rest": [], "docs": [], "scores": []}
        if last:
            nulls = np.array([i is None for i in ids], np.bool_)
            values = np.array([i or 0 for i in ids], np.int64)
            out = {"item": [], "doc_id": [], "score": []}
        for item, (rest, places, gains) in acc.items():
            docs, back = np.unique(np.concatenate(places), return_inverse=True)
            scores = np.zeros(len(docs), np.int64)
            np.add.at(scores, back, np.concatenate(gains))
            if last:
                at = np.flatnonzero(scores > 0)
                at = at[_best(scores[at], values[docs[at]], nulls[docs[at]], k)]
                out["item"] += [item] * len(at)
                out["doc_id"] += [ids[i] for i in docs[at].tolist()]
                out["score"] += scores[at].tolist()
                continue
            if len(docs) > k:
                stay = scores + rest >= np.partition(scores, len(scores) - k)[len(scores) - k]
                docs, scores = docs[stay], scores[stay]
            for column, x in zip(out, (item, rest, docs.astype("<u4").tobytes(), scores.astype("<i8").tobytes()), strict=True):
                out[column].append(x)
        bundle, block = (t.column(c)[0].as_py() for t in [owned if owned.num_rows else gone_by] for c in ("bundle", "block"))
        kinds = {"item": pa.int64(), "rest": pa.int64(), "docs": pa.binary(), "scores": pa.binary(), "doc_id": pa.int64(), "score": pa.int64()}
        n = len(out["item"])
        return pa.table({"bundle": pa.array([bundle] * n, pa.int64()), "block": pa.array([block] * n, pa.int64())} | {c: pa.array(x, kinds[c]) for c, x in out.items()})

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, stages: int = STAGES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of docs(doc_id, text) for each item of items(item_id, text)."""
    spark = docs.sparkSession
    pairs = items.select(F.col("item_id").cast("long"), "text").mapInArrow(_item_terms, "item_id long, term string").distinct()
    pairs = materialize(pairs, "ranked-items")
    terms = pairs.select("term").distinct()
    few = terms.count() <= BROADCAST_TERMS
    known = spark.sparkContext.broadcast([r[0] for r in terms.collect()]) if few else None
    index = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_indexer(known, block_docs), INDEX)
    if not few:
        index = index.join(terms.withColumnRenamed("term", "asked"), F.col("term") == F.col("asked"), "left").filter("asked is not null or term is null").drop("asked")
    index = materialize(index, "ranked-index", "zstd")
    # Counts of the collection come from the heads: four bytes a document.
    heads = index.filter("term is null").select("n").mapInArrow(_counter, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, total = heads[0] or 0, heads[1] or 0
    df = index.filter("term is not null").groupBy("term").agg((F.sum(F.octet_length("docs")) / 4).cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    top = int(1000 * np.log((2 * documents + 2) / 3)) + 1
    weighed = df.select("term", weight.alias("weight")).withColumn("owner", F.greatest(F.lit(0), stages - 1 - F.floor(F.col("weight") * stages / top)).cast("int"))
    # One row for each item and term; `rest` is the most that an item's terms of later owners can add.
    bundles = max(1, -(-pairs.select("item_id").distinct().count() // BUNDLE_ITEMS))
    asked = pairs.join(weighed, "term").withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)))
    rest = F.coalesce(F.sum(F.col("weight") * MOST).over(Window.partitionBy("item_id").orderBy("owner").rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    asked = asked.withColumn("rest", rest).groupBy("bundle", "owner", "term", "weight").agg(F.collect_list(F.struct("item_id", "rest")).alias("by"))
    asked = materialize(asked.select("bundle", "owner", F.col("term").alias("asked"), "weight", F.col("by.item_id").alias("items"), F.col("by.rest").alias("rests")), "ranked-asked")
    small = asked.count() <= BROADCAST_ROWS
    acc = spark.createDataFrame([], "bundle long, block long, item long, rest long, docs binary, scores binary")
    for stage in range(stages):
        last = stage == stages - 1
        own = asked.filter(F.col("owner") == stage).drop("owner")
        owned = index.filter("term is not null").join(F.broadcast(own) if small else own, F.col("term") == F.col("asked")).select("bundle", "block", "term", "weight", "items", "rests", "docs", "tf", "n", "ids")
        if last:  # heads go wherever a bundle has something to select
            met = acc.select("bundle", "block").union(owned.select("bundle", "block")).distinct()
            head = index.filter("term is null").select("block", "ids").join(met, "block")
            owned = owned.unionByName(head.select("bundle", "block", "ids"), allowMissingColumns=True)
        schema = "bundle long, block long, item long, " + ("doc_id long, score long" if last else "rest long, docs binary, scores binary")
        acc = acc.groupBy("bundle", "block").cogroup(owned.groupBy("bundle", "block")).applyInArrow(_stage(k, (documents, max(1, total)), last), schema)
        acc = materialize(acc, f"ranked-acc{stage}")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return acc.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.frombuffer(x, "<u4") for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"documents": [sum(int((x > 0).sum()) for x in n)], "terms": [sum(int(x.sum()) for x in n)]})
