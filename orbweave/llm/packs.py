"""Packs of documents, and the exchange of packed keys between packs.

A pack holds the whole texts of some rows (about PACK_BYTES, one row at least), compressed. Keys that must be compared
across the corpus (symbols, windows, words) leave a pack once each, as numpy arrays dealt by key into buckets; a bucket
sees all packs that hold a key and answers them. A key of a third of all rows therefore counts once per pack, and a
shuffle row carries many keys.

Defined cases: a null text is packed as empty; null and repeated doc_ids are packed row by row; a text longer than a pack is
a pack of its own; other columns are left out; an empty table has no packs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .textscan import U64, groups, slices, text_bytes
from .workspace import materialize

PACK_BYTES = 1 << 20
#: Keys that a bucket gets on average; the number of buckets grows with the corpus.
BUCKET_KEYS = 250_000
LEAST_BUCKETS = 12
PACKS = "pack long, n_bytes long, n_words long, ids array<long>, lengths array<long>, blob binary"


def dealt_texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list[bytes]]]:
    """(pack, ids, texts) of every pack of rows (doc_id, text).

    A pack is named by its task and its number there: what is made of packs is written once, so no two have one name.
    """
    key = TaskContext.get().partitionId() << 32
    for batch, column in slices(batches, 1, size):
        texts = text_bytes(column)
        for a, b in groups(texts, size):
            key += 1
            yield key, batch.column(0)[a:b].to_pylist(), texts[a:b]


def _packer(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for key, ids, texts in dealt_texts(batches, size):
            yield pa.RecordBatch.from_pydict(
                {"pack": pa.array([key], pa.int64()), "n_bytes": [sum(map(len, texts))], "n_words": [sum(len(t.split()) for t in texts)], "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": [[len(t) for t in texts]], "blob": [zip_.compress(b"".join(texts))]}
            )

    return run


def write_packs(docs: DataFrame, size: int = PACK_BYTES) -> DataFrame:
    """docs(doc_id, text) as packs in shared storage."""
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packer(size), PACKS)
    return materialize(made, "packs", "none")


def unpack(blob: bytes, lengths: list[int]) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def bucket_count(keys: int) -> int:
    return max(LEAST_BUCKETS, -(-keys // BUCKET_KEYS))


def deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket numbers, bounds): keys[order] lie bucket by bucket, sorted by key inside each."""
    order = np.lexsort((keys, keys % U64(buckets)))
    where = (keys[order] % U64(buckets)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(where) else np.zeros(0, np.int64)
    return order, where[first], np.concatenate((first, [len(where)])).astype(np.int64)


def answered(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of packs with the list of what the buckets answered them (null: nothing); an answer goes only to packs that asked."""
    return packs.join(answers.groupBy("pack").agg(F.collect_list("answer").alias("answers")), "pack", "left")


def joined(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """Whole packs with their answers."""
    return answered(packs.select("pack", "ids", "lengths", "blob"), answers)


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], list[bytes]]]:
    """(pack, ids, texts, answers) of every row that joined() made."""
    for batch in batches:
        for i in range(batch.num_rows):
            pack, ids, lengths, blob = (batch.column(c)[i].as_py() for c in range(4))
            answers = (batch.column(4)[i].as_py() or []) if batch.num_columns > 4 else []
            yield pack, ids, unpack(blob, lengths), answers
