"""BPE encoding with content-defined chunks: texts that share a chunk share its encoding.

A rolling hash of the last eight bytes picks cut places, so equal passages have equal chunks wherever they stand. Spark
brings texts with the same opening together (rebalanced, so that a hot opening is spread), and a task encodes each
distinct chunk once. A chunk that starts at a space between two letters starts a pre-token in every context, so its ids
join as they are. Other joins are repaired: the text between the nearest such places on both sides is encoded again.

Defined cases: null counts as empty text (no ids); special tokens in a text are recognized, as by the library; repeated
rows and null doc_ids come back once per row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .subwords import ByteBpe, byte_bpe, default_tokenizer
from .textscan import U64, groups, mix, slices, text_bytes

#: One in so many possible places is a cut; a chunk has at most MOST_BYTES.
CUT_ODDS, MOST_BYTES = 64, 4096
#: Bytes of chunks and their ids that a task keeps; beyond it the table starts anew.
KEPT_BYTES = 48 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def safe_places(buf: np.ndarray) -> np.ndarray:
    """Places of a space between two ASCII letters: a pre-token starts there whatever stands around."""
    if len(buf) < 3:
        return np.zeros(0, np.int64)
    return np.flatnonzero((buf[1:-1] == 32) & _LETTER[buf[:-2]] & _LETTER[buf[2:]]) + 1


def cuts(buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Chunk starts after 0, from the content before them only; then more where a chunk would be too long."""
    late = places[places >= 8]
    rolled = np.zeros(len(late), U64)
    for j in range(8):
        rolled = (rolled << U64(8)) | buf[late - 1 - j].astype(U64)
    found = late[mix(rolled) % U64(CUT_ODDS) == 0]
    edges = np.concatenate(([0], found, [len(buf)]))
    wide = np.flatnonzero(np.diff(edges) > MOST_BYTES)
    if not len(wide):
        return found
    more = []
    for i in wide.tolist():
        at, end = int(edges[i]), int(edges[i + 1])
        while end - at > MOST_BYTES:
            at += MOST_BYTES
            while at > edges[i] and buf[at] & 0xC0 == 0x80:  # not inside a character
                at -= 1
            more.append(at)
    return np.sort(np.concatenate((found, more))).astype(np.int64)


def _join_repaired(bpe: ByteBpe, data: bytes, starts: np.ndarray, safe: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """Ids of the whole text from the ids of its chunks: joins at unsafe places are encoded again between safe ones."""
    ends = np.append(starts[1:], len(data))
    out, done, i = [], 0, 0
    while i < len(starts):
        last = i
        while last + 1 < len(starts):
            k = np.searchsorted(safe, starts[last + 1])
            if k < len(safe) and safe[k] == starts[last + 1]:
                break
            last += 1
        if last == i:
            out.append(ids[i])
        else:
            a, b = int(starts[i]), int(ends[last])
            inside = safe[(safe > a) & (safe < b)]
            at = a
            for j in range(i, last):  # the join before chunk j + 1
                join = int(starts[j + 1])
                if join < at:
                    continue
                before, after = inside[(inside < join) & (inside >= max(at, int(starts[j])))], inside[inside > join]
                left, right = int(before[-1]) if len(before) else at, int(after[0]) if len(after) else b
                if left > at:
                    out.append(_between(bpe, data, ids, starts, ends, at, left))
                out.append(bpe.plain(data[left:right].decode()))
                at = right
            if at < b:
                out.append(_between(bpe, data, ids, starts, ends, at, b))
        done, i = int(ends[last]), last + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _between(bpe: ByteBpe, data: bytes, ids: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> np.ndarray:
    """Ids of data[a:b], both of them safe places or text ends; taken from one chunk's ids where one holds them."""
    k = int(np.searchsorted(starts, a, "right")) - 1
    if b > ends[k]:
        return bpe.plain(data[a:b].decode())
    edge = np.concatenate(([0], np.cumsum(bpe.width[ids[k]]))) + starts[k]
    return ids[k][np.searchsorted(edge, a) : np.searchsorted(edge, b)]


class ChunkEncoder:
    """Encodes texts by chunks and keeps the ids of chunks that it has met."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.kept, self.size = bpe, {}, 0
        names = sorted((n.encode() for n in bpe.special), key=len, reverse=True)
        self.marks = re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None

    def _chunk(self, data: bytes) -> np.ndarray:
        found = self.kept.get(data)
        if found is None:
            found = self.bpe.plain(data.decode())
            self.size += len(data) + found.nbytes + 200
            if self.size > KEPT_BYTES:
                self.kept, self.size = {}, 0
            self.kept[data] = found
        return found

    def _part(self, data: bytes) -> np.ndarray:
        if not data:
            return np.zeros(0, np.uint32)
        buf = np.frombuffer(data, np.uint8)
        safe = safe_places(buf)
        inner = cuts(buf, safe)
        edges = [0, *inner.tolist(), len(data)]
        ids = [self._chunk(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if len(ids) == 1:
            return ids[0]
        if len(np.setdiff1d(inner, safe, assume_unique=True)) == 0:
            return np.concatenate(ids)
        return _join_repaired(self.bpe, data, np.array(edges[:-1]), safe, ids)

    def encode(self, data: bytes) -> np.ndarray:
        """Ids (uint32) of a whole UTF-8 text."""
        if self.marks is None or not self.marks.search(data):
            return self._part(data)
        # Parts and special tokens take turns.
        parts = self.marks.split(data)
        return np.concatenate([np.array([self.bpe.special[p.decode()]], np.uint32) if i % 2 else self._part(p) for i, p in enumerate(parts)])


def _coder(path: str, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        encoder = ChunkEncoder(bpe)
        for batch, column in slices(batches, 1, 1 << 22):
            texts = text_bytes(column)
            for a, b in groups(texts, 1 << 22):
                ids = [encoder.encode(t) for t in texts[a:b]]
                raw = [x.astype("<u4").tobytes() for x in ids]
                out = {
                    "doc_id": batch.column(0)[a:b], "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
                }
                if keep_ids:
                    out["ids"] = pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return run


def encode_documents(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids the ids, 4 bytes each."""
    opening = F.xxhash64(F.substring("text", 1, 64))
    near = docs.select(F.col("doc_id").cast("long"), "text").withColumn("opening", opening).hint("rebalance", "opening")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return near.select("doc_id", "text").mapInArrow(_coder(tokenizer or default_tokenizer(), keep_ids), schema)
