"""Vectorized scanning of whole texts inside Arrow batches: words, word hashes and windows as numpy arrays."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are scanned in groups of about this many bytes, so memory follows the longest text and not the batch.
GROUP_BYTES = 1 << 20

_rng = np.random.default_rng(20240613)
_WEIGHTS = _rng.integers(1, 1 << 63, size=(2, 1 << 14), dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SPACE = np.zeros(256, np.bool_)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every row; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], at: int, limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their text column) in pieces of about `limit` text bytes (one row at least); freed memory goes back at the end."""
    for batch in batches:
        column = batch.column(at)
        if pa.types.is_null(column.type):
            column = column.cast(pa.string())
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < len(size):
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(start, stop - start), column.slice(start, stop - start)
            start = stop
        del batch, column
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, for workers that Spark uses again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `limit` bytes together (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def scan_words(texts: list[bytes], second: bool = False):
    """(bounds, starts, ends, hash[, hash2], buffer): words of text i are bounds[i]:bounds[i+1] in the word arrays.

    A word is a longest run of bytes outside 0x20 and 0x09-0x0D. Its hash is multilinear in its bytes and length.
    """
    buffer = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(buffer, np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    bounds = np.searchsorted(starts, offsets)
    hashes = []
    if len(starts):
        length = ends - starts
        begin = np.zeros(len(starts), np.int64)
        np.cumsum(length[:-1], out=begin[1:])
        flat = buf[~space].astype(U64) + U64(1)
        place = np.arange(len(flat)) - np.repeat(begin, length)
        # Weights repeat after so many bytes; from there on they are mixed with the number of the repetition.
        over = place >> 14 if length.max() > 1 << 14 else None
        place &= (1 << 14) - 1
        for k in range(1 + second):
            weights = _WEIGHTS[k][place]
            if over is not None:
                weights = np.where(over > 0, mix(weights + over.astype(U64)) | U64(1), weights)
            hashes.append(mix(np.add.reduceat(flat * weights, begin) + length.astype(U64)))
    else:
        hashes = [np.zeros(0, U64)] * (1 + second)
    return bounds, starts, ends, *hashes, buffer


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


def window_hash(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of every run of `size` consecutive values."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(size) if size <= 8 else ():
        out = out * U64(base) + words[j : j + n]
    if size > 8:
        total = np.zeros(len(words) + 1, U64)
        np.cumsum(words * powers(base, len(words)), out=total[1:])
        inverse = pow(base, -1, 1 << 64)
        out = (total[size:] - total[:-size]) * powers(inverse, n)
    return mix(out)


def ragged(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, np.int32)), pa.array(values, kind))
