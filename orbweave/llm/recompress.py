"""Recompression: words are named, then rounds replace runs and pairs of neighbours by new symbols.

Names are hashes of what a symbol stands for, so all tasks name equal things equally without meeting. A round decides
about a symbol from its neighbours only; each symbol carries its support, the words that decided it. A window of words
holds the same symbols wherever it occurs, for every symbol whose support lies inside the window: if one of them occurs
in one document only, so does the window. Windows that no such symbol rules out are then compared themselves.

Defined cases: null, empty and short texts have no window and lose nothing; repeated rows of one doc_id have equal
doc_id, so neither removes words of the other; a null doc_id is kept whole; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packs import bucket_count, deal, joined, pack_rows, write_packs
from .textscan import U64, mix, scan_words, window_hash
from .workspace import materialize

#: Rounds of pair naming; each leaves about three quarters of the symbols.
PAIR_ROUNDS = 6
_RUN = U64(0x9E3779B97F4A7C15)
_FAR = 1 << 40


def parse(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, support start, support end) of the last round; a support that leaves its document is endless."""
    n = len(words)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    index = np.arange(n, dtype=np.int64)
    # Runs: equal neighbours of one document become one symbol, decided by the words on both sides.
    same = np.zeros(n, bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~same)
    count = np.diff(np.append(first, n))
    symbol = np.where(count > 1, mix(words[first] * _RUN + count.astype(U64)), words[first])
    doc = doc[first]
    inner_left = np.zeros(len(first), bool)
    inner_left[1:] = doc[1:] == doc[:-1]
    inner_right = np.zeros(len(first), bool)
    inner_right[:-1] = inner_left[1:]
    low = np.where(inner_left, first - 1, -_FAR)
    high = np.where(inner_right, first + count + 1, _FAR)
    # Pairs: a round splits all names into left and right ones; a left one before a right one is a pair.
    for r in range(PAIR_ROUNDS):
        m = len(symbol)
        if m < 2:
            break
        right = (mix(symbol + U64(r + 1)) & U64(1)).astype(bool)
        inner = np.zeros(m, bool)  # has a left neighbour in its document
        inner[1:] = doc[1:] == doc[:-1]
        second = np.zeros(m, bool)
        second[1:] = inner[1:] & right[1:] & ~right[:-1]
        opens = np.zeros(m, bool)
        opens[:-1] = second[1:]
        before_low, after_high = np.empty(m, np.int64), np.empty(m, np.int64)
        before_low[0], before_low[1:] = -_FAR, np.where(inner[1:], low[:-1], -_FAR)
        after_high[-1], after_high[:-1] = _FAR, np.where(inner[1:], high[1:], _FAR)
        next_low, next_high = np.append(low[1:], 0), np.append(high[1:], 0)
        prev_high, next_low_own = np.append(0, high[:-1]), np.append(low[1:], 0)
        alone_low = np.where(right, np.minimum(low, before_low), np.minimum(low, np.where(np.append(inner[1:], False), next_low_own, low)))
        alone_high = np.where(right, np.maximum(high, np.where(inner, prev_high, high)), np.maximum(high, after_high))
        new_low = np.where(opens, np.minimum(low, next_low), alone_low)
        new_high = np.where(opens, np.maximum(high, next_high), alone_high)
        name = np.where(opens, mix(symbol * _RUN + np.append(symbol[1:], U64(0)) + U64(r + 77)), symbol)
        keep = ~second
        symbol, low, high, doc = name[keep], new_low[keep], new_high[keep], doc[keep]
    return symbol, low, high


def _usable(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    return (high - low <= size) & (low >= 0) & (high < _FAR)


def _windows(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which word positions start a window inside their document."""
    ok = np.zeros(n, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            ok[a : b - size + 1] = True
    return ok


def _unique_symbols(symbol: np.ndarray, low: np.ndarray, high: np.ndarray, bounds: np.ndarray, size: int):
    """Distinct usable symbols and whether several documents of the pack hold them. The lowest bit of a name is free."""
    use = _usable(low, high, size)
    names = symbol[use] | U64(1)
    doc = np.searchsorted(bounds, low[use], "right")
    order = np.lexsort((doc, names))
    names, doc = names[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(names)) - 1
    return names[first], doc[last] > doc[first] if len(first) else np.zeros(0, bool)


def _ask_symbols(size: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, _, texts, _ in pack_rows(batches):
            bounds, _, _, words, _ = scan_words(texts)
            names, several = _unique_symbols(*parse(words, bounds), bounds, size)
            names = (names & ~U64(1)) | several.astype(U64)
            order, where, cut = deal(names >> U64(1), buckets)
            names = names[order]
            yield pa.RecordBatch.from_pydict({"pack": pa.array([pack] * len(where), pa.int64()), "bucket": where, "keys": pa.array([names[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return run


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _shared_symbols(table: pa.Table) -> pa.Table:
    """Answers every pack of a bucket with those of its symbols that two documents hold."""
    packs, keys = _column(table, "pack"), [np.frombuffer(x, U64) for x in _column(table, "keys")]
    flat = np.concatenate(keys)
    source = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    names = flat | U64(1)
    _, back, count = np.unique(names, return_inverse=True, return_counts=True)
    several = np.zeros(len(count), bool)
    several[back[(flat & U64(1)).astype(bool)]] = True
    shared = (several | (count > 1))[back]
    names, source = names[shared], source[shared]
    cut = np.searchsorted(source, np.arange(len(keys) + 1))
    rows = [(packs[i], names[cut[i] : cut[i + 1]].tobytes()) for i in range(len(keys)) if cut[i + 1] > cut[i]]
    return pa.table({"pack": pa.array([r[0] for r in rows], pa.int64()), "answer": pa.array([r[1] for r in rows], pa.binary())})


def _hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return window_hash(words, size, 0x5851F42D4C957F2D), window_hash(mix(words + U64(5)), size, 0x2545F4914F6CDD1D)


def _ask_windows(size: int, buckets: int) -> Callable:
    """Distinct windows of a pack that no unshared symbol rules out, each with the smallest doc_id that holds it here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, ids, texts, answers in pack_rows(batches):
            bounds, _, _, words, _ = scan_words(texts)
            n = len(words)
            symbol, low, high = parse(words, bounds)
            use = _usable(low, high, size)
            shared = np.sort(np.concatenate([np.frombuffer(x, U64) for x in answers])) if answers else np.zeros(0, U64)
            names = symbol | U64(1)
            at = np.searchsorted(shared, names)
            known = np.zeros(len(names), bool)
            known[at < len(shared)] = shared[at[at < len(shared)]] == names[at < len(shared)]
            out = use & ~known
            change = np.zeros(n + size + 2, np.int64)  # windows from high - size to low hold the symbol's support
            np.add.at(change, np.maximum(high[out] - size, 0), 1)
            np.add.at(change, low[out] + 1, -1)
            start = np.flatnonzero(_windows(bounds, size, n) & (np.cumsum(change)[:n] == 0))
            if not len(start):
                continue
            one, two = _hashes(words, size)
            one, two = one[start], two[start]
            doc = np.array([np.iinfo(np.int64).max if x is None else x for x in ids])[np.searchsorted(bounds, start, "right") - 1]
            order = np.lexsort((doc, two, one))
            one, two, doc = one[order], two[order], doc[order]
            first = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            one, two, doc = one[first], two[first], doc[first]
            order, where, cut = deal(one, buckets)
            one, two, doc = one[order], (two[order] >> U64(32)).astype(np.uint32), doc[order]
            slices = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            base = int(doc.min())
            wide = doc - base
            wide = wide.astype(np.uint32) if wide.max() < 1 << 32 else wide
            yield pa.RecordBatch.from_pydict(
                {"pack": pa.array([pack] * len(where), pa.int64()), "bucket": where, "base": pa.array([base] * len(where), pa.int64())}
                | {name: pa.array([x[a:b].tobytes() for a, b in slices], pa.binary()) for name, x in (("one", one), ("two", two), ("doc", wide))}
            )

    return run


def _earlier_windows(table: pa.Table) -> pa.Table:
    """Answers a pack with those of its windows that start in a document before all its own."""
    packs, base = _column(table, "pack"), _column(table, "base")
    one = [np.frombuffer(x, U64) for x in _column(table, "one")]
    two = [np.frombuffer(x, np.uint32) for x in _column(table, "two")]
    doc = [np.frombuffer(x, np.uint32 if len(x) == 4 * len(y) else np.int64).astype(np.int64) + b for x, y, b in zip(_column(table, "doc"), one, base, strict=True)]
    source = np.repeat(np.arange(len(one)), [len(x) for x in one])
    one, two, doc = np.concatenate(one), np.concatenate(two), np.concatenate(doc)
    order = np.lexsort((doc, two, one))
    a, b, d, source = one[order], two[order], doc[order], source[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
    late = least < d
    a, source = a[late], source[late]
    order = np.argsort(source, kind="stable")
    a, source = a[order], source[order]
    cut = np.searchsorted(source, np.arange(len(packs) + 1))
    rows = [(packs[i], a[cut[i] : cut[i + 1]].tobytes()) for i in range(len(packs)) if cut[i + 1] > cut[i]]
    return pa.table({"pack": pa.array([r[0] for r in rows], pa.int64()), "answer": pa.array([r[1] for r in rows], pa.binary())})


def _remover(size: int, texts_too: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, answers in pack_rows(batches):
            bounds, starts, ends, words, buffer = scan_words(texts)
            n = len(words)
            start = np.flatnonzero(_windows(bounds, size, n))
            covered = np.zeros(n + 1, np.int64)
            if len(start):
                one, two = _hashes(words, size)
                one, two = one[start], two[start]
                doc = np.array([-1 if x is None else x for x in ids])[np.searchsorted(bounds, start, "right") - 1]
                known = np.array([x is not None for x in ids])[np.searchsorted(bounds, start, "right") - 1]
                earlier = np.unique(np.concatenate([np.frombuffer(x, U64) for x in answers])) if answers else np.zeros(0, U64)
                hit = np.isin(one, earlier)
                order = np.lexsort((np.where(known, doc, np.iinfo(np.int64).max), two, one))
                a, b, d = one[order], two[order], doc[order]
                first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
                hit[order[least < d]] = True
                hit &= known
                np.add.at(covered, start[hit], 1)
                np.add.at(covered, start[hit] + size, -1)
            gone = np.cumsum(covered)[:n] > 0
            out: dict[str, list] = {"doc_id": ids, "n_words": [], "n_removed": [], "kept_sha256": [], "kept": [], "text_sha1": []}
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                left = np.flatnonzero(~gone[a:b]) + a
                out["n_words"].append(b - a)
                out["n_removed"].append(b - a - len(left))
                if len(left) == b - a:
                    words_left = b" ".join(buffer[starts[a] : ends[b - 1]].split()) if b > a else b""
                    out["kept"].append(texts[len(out["kept"])])
                else:
                    words_left = b" ".join([buffer[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])
                    out["kept"].append(words_left)
                out["kept_sha256"].append(hashlib.sha256(words_left).hexdigest())
            if not texts_too:
                del out["kept"], out["text_sha1"]
            else:
                out["text_sha1"] = pa.array([hashlib.sha1(t).digest() for t in texts], pa.binary())
                out["kept"] = pa.array(out["kept"], pa.binary()).cast(pa.string())
            out["doc_id"] = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return run


def without_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """docs, all columns, with the words that drop_repeats keeps as text, and n_chars, where there is one, following it."""
    found = drop_repeats(docs, size).filter("n_removed > 0").select("doc_id", "text_sha1", "kept")
    found = materialize(found, "repeats").dropDuplicates(["doc_id", "text_sha1"])
    # The documents travel in one column, so no name of theirs can meet a name of the other side.
    whole = docs.select(F.struct("*").alias("row"))
    same = (F.col("row.doc_id") == F.col("doc_id")) & (F.unhex(F.sha1(F.coalesce("row.text", F.lit("")))) == F.col("text_sha1"))
    out = whole.join(found, same, "left")
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns["text"] = F.coalesce("kept", columns["text"])
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("kept").isNull(), columns["n_chars"]).otherwise(F.char_length("kept").cast(kind))
    return out.select(*(v.alias(c) for c, v in columns.items()))


def drop_repeats(docs: DataFrame, size: int = 50, texts_too: bool = True) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256 (of its remaining words, one space between),
    and with texts_too kept (those words where some were removed, else the text as it was) and the text's text_sha1.

    A word goes if a window of `size` words that covers it also starts in a document with a smaller doc_id.
    """
    packs = write_packs(docs)
    total = packs.agg(F.sum("n_words")).first()[0] or 0
    buckets = bucket_count(total // 8)
    bare = packs.select("pack", "ids", "lengths", "blob")
    asked = bare.mapInArrow(_ask_symbols(size, buckets), "pack long, bucket long, keys binary")
    shared = materialize(asked.groupBy("bucket").applyInArrow(_shared_symbols, "pack long, answer binary"), "shared-symbols", "none")
    asked = joined(packs, shared).mapInArrow(_ask_windows(size, bucket_count(total // 3)), "pack long, bucket long, base long, one binary, two binary, doc binary")
    earlier = asked.groupBy("bucket").applyInArrow(_earlier_windows, "pack long, answer binary")
    return joined(packs, earlier).mapInArrow(_remover(size, texts_too), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, text_sha1 binary" * texts_too)
