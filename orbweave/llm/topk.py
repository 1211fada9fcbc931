"""Exact top-k inner product search by block-at-a-time pruning.

Vectors are dealt into document ranges ordered by a coarse direction, then vec_id. Ranges are cut into blocks with the
largest and smallest value of each term (dimension); neighbouring blocks lie in one tile, their forward index. A query
takes the blocks of the whole table in the order of their bounds, the sums of what each term can add at most: the first
FIRST in one round, GROWTH times as many in the next. Its k-th score goes on from round to round, and it ends when the
next bound is below that; equal bounds are still scored, so ties are never lost. Only the maxima meet every query; a tile
meets the queries that still want one of its blocks.

Defined cases: vectors that are null, hold null or non-finite components, or have a null vec_id take no part; so do finite
ones whose 256-fold is beyond doubles; a score beyond 64 bits counts as the limit it passes; only vectors of one length
meet; ties go to the smaller vec_id; a repeated vec_id is one query (the shortest vector, then the first in the order of
its bytes), its rows are candidates of their own, and a query never meets its own vec_id; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .workspace import materialize

#: Rows of a block, most blocks and bytes (as doubles) of a tile.
BLOCK, TILE_BLOCKS, TILE_BYTES = 128, 64, 1 << 22
#: Queries that meet a tile or the maxima at a time; tiles whose maxima they meet at a time; rows of a range, about.
QUERY_ROWS, MAXIMA_TILES, RANGE_ROWS = 2048, 64, 1 << 17
#: Blocks of the first round, and how many times more each next round takes.
FIRST, GROWTH = 8, 8
#: The largest score.
LIMIT = (1 << 63) - 1


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 (integers) or 8 bytes (doubles) that holds them."""
    most = np.abs(x).max()
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8").tobytes()


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(b, {2: "<i2", 4: "<i4", 8: "<f8"}[len(b) // dim]) for b in column.to_pylist()], float).reshape(-1, dim)


def _quantize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out, dims, way = [], [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or v is None or not v or any(x is None for x in v):
                continue
            with np.errstate(over="ignore"):
                x = np.floor(256 * np.array(v, np.float64))
            if not np.isfinite(x).all():
                continue
            top = int(np.abs(x).argmax())
            ids.append(i)
            out.append(_packed(x))
            dims.append(len(x))
            way.append(2 * top + (x[top] < 0))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int64()), pa.array(way, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "dim", "way", "v"])


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of rows (vec_id, dim, v) that come sorted: numbers, ids and values of all rows, maxima and minima of blocks."""
    number = TaskContext.get().partitionId() << 32
    kept: list[tuple[int, np.ndarray]] = []

    def made(dim: int) -> pa.RecordBatch:
        nonlocal number
        rows = np.array([r for _, r in kept])
        edges = range(0, len(rows), BLOCK)
        ends = [np.array([f(rows[e : e + BLOCK], axis=0) for e in edges]).astype("<f8").tobytes() for f in (np.max, np.min)]
        out = {"tile": [number], "dim": [dim], "ids": [np.array([i for i, _ in kept], "<i8").tobytes()], "v": [_packed(rows)], "high": ends[:1], "low": ends[1:]}
        number += 1
        kept.clear()
        return pa.RecordBatch.from_pydict(out)

    for batch in batches:
        for i, dim, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if kept and (len(kept[0][1]) != dim or len(kept) >= BLOCK * min(TILE_BLOCKS, max(1, TILE_BYTES // (8 * dim * BLOCK)))):
                yield made(len(kept[0][1]))
            kept.append((i, np.frombuffer(v, {2: "<i2", 4: "<i4", 8: "<f8"}[len(v) // dim]).astype(float)))
    if kept:
        yield made(len(kept[0][1]))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; doubles hold them below 2**53, else Python integers do."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(exact(a).dot(exact(b).T), -LIMIT - 1, LIMIT).astype(np.int64)


def next_blocks(bounds: np.ndarray, blocks: np.ndarray, floor: int | None, last: tuple[int, int] | None, most: int) -> np.ndarray:
    """Places of the next blocks of a query, at most so many: by falling bound, then block, after `last`, none below the floor."""
    go = np.ones(len(bounds), bool) if floor is None else bounds >= floor
    if last is not None:
        go &= (bounds < last[0]) | ((bounds == last[0]) & (blocks > last[1]))
    at = np.flatnonzero(go)
    # The complement reverses the order of all 64-bit integers.
    return at[np.lexsort((blocks[at], ~bounds[at]))[:most]]


def _bounder(most: int) -> Callable:
    def run(maxima: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [])
        if maxima.num_rows and queries.num_rows:
            dim = maxima.column("dim")[0].as_py()
            high, low = (np.frombuffer(b"".join(maxima.column(c).to_pylist()), "<f8").reshape(-1, dim) for c in ("high", "low"))
            blocks = np.concatenate([t * TILE_BLOCKS + np.arange(len(b) // (8 * dim)) for t, b in zip(maxima.column("tile").to_pylist(), maxima.column("high").to_pylist(), strict=True)])
            q = _matrix(queries.column("v"), dim)
            bounds = _scores(np.hstack((np.maximum(q, 0), np.minimum(q, 0))), np.hstack((high, low)))
            state = zip(*(queries.column(c).to_pylist() for c in ("query_id", "floor", "last")), strict=True)
            for line, (i, floor, last) in zip(bounds, state, strict=True):
                at = next_blocks(line, blocks, floor, last and (last["bound"], last["block"]), most)
                for column, x in zip(out, (np.full(len(at), i), blocks[at], line[at]), strict=True):
                    column.append(x)
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(("query_id", "block", "bound"), out, strict=True)})

    return run


def search_blocks(queries: np.ndarray, query_ids: list[int], wanted: list[list[tuple[int, int]]], floors: list[int | None], rows: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Best k (score, vec_id), none below its floor, of each query in its wanted blocks (bound, number) of the rows."""
    order = [sorted(w, key=lambda x: (-x[0], x[1])) for w in wanted]
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    floor = list(floors)
    live = list(range(len(query_ids)))
    step = 0
    while live := [q for q in live if step < len(order[q]) and (floor[q] is None or order[q][step][0] >= floor[q])]:
        own: dict[int, list[int]] = {}
        for q in live:
            own.setdefault(order[q][step][1], []).append(q)
        for b, qs in own.items():
            names = ids[b * BLOCK : (b + 1) * BLOCK]
            for q, line in zip(qs, _scores(queries[qs], rows[b * BLOCK : (b + 1) * BLOCK]), strict=True):
                near = (np.arange(len(line)) if floor[q] is None else np.flatnonzero(line >= floor[q])).tolist()
                if near:
                    best[q] = sorted(best[q] + [(-int(line[j]), int(names[j])) for j in near if names[j] != query_ids[q]])[:k]
                if len(best[q]) == k:
                    floor[q] = -best[q][-1][0]
        step += 1
    return [[(-s, i) for s, i in b] for b in best]


def _meeter(k: int) -> Callable:
    def run(tiles: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], []]
        if tiles.num_rows and queries.num_rows:
            dim, tile = tiles.column("dim")[0].as_py(), tiles.column("tile")[0].as_py()
            ids = np.frombuffer(tiles.column("ids")[0].as_py(), "<i8")
            v = tiles.column("v")[0].as_py()
            rows = np.frombuffer(v, {2: "<i2", 4: "<i4", 8: "<f8"}[len(v) // (dim * len(ids))]).astype(float).reshape(-1, dim)
            query_ids = queries.column("query_id").to_pylist()
            wanted = [[(w["bound"], w["block"] - tile * TILE_BLOCKS) for w in ws] for ws in queries.column("wanted").to_pylist()]
            found = search_blocks(_matrix(queries.column("v"), dim), query_ids, wanted, queries.column("floor").to_pylist(), rows, ids, k)
            for q, best in zip(query_ids, found, strict=True):
                for score, i in best:
                    for column, x in zip(out, (q, i, score), strict=True):
                        column.append(x)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of vectors(vec_id, embedding): the k best other rows of each query row."""
    spark = vectors.sparkSession
    made = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_quantize, "vec_id long, dim long, way long, v binary")
    made = materialize(made.withColumn("place", F.monotonically_increasing_id()), "topk-vectors")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made.count() // RANGE_ROWS))
    order = ["dim", "way", "vec_id", "place"]
    tiles = made.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("vec_id", "dim", "v")
    tiles = materialize(tiles.mapInArrow(_tile, "tile long, dim long, ids binary, v binary, high binary, low binary"), "topk-tiles")
    asked = made.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("dim", "v")).alias("one")).select("query_id", "one.*")
    asked = materialize(asked, "topk-queries")
    chunks, parts = max(1, -(-asked.count() // QUERY_ROWS)), max(1, -(-tiles.count() // MAXIMA_TILES))
    asked = asked.withColumn("c", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    asked = asked.withColumn("floor", F.lit(None).cast("long")).withColumn("last", F.lit(None).cast("struct<bound:long,block:long>"))
    # Of each range of tiles only the maxima meet all queries.
    maxima = tiles.select("tile", "dim", "high", "low", F.pmod(F.xxhash64("tile"), F.lit(parts)).alias("m"))
    maxima = maxima.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    best, most = None, FIRST
    while True:
        everywhere = asked.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        keys = ["m", "c", "dim"]
        wanted = maxima.groupBy(*keys).cogroup(everywhere.groupBy(*keys)).applyInArrow(_bounder(most), "query_id long, block long, bound long")
        wanted = materialize(wanted.withColumn("at", F.row_number().over(by_bound)).filter(F.col("at") <= most), "topk-wanted")
        of_tile = wanted.groupBy("query_id", F.expr(f"block div {TILE_BLOCKS}").alias("tile")).agg(F.collect_list(F.struct("bound", "block")).alias("wanted"))
        of_tile = of_tile.join(asked.select("query_id", "v", "c", "floor"), "query_id")
        forward = tiles.select("tile", "dim", "ids", "v").join(of_tile.select("tile", F.col("c").alias("with")).distinct(), "tile")
        found = forward.groupBy("tile", "with").cogroup(of_tile.groupBy("tile", "c")).applyInArrow(_meeter(k), FOUND)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = materialize(found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k), "topk-best")
        floors = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        # A query that got fewer blocks than it could take has no other with a bound as high as its k-th score.
        last = wanted.filter(F.col("at") == most).select("query_id", F.struct("bound", "block").alias("last"))
        asked = materialize(asked.drop("floor", "last").join(last, "query_id").join(floors, "query_id", "left").select("query_id", "dim", "v", "c", "floor", "last"), "topk-asked")
        if asked.isEmpty():
            return best.select("query_id", "rank", "vec_id", "score")
        most *= GROWTH
