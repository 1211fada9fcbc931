"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells, components of links.

Equal vectors are one class with its count. Classes lie in the cell of their nearest center and also visit the cells whose
border is near enough for the middle between them and a linking partner to lie beyond it: both partners visit the cell of
that middle. Each visit keeps which cells of a lower number its class visits too, and a pair counts only where it has no such
cell in common, so no pair is counted twice. Cells are dealt once: the tree of centers goes to the classes, which
send 16 bits a component to each cell; cells that are too many for one task are split by centers of their own, or
meet block by block. A task splits its cell again and again in memory. In a cell, classes within half the angle of the
threshold of the center (the core) all link, which is counted without a product, so a tight group costs its size and not
its square; the rest is multiplied in slices. Cosines nearer to the threshold than 16 bits can tell are settled on the
vectors themselves. A task gives its links to the star rounds as about one edge for a row.

How near a border must be: a vector and the middle between it and its partner differ by half a chord; along the line between two
centers they differ by at most the sine of half the angle (nothing is ever lost with that width), and by half a chord /
sqrt(dimensions) on average if their difference has no preferred direction. `spread` times the latter is taken, never more than
the former, so up to spread ** 2 dimensions the search is exact. Centers are fitted on a sample of about SAMPLE classes of a
cell; every class is assigned.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components link with nothing, are their own
component and kept; a null vec_id comes back with 0 links, a null component and not kept; rows of one vec_id are vectors of their own that share one
component node; only vectors of one length meet; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .minhash import components
from .workspace import materialize

#: Classes that a cell may hold before it is split; children of a cell that one task can hold, and at most; classes that fit their centers, about.
CELL_ROWS, CHILDREN, MOST, SAMPLE, LEVELS = 2048, 64, 256, 8192, 8
#: Classes that are dealt to centers at a time; classes of a cell that one task holds, about.
CHUNK_ROWS, BLOCK_ROWS = 16384, 1 << 20
#: Cosines of one slice of a product; up to so many vectors are broadcast to be settled.
SLICE, BROADCAST_ROWS = 1 << 19, 1 << 19
#: Centers nearer than this cosine become one; a cell stays whole if splitting leaves more than this share of its products.
ONE_CENTER, SAVES = 0.9, 0.8
#: What a task finds: links of a class (num, links), an edge (rep, rep), two classes whose cosine has to be settled (num, num).
LINKS, EDGE, UNSURE = 0, 1, 2


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of the vectors of each length that can link; zeros have one sign."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        x = flat[starts[at][:, None] + np.arange(d)] + 0.0
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        yield at[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by the largest component first, so no square is beyond doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(x: np.ndarray) -> list[bytes]:
    """Equal vectors have equal keys."""
    return [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x.astype("<f8")]


def _shortened(top: np.ndarray, short: np.ndarray) -> np.ndarray:
    return short.astype(np.float32) * (top / np.float32(32767))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as a key and as unit vectors in few bytes: the largest component, what this form is off at the most, all components in 16 bits."""
    for batch in batches:
        key, q, dims = [None] * batch.num_rows, [None] * batch.num_rows, np.zeros(batch.num_rows, np.int32)
        for at, x in _matrices(batch.column(1)):
            u = _unit(x)
            top = np.abs(u).max(axis=1).astype("<f4")
            short = np.rint(u / top[:, None] * 32767).astype("<i2")
            off = (np.linalg.norm(u - _shortened(top[:, None], short), axis=1) * 1.0001).astype("<f4")
            dims[at] = x.shape[1]
            for i, k, t, e, s in zip(at.tolist(), _keys(x), top, off, short, strict=True):
                key[i], q[i] = k, t.tobytes() + e.tobytes() + s.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), pa.array(key, pa.binary()), pa.array(q, pa.binary())], names=["vec_id", "dim", "key", "q"])


def _whole_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, unit) of the vectors, the unit vector in doubles."""
    for batch in batches:
        for _, x in _matrices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(_keys(x), pa.binary()), pa.array([u.tobytes() for u in _unit(x).astype("<f8")], pa.binary())], names=["key", "unit"])


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary values of one length as rows, without an object for each."""
    joined = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8) if joined.buffers()[2] else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]].reshape(len(joined), -1 if ends[-1] > ends[0] else 0)


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Packed vectors of one length as rows of floats."""
    x = _bytes(column)
    return _shortened(x[:, :4].copy().view("<f4"), x[:, 8:].copy().view("<i2"))


def _slack(dim: int) -> float:
    """How far a cosine of two vectors in 16 bits and floats can be off."""
    return 2.1 * math.sqrt(dim) / 65534 + 3e-7 * dim


def fit_centers(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centers of unit rows: spherical k-means, centers nearer than ONE_CENTER made one."""
    rng = np.random.default_rng(len(x))
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        member = (x @ centers.T).argmax(axis=1) == np.arange(len(centers))[:, None]
        weight, total = member.sum(axis=1), member.astype(x.dtype) @ x
        size = np.linalg.norm(total, axis=1)
        centers = total[size > 0][np.argsort(-weight[size > 0], kind="stable")]
        centers /= np.linalg.norm(centers, axis=1, keepdims=True)
        near, keep = centers @ centers.T >= ONE_CENTER, []
        for i in range(len(centers)):
            if not near[i, keep].any():
                keep.append(i)
        centers = centers[keep]
    return centers


def _fitter(rows: pa.Table) -> pa.Table:
    order = np.argsort(rows.column("rep").to_numpy(), kind="stable")
    centers = fit_centers(_units(rows.column("q"))[order].astype(np.float64), rows.column("children")[0].as_py())
    return pa.table({"cell": rows.column("cell")[:1], "centers": pa.array([centers.astype("<f4").tobytes()], pa.binary())})


def _visits(x: np.ndarray, centers: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the cells each row visits, its own among them; and its cosines to the centers."""
    s = x @ centers.T
    home = s.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centers @ centers.T))
    return s[np.arange(len(x)), home][:, None] - s <= width * apart[home] + _slack(x.shape[1]), s


def _placed(x: np.ndarray, cell: str, tree: dict[str, np.ndarray], width: float) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(cell, rows, lower) of every leaf of the tree that rows of x visit; lower, for each row, are the cells of lower numbers beside
    the path that the row visits too, as bits: a pair counts where it has none of them in common."""

    def go(cell: str, at: np.ndarray, low: np.ndarray) -> Iterator:
        if cell not in tree:
            yield cell, at, low
            return
        visits, _ = _visits(x[at], tree[cell], width)
        lower = np.zeros((-(-visits.shape[1] // 64), len(at)), np.uint64)
        for c in np.flatnonzero(visits.any(axis=0)).tolist():
            mine = np.flatnonzero(visits[:, c])
            yield from go(f"{cell}.{c}", at[mine], np.concatenate((low[:, mine], lower[:, mine])))
            lower[c // 64, mine] |= np.uint64(1 << c % 64)

    yield from go(cell, np.arange(len(x)), np.zeros((0, len(x)), np.uint64))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray]]:
    """(cell of the vectors' length, rows, their vectors)."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            dims = part.column("dim").to_numpy()
            for d in np.unique(dims):
                own = part.take(pa.array(np.flatnonzero(dims == d)))
                yield str(d), own, _units(own.column("q"))


def _counter(tree: dict[str, np.ndarray], width: Callable[[int], float], rows: int) -> Callable:
    """(cell, members) of the leaves, a row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, _, x in _chunks(batches, rows):
            found = [(name, len(at)) for name, at, _ in _placed(x, cell, tree, width(x.shape[1]))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], names=["cell", "members"])

    return run


def _sampler(tree: dict[str, np.ndarray], big: dict[str, tuple[int, int]], width: Callable[[int], float], rows: int, most: int) -> Callable:
    """(cell, children, rep, q) of about `most` members of each big cell (members, children)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, own, x in _chunks(batches, rows):
            pick = own.column("pick").to_numpy()
            few = np.flatnonzero(pick < most / min(m for m, _ in big.values()))
            for name, at, _ in _placed(x[few], cell, tree, width(x.shape[1])):
                if name in big:
                    at = few[at][pick[few[at]] < most / big[name][0]]
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([big[name][1]] * n, pa.int32()), *(own.column(c).take(pa.array(at)) for c in ("rep", "q"))], names=["cell", "children", "rep", "q"])

    return run


def _dealer(tree: dict[str, np.ndarray], blocks: dict[str, int], number: dict[str, int], width: Callable[[int], float], rows: int) -> Callable:
    """Every visit of every class, to each pair of blocks (i, j) of its cell that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, own, x in _chunks(batches, rows):
            block = own.column("pick").to_numpy()
            for name, at, low in _placed(x, cell, tree, width(x.shape[1])):
                low = [r.tobytes() for r in np.ascontiguousarray(low.T).astype("<u8")]
                of = blocks.get(name, 1)
                mine = (block[at] * of).astype(np.int64)
                for other in range(of):
                    low_block, high_block = np.minimum(mine, other), np.maximum(mine, other)
                    side = np.where(low_block == high_block, 0, np.where(mine == low_block, 1, 2)).astype(np.int32)
                    made = [pa.array(np.full(len(at), number[name], np.int64)), pa.array(low_block * of + high_block), pa.array(side), pa.array(low, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*made, *(own.column(c).take(pa.array(at)) for c in ("rep", "num", "n", "q"))], names=["cell", "pair", "side", "low", "rep", "num", "n", "q"])

    return run


def _lowest(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Lets the smallest label of every connected part of the links i-j sink to all its rows, in place."""
    while True:
        before = right[j]
        np.minimum.at(left, i, before)
        np.minimum.at(right, j, left[i])
        if (right[j] == before).all() and (left[i] == right[j]).all():
            return


def _multiplier(threshold: float, width: Callable[[int], float], inner: float, leaf_rows: int) -> Callable:
    """What the classes of a cell (or of two of its blocks) find among themselves: (kind, x, y)."""

    def run(rows: pa.Table) -> pa.Table:
        x = _units(rows.column("q"))
        off = _bytes(rows.column("q"))[:, 4:8].copy().view("<f4").ravel().astype(np.float64)
        rep, num, n, side = (rows.column(c).to_numpy() for c in ("rep", "num", "n", "side"))
        low = np.ascontiguousarray(_bytes(rows.column("low")).copy().view("<u8").T) if len(rows.column("low")[0].as_py()) else np.zeros((0, len(x)), np.uint64)
        apart, dim = bool(side.any()), x.shape[1]
        slack = _slack(dim)
        links = np.zeros(len(x), np.int64)
        edges, unsure = [], []

        def counts(i: np.ndarray, j: np.ndarray, low_i: np.ndarray, low_j: np.ndarray) -> np.ndarray:
            """Whether pairs of rows belong here: they have no lower cell in common and are of different blocks, if there are two."""
            good = (side[i] != side[j]) if apart else np.ones(np.broadcast_shapes(i.shape, j.shape), bool)
            for a, b in zip(low_i, low_j, strict=True):
                good &= (a & b) == 0
            return good

        def product(at: np.ndarray, low: np.ndarray, core: np.ndarray) -> None:
            """Links of the rows `at`: the core by its kinds of visits, the others by their cosines to all."""
            middle, loose = np.flatnonzero(core), np.flatnonzero(~core)
            if len(middle) > 1:
                kinds, which = np.unique(np.concatenate((low[:, middle].T, side[at[middle]].astype(np.uint64)[:, None]), axis=1), axis=0, return_inverse=True)
                which = which.reshape(-1)
                one = at[middle[np.unique(which, return_index=True)[1]]]
                weight, met = np.bincount(which, n[at[middle]], len(kinds)), np.zeros(len(kinds))
                low_kinds = np.ascontiguousarray(kinds[:, :-1].T)
                step = max(1, SLICE // len(kinds))
                for start in range(0, len(kinds), step):
                    part = slice(start, start + step)
                    met[part] = counts(one[part, None], one[None], low_kinds[:, part, None], low_kinds[:, None]) @ weight
                alone = (kinds[:, :-1] == 0).all(axis=1) & (not apart)
                links[at[middle]] += (met[which] - np.where(alone[which], n[at[middle]], 0)).astype(np.int64)
                hub = rep[at[middle]].min()
                edges.append(np.stack((rep[at[middle]], np.full(len(middle), hub))))
            # Each slice meets itself and what comes after it; the core comes last and has no turn of its own.
            if not len(loose):
                return
            order = np.concatenate((loose, middle))
            at, low = at[order], low[:, order]
            y, label = x[at], rep[at].copy()
            step = max(32, SLICE // len(at))
            for start in range(0, len(loose), step):
                stop = min(start + step, len(loose))
                s = y[start:stop] @ y[start:].T
                near = np.flatnonzero((s >= threshold - slack).ravel())
                i, j = near // s.shape[1] + start, near % s.shape[1] + start
                i, j, s = i[i < j], j[i < j], s.ravel()[near[i < j]]
                if not len(i):
                    continue
                here = counts(at[i], at[j], low[:, i], low[:, j])
                i, j, sure = i[here], j[here], s[here] >= threshold + slack
                close = np.flatnonzero(~sure)
                for first in range(0, len(close), CHUNK_ROWS):
                    some = close[first : first + CHUNK_ROWS]
                    a, b = i[some], j[some]
                    exact = np.einsum("ij,ij->i", y[a].astype(np.float64), y[b].astype(np.float64))
                    most = 1.001 * (off[at[a]] + off[at[b]]) + 1e-12
                    sure[some] = exact >= threshold + most
                    a, b = a[open_ := np.abs(exact - threshold) < most], b[open_]
                    unsure.append(np.stack((num[at[a]], num[at[b]])))
                i, j = i[sure], j[sure]
                np.add.at(links, at[i], n[at[j]])
                np.add.at(links, at[j], n[at[i]])
                mine, was = rep[at[start:stop]].copy(), label.copy()
                _lowest(i - start, j, mine, label)
                edges.append(np.concatenate((np.stack((rep[at[start:stop]], mine)), np.stack((was, label))), axis=1))
                edges[-1] = np.unique(edges[-1][:, edges[-1][0] != edges[-1][1]], axis=1)

        def go(at: np.ndarray, low: np.ndarray, core: np.ndarray, depth: int) -> None:
            loose = len(at) - int(core.sum())
            if len(at) > leaf_rows and loose and depth < LEVELS:
                few = at if len(at) <= SAMPLE else at[np.random.default_rng(len(at)).choice(len(at), SAMPLE, replace=False)]
                centers = fit_centers(x[few], min(CHILDREN, max(2, len(at) // 16)), 4)
                visits, inside = np.zeros((len(at), len(centers)), bool), np.zeros((len(at), len(centers)), bool)
                for start in range(0, len(at), CHUNK_ROWS):
                    part = slice(start, start + CHUNK_ROWS)
                    visits[part], s = _visits(x[at[part]], centers, width(dim))
                    inside[part] = s >= inner + slack
                if ((visits & ~inside).sum(axis=0) * visits.sum(axis=0).astype(float)).sum() <= SAVES * loose * len(at):
                    lower = np.zeros(len(at), np.uint64)
                    for c in range(len(centers)):
                        mine = np.flatnonzero(visits[:, c])
                        if len(mine) > 1:
                            go(at[mine], np.concatenate((low[:, mine], lower[None, mine])), inside[mine, c], depth + 1)
                        lower[mine] |= np.uint64(1 << c)
                    return
            product(at, low, core)

        order = np.lexsort((num, rep))  # whatever order rows came in
        go(order, low[:, order], np.zeros(len(x), bool), 0)
        some = np.flatnonzero(links)
        edge, pair = (np.concatenate(p, axis=1) if p else np.zeros((2, 0), np.int64) for p in (edges, unsure))
        edge = np.unique(edge[:, edge[0] != edge[1]], axis=1)
        found = np.concatenate((np.stack((num[some], links[some])), edge, pair), axis=1)
        kind = np.repeat(np.array([LINKS, EDGE, UNSURE], np.int32), [len(some), edge.shape[1], pair.shape[1]])
        return pa.table({"kind": pa.array(kind), "x": pa.array(found[0]), "y": pa.array(found[1])})

    return run


def _tree(whole: DataFrame, width: Callable[[int], float]) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Centers of the cells that are split, and members of the others. The driver gets counts and centers only."""
    tree: dict[str, np.ndarray] = {}
    members = {str(r.dim): r["count"] for r in whole.groupBy("dim").count().collect()}
    left, most = set(), CELL_ROWS
    for _ in range(LEVELS):
        big = {c: m for c, m in members.items() if m > most and c not in left}
        if not big:
            break
        children = {c: (m, min(MOST, max(-(-6 * m // BLOCK_ROWS), min(CHILDREN, -(-2 * m // CELL_ROWS)) if not tree else 2))) for c, m in big.items()}
        rows = whole.mapInArrow(_sampler(tree, children, width, CHUNK_ROWS, SAMPLE), "cell string, children int, rep long, q binary")
        fitted = rows.groupBy("cell").applyInArrow(_fitter, "cell string, centers binary").collect()
        found = {r.cell: np.frombuffer(r.centers, "<f4").reshape(-1, int(r.cell.split(".")[0])) for r in fitted}
        sizes = whole.mapInArrow(_counter(tree | found, width, CHUNK_ROWS), "cell string, members long").groupBy("cell").agg(F.sum("members").alias("members")).collect()
        sizes = {r.cell: r.members for r in sizes}
        for c, m in big.items():
            below = {k: v for k, v in sizes.items() if k.rpartition(".")[0] == c}
            if c in found and sum(float(v) ** 2 for v in below.values()) <= SAVES * float(m) ** 2:
                tree[c] = found[c]
                del members[c]
                members |= below
            else:
                left.add(c)
        most = BLOCK_ROWS
    return tree, members


def near_vectors(vectors: DataFrame, threshold: float = 0.95, spread: float = 4.25) -> DataFrame:
    """One row per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept."""
    angle = math.acos(threshold)
    half, sine, inner = math.sqrt(2 - 2 * threshold) / 2, math.sin(angle / 2), math.cos(angle / 2) + 1e-9
    width = lambda d: min(sine, spread * half / math.sqrt(d))
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding")
    packed = vectors.mapInArrow(_pack, "vec_id long, dim int, key binary, q binary")
    classes = packed.filter("key is not null and vec_id is not null").groupBy("dim", "key", "q").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    pick = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = materialize(classes.withColumn("num", F.monotonically_increasing_id()).withColumn("pick", pick), "cells-classes", "zstd")
    tree, members = _tree(whole.select("dim", "rep", "q", "pick"), width)
    blocks = {c: -(-m // BLOCK_ROWS) for c, m in members.items() if m > BLOCK_ROWS}
    number = {c: i for i, c in enumerate([*members, *(f"{c}.{i}" for c, found in tree.items() for i in range(len(found)))])}
    dealt = whole.mapInArrow(_dealer(tree, blocks, number, width, CHUNK_ROWS), "cell long, pair long, side int, low binary, rep long, num long, n long, q binary")
    found = dealt.groupBy("cell", "pair").applyInArrow(_multiplier(threshold, width, inner, CELL_ROWS), "kind int, x long, y long")
    found = materialize(found, "cells-links")
    names = whole.select("num", "rep", "key", "n")
    counts, links = found.filter(F.col("kind") == LINKS).select("x", "y"), found.filter(F.col("kind") == EDGE).select("x", "y")
    unsure = found.filter(F.col("kind") == UNSURE)
    if not unsure.isEmpty():
        pairs = materialize(_settled(vectors, names, unsure.select(F.col("x").alias("a"), F.col("y").alias("b")), threshold), "cells-settled")
        counts = counts.union(pairs.select("a", "n_b")).union(pairs.select("b", "n_a"))
        links = links.union(pairs.select("rep_a", "rep_b"))
    counts = counts.groupBy(F.col("x").alias("num")).agg(F.sum("y").alias("links"))
    labels = components(links.toDF("a", "b"))
    named = names.join(counts, "num", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = packed.select("vec_id", "key").join(named, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    out = out.select("vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _settled(vectors: DataFrame, names: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, rep_a, rep_b, n_a, n_b) of classes whose vectors link, by the vectors themselves in doubles."""
    ends = materialize(names.join(pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct(), "num"), "cells-ends")
    ids = ends.select(F.col("rep").alias("vec_id")).distinct()
    asked = vectors.join(F.broadcast(ids) if ends.count() <= BROADCAST_ROWS else ids, "vec_id", "left_semi")
    units = asked.select("embedding").mapInArrow(_whole_vectors, "key binary, unit binary").dropDuplicates(["key"])
    ends = ends.join(units, "key")
    side = lambda s: ends.select(F.col("num").alias(s), F.col("rep").alias(f"rep_{s}"), F.col("n").alias(f"n_{s}"), F.col("unit").alias(f"unit_{s}"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = ([np.frombuffer(b, "<f8") for b in batch.column(c).to_pylist()] for c in ("unit_a", "unit_b"))
            yield batch.filter(pa.array([bool(p @ q >= threshold) for p, q in zip(u, v, strict=True)], pa.bool_())).select(["a", "b", "rep_a", "rep_b", "n_a", "n_b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "unit_a", "unit_b")
    return both.mapInArrow(link, "a long, b long, rep_a long, rep_b long, n_a long, n_b long")
