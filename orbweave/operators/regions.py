"""Regions of a grid: 4-connected labels, and their outlines as polygons with holes.

Both work on square blocks first: a block labels its pixels and follows its outlines by itself, and only what crosses a
block's border (label pairs there, open pieces of outlines) goes into rounds over the whole grid. So a round's rows follow
the borders of blocks, not the pixels, and the number of rounds is logarithmic in the number of blocks that a region crosses.

Defined cases: pixels with a null or NaN value, or without a place, are background; a missing pixel is background; regions of equal value that
only touch at a corner are two; a region that touches itself at a corner keeps simple rings that meet there; a grid has each
pixel once; an empty grid gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import lowest_label, rings, stored

BLOCK = 256
#: Steps along the sides of a pixel (top eastward, right southward, bottom westward, left northward), and outward of them.
ALONG, OUTWARD = ((0, 1), (1, 0), (0, -1), (-1, 0)), ((-1, 0), (0, 1), (1, 0), (0, -1))
POINTS = "array<struct<x:long,y:long>>"


def _place(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return row.astype(np.int64) << 32 | col.astype(np.int64)


def lowest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest number of each of n nodes' components under links a-b: hook roots to smaller ones, then shorten all paths."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        low, hooked = np.minimum(x, y), root.copy()
        np.minimum.at(hooked, x, low)
        np.minimum.at(hooked, y, low)
        while ((short := hooked[hooked]) != hooked).any():
            hooked = short
        if (hooked == root).all():
            return root
        root = hooked


def _dense(rows: pa.Table, block: int, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, codes of the block's values in a frame of missing pixels)."""
    row, col = rows.column("row").to_numpy(), rows.column("col").to_numpy()
    r0, c0 = rows.column("br")[0].as_py() * block - 1, rows.column("bc")[0].as_py() * block - 1
    _, code = np.unique(rows.column(name).to_numpy(), return_inverse=True)
    dense = np.full((block + 2, block + 2), -1, np.int64)
    dense[row - r0, col - c0] = code
    return row - r0, col - c0, dense


def _labeller(block: int):
    def run(rows: pa.Table) -> pa.Table:
        r, c, dense = _dense(rows, block, "value")
        width = block + 2
        flat = dense.ravel()
        inner = np.flatnonzero(flat >= 0)
        right, below = inner[flat[inner] == flat[inner + 1]], inner[flat[inner] == flat[inner + width]]
        root = lowest(np.concatenate((right, below)), np.concatenate((right + 1, below + width)), len(flat))[r * width + c]
        r0, c0 = rows.column("br")[0].as_py() * block - 1, rows.column("bc")[0].as_py() * block - 1
        return pa.table({"row": rows.column("row"), "col": rows.column("col"), "value": rows.column("value"), "label": pa.array(_place(root // width + r0, root % width + c0), pa.int64())})

    return run


def labelled(cells: DataFrame, value: str | None = None, block: int = BLOCK) -> DataFrame:
    """(row, col, value, label) of cells: 4-connected regions of equal value (of presence, without one) by their first pixel.

    label is row * 2**32 + col of a region's first pixel in row order.
    """
    v = F.col(value).cast("double") if value else F.lit(1.0)
    cells = cells.select(F.col("row").cast("long"), F.col("col").cast("long"), v.alias("value")).filter("value is not null and not isnan(value) and row is not null and col is not null")
    cells = cells.withColumns({"br": F.expr(f"floor(row / {block})"), "bc": F.expr(f"floor(col / {block})")})
    local = stored(cells.groupBy("br", "bc").applyInArrow(_labeller(block), "row long, col long, value double, label long"), "labels")
    pairs = None
    for at, other in (("row", "col"), ("col", "row")):
        last = local.filter(F.pmod(at, F.lit(block)) == block - 1).select((F.col(at) + 1).alias(at), other, "value", F.col("label").alias("a"))
        met = local.filter(F.pmod(at, F.lit(block)) == 0).join(last, [at, other, "value"]).select("a", F.col("label").alias("b")).distinct()
        pairs = met if pairs is None else pairs.union(met)
    final = lowest_label(pairs).filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("lowest"))
    return local.join(final, "label", "left").select("row", "col", "value", F.coalesce("lowest", "label").alias("label"))


def _tracer(block: int):
    """Outlines of a block's own pixels: closed ones, and open pieces with the place of the next piece."""

    def run(rows: pa.Table) -> pa.Table:
        r, c, dense = _dense(rows, block, "label")
        br, bc = rows.column("br")[0].as_py(), rows.column("bc")[0].as_py()
        r0, c0 = br * block - 1, bc * block - 1
        label, value = np.zeros(dense.shape, np.int64), np.zeros(dense.shape)
        label[r, c], value[r, c] = rows.column("label").to_numpy(), rows.column("value").to_numpy()
        own = np.zeros(dense.shape, bool)
        own[1:-1, 1:-1] = dense[1:-1, 1:-1] >= 0
        pr, pc = np.nonzero(own)
        edge_r, edge_c, side, next_r, next_c, next_side = ([] for _ in range(6))
        for k, ((dr, dc), (nr, nc)) in enumerate(zip(ALONG, OUTWARD, strict=True)):
            here = dense[pr, pc]
            edge = dense[pr + nr, pc + nc] != here
            er, ec, here = pr[edge], pc[edge], here[edge]
            corner, ahead = dense[er + dr + nr, ec + dc + nc] == here, dense[er + dr, ec + dc] == here
            # Left around a corner that the region goes on at, straight on, or right around the own pixel.
            edge_r.append(er), edge_c.append(ec), side.append(np.full(len(er), k))
            next_r.append(np.where(corner, er + dr + nr, np.where(ahead, er + dr, er)))
            next_c.append(np.where(corner, ec + dc + nc, np.where(ahead, ec + dc, ec)))
            next_side.append(np.where(corner, (k - 1) % 4, np.where(ahead, k, (k + 1) % 4)))
        er, ec, side, nr, nc, ns = (np.concatenate(x) for x in (edge_r, edge_c, side, next_r, next_c, next_side))
        number = np.full((*dense.shape, 4), -1)
        number[er, ec, side] = np.arange(len(er))
        onward = number[nr, nc, ns]
        starts = np.ones(len(er), bool)
        starts[onward[onward >= 0]] = False
        onward, seen = onward.tolist(), bytearray(len(er))
        heads, rest, sides = np.flatnonzero(starts).tolist(), range(len(er)), side.tolist()
        # The corner where a side begins.
        x, y = (ec + c0 + np.isin(side, (1, 2))).tolist(), (er + r0 + np.isin(side, (2, 3))).tolist()
        at = (_place(er + r0, ec + c0) << 2 | side).tolist()
        to = (_place(nr + r0, nc + c0) << 2 | ns).tolist()
        labels, values = label[er, ec].tolist(), value[er, ec].tolist()
        out: dict[str, list] = {n: [] for n in ("label", "value", "id", "next", "length", "points")}
        for group in (heads, rest):
            for first in group:
                if seen[first]:
                    continue
                e, points, length, before = first, [], 0, None
                while True:
                    seen[e] = 1
                    if sides[e] != before:
                        points.append({"x": x[e], "y": y[e]})
                    before, length, last = sides[e], length + 1, e
                    e = onward[e]
                    if e < 0 or seen[e]:
                        break
                for column, v in zip(out.values(), (labels[first], values[first], at[first], to[last] if e < 0 else at[first], length, points), strict=True):
                    column.append(v)
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])))
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})

    return run


def outlines(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """(label, value, ring, length, points) of every outline of labelled cells: corners only, the region to the right.

    In columns and rows, with rows going down, an outer outline turns clockwise and has a positive area, a hole the reverse.
    """
    seen = lambda at: F.explode(F.array_distinct(F.array(*(F.expr(f"floor(({at} + {d}) / {block})") for d in (-1, 0, 1)))))
    sent = cells.select("row", "col", "value", "label", seen("row").alias("br")).withColumn("bc", seen("col"))
    pieces = sent.groupBy("br", "bc").applyInArrow(_tracer(block), f"label long, value double, id long, next long, length long, points {POINTS}")
    pieces = stored(pieces, "outlines")
    closed = pieces.filter("id = next").select("label", "value", F.col("id").alias("ring"), "length", "points")
    open_ = pieces.filter("id <> next")
    placed = open_.join(rings(open_.select("id", "next")), "id")
    parts = placed.groupBy("label", "value", "ring").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("place", "points"))).alias("parts"))
    joined = parts.select("label", "value", "ring", "length", F.flatten(F.transform("parts", lambda p: p["points"])).alias("points"))
    # Where two pieces meet on a straight side there is no corner.
    near = lambda i, d: F.element_at("points", (F.pmod(i + d, F.size("points")) + 1).cast("int"))
    straight = lambda p, i: ((near(i, -1)["x"] == p["x"]) & (near(i, 1)["x"] == p["x"])) | ((near(i, -1)["y"] == p["y"]) & (near(i, 1)["y"] == p["y"]))
    bent = lambda df: df.withColumn("points", F.filter("points", lambda p, i: ~straight(p, i)))
    return bent(closed).unionByName(bent(joined))


def ring_area2(points: str) -> F.Column:
    """Twice the signed area of an open list of corners."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0).cast("long"), lambda t, v: t + v)


def polygons(cells: DataFrame, value: str, skip_zero: bool = True, max_features: int | None = None, block: int = BLOCK) -> DataFrame:
    """Polygons of the 4-connected regions of equal value: label_row, label_col, value, area, perimeter, outer, holes.

    outer is a closed ring of (x, y) = (col, row) corners, holes an array of such; a pixel has sides of length 1. Zero is background
    unless skip_zero is off. More than max_features regions are an error.
    """
    kept = cells.filter(F.col(value) != 0) if skip_zero else cells
    named = stored(labelled(kept, value, block), "labelled")
    if max_features is not None:
        # A region is known by its first pixel alone, so no outline is followed in vain.
        many = named.filter("label = row * 4294967296 + col").count()
        if many > max_features:
            raise ValueError(f"{many} regions are more than {max_features}: use a classified raster or raise the limit")
    found = outlines(named, block).withColumn("area2", ring_area2("points"))
    closed = F.concat("points", F.slice("points", 1, 1))
    shells = F.max(F.when(F.col("area2") > 0, closed))
    out = found.groupBy("label", "value").agg((F.sum("area2") / 2).alias("area"), F.sum("length").alias("perimeter"), shells.alias("outer"), F.array_compact(F.collect_list(F.when(F.col("area2") < 0, closed))).alias("holes"))
    return out.select(F.shiftright("label", 32).alias("label_row"), F.col("label").bitwiseAND((1 << 32) - 1).alias("label_col"), "value", "area", "perimeter", "outer", "holes")


def footprint(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Polygons, with holes, of where there are pixels: label_row, label_col, area, perimeter, outer, holes."""
    return polygons(cells.select("row", "col", F.lit(1.0).alias("valid")), "valid", block=block).drop("value")
