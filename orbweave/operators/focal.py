"""Neighbourhood operators on pixels: neighbour joins for single offsets, separable windows for boxes.

Grid edges are known from the extent; a NULL or missing neighbour inside the extent makes the result NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def shifted(df: DataFrame, value: str, dr: int, dc: int, name: str) -> DataFrame:
    """The value at (row + dr, col + dc), keyed by (row, col)."""
    return df.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col(value).alias(name))


#: Side of the blocks that neighbourhood operators work on: a pixel travels once for each block that sees it.
BLOCK = 256


def on_pixels(df: DataFrame, columns: list[str], half: int, make: Callable, made: list[StructField], block: int = BLOCK) -> DataFrame:
    """(row, col, columns, made) of every pixel, worked out block by block with `half` more pixels on each side.

    make(table, dense, r, c) gets a block's rows, their numbers on a dense frame (-1: no pixel), and the frame's rows and columns of
    the block's own pixels; it returns the made columns as a dict of Arrow arrays for these pixels.
    """
    if half > block:
        raise ValueError("a halo is at most a block wide")
    sees = lambda at: F.explode(F.array_distinct(F.array(*(F.expr(f"floor(({at} + {d}) / {block})") for d in ((-half, 0, half) if half else (0,))))))
    placed = df.filter("row is not null and col is not null")  # a pixel without a place is nowhere
    sent = placed.select("row", "col", *columns, sees("row").alias("_br")).withColumn("_bc", sees("col"))
    kept = ["row", "col", *columns]

    def run(part: pa.Table) -> pa.Table:
        row, col = (part.column(x).to_numpy().astype(np.int64) for x in ("row", "col"))
        br, bc = part.column("_br")[0].as_py(), part.column("_bc")[0].as_py()
        r, c = row - br * block + half, col - bc * block + half
        dense = np.full((block + 2 * half, block + 2 * half), -1, np.int64)
        dense[r, c] = np.arange(len(r))
        own = (row // block == br) & (col // block == bc)
        table = pa.table({x: part.column(x).combine_chunks() for x in kept})
        mine = table.filter(pa.array(own))
        return pa.table({x: mine.column(x) for x in kept} | make(table, dense, r[own], c[own]))

    schema = StructType([*(df.schema[x] for x in kept), *made])
    return sent.groupBy("_br", "_bc").applyInArrow(run, schema)


def numbers_on(table: pa.Table, column: str, dense: np.ndarray) -> np.ndarray:
    """A column on the dense frame as doubles, NaN where there is no value."""
    values = np.append(table.column(column).to_numpy(zero_copy_only=False).astype(float), np.nan)
    return values[dense]


def window_sums(a: np.ndarray, r: np.ndarray, c: np.ndarray, rows: tuple[int, int], cols: tuple[int, int]) -> np.ndarray:
    """Sums of a over rows r + rows[0] to r + rows[1] and the like columns."""
    total = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    total[1:, 1:] = a.cumsum(axis=0).cumsum(axis=1)
    r0, r1, c0, c1 = r + rows[0], r + rows[1] + 1, c + cols[0], c + cols[1] + 1
    return total[r1, c1] - total[r0, c1] - total[r1, c0] + total[r0, c0]


def with_neighbours(df: DataFrame, value: str, offsets: dict[str, tuple[int, int]], block: int = BLOCK) -> DataFrame:
    """Columns for the values at offsets, NULL where there is no pixel."""

    def make(table: pa.Table, dense: np.ndarray, r: np.ndarray, c: np.ndarray) -> dict:
        at = {n: dense[r + dr, c + dc] for n, (dr, dc) in offsets.items()}
        return {n: table.column(value).take(pa.array(np.maximum(i, 0), mask=i < 0)) for n, i in at.items()}

    half = max(abs(d) for pair in offsets.values() for d in pair)
    return on_pixels(df, [value], half, make, [StructField(n, df.schema[value].dataType) for n in offsets], block)


FOUR = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}


def gradient(df: DataFrame, value: str, height: int, width: int, cell: float = 1.0) -> DataFrame:
    """dz/dcol (gx) and dz/drow (gy): central differences, one-sided at the grid's edges."""
    n = with_neighbours(df, value, FOUR)
    z = F.col(value)

    def axis(before: str, after: str, at: str, size: int) -> Column:
        first, last = (F.col(after) - z) / cell, (z - F.col(before)) / cell
        return F.when(F.col(at) == 0, first).when(F.col(at) == size - 1, last).otherwise((F.col(after) - F.col(before)) / (2 * cell))

    return n.select("row", "col", value, axis("left", "right", "col", width).alias("gx"), axis("up", "down", "row", height).alias("gy"))


def slope(g: DataFrame) -> Column:
    return F.degrees(F.atan(F.hypot("gx", "gy")))


def aspect(g: DataFrame) -> Column:
    angle = F.pmod(F.degrees(F.atan2(-F.col("gx"), F.col("gy"))) + 360, F.lit(360.0))
    return F.when((F.col("gx") == 0) & (F.col("gy") == 0), -1.0).otherwise(angle)


def hillshade(azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    z, a = math.radians(azimuth), math.radians(altitude)
    east, north, up = math.cos(a) * math.sin(z), math.cos(a) * math.cos(z), math.sin(a)
    dot = (-F.col("gx") * east + F.col("gy") * north + up) / F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + 1)
    return F.greatest(F.least(dot * 255, F.lit(255.0)), F.lit(0.0))


def box(df: DataFrame, columns: dict[str, tuple[str, str]], half: int) -> DataFrame:
    """Window aggregates over (2 * half + 1)^2 boxes, separable: first along columns, then along rows.

    columns: out name -> (input column, 'sum', 'min' or 'max'). Pixels that do not exist do not count. A pixel sends its
    values to the rows that see it, so a box is whole even where its middle column lacks a pixel.
    """
    fn = {"sum": F.sum, "min": F.min, "max": F.max}
    used = sorted({c for c, _ in columns.values()})
    sent = df.select("col", *used, F.col("row").alias("own"), F.explode(F.sequence(F.col("row") - half, F.col("row") + half)).alias("row"))
    first = sent.groupBy("row", "col").agg(F.bool_or(F.col("own") == F.col("row")).alias("here"), *(fn[k](c).alias(o) for o, (c, k) in columns.items()))
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-half, half)
    return first.select("row", "col", "here", *(fn[k](o).over(across).alias(o) for o, (_, k) in columns.items())).filter("here").drop("here")


def local_statistics(df: DataFrame, value: str, half: int = 1) -> DataFrame:
    """Mean, variance, deviation and range of the valid pixels of each box."""
    v = df.withColumns({"n": F.col(value).isNotNull().cast("long"), "q": F.col(value) * F.col(value)})
    b = box(v, {"n": ("n", "sum"), "s": (value, "sum"), "q": ("q", "sum"), "lo": (value, "min"), "hi": (value, "max")}, half)
    variance = F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))
    return b.select("row", "col", (F.col("s") / F.col("n")).alias("mean"), variance.alias("variance"), F.sqrt(variance).alias("std"), (F.col("hi") - F.col("lo")).alias("range"))


def convolve(df: DataFrame, value: str, kernel: list[list[float]], block: int = BLOCK) -> DataFrame:
    """Sum of kernel times value over the pixels that have one; NULL where the kernel meets none."""
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    cells = [(i - h, j - w, k) for i, line in enumerate(kernel) for j, k in enumerate(line) if k]

    def make(table: pa.Table, dense: np.ndarray, r: np.ndarray, c: np.ndarray) -> dict:
        a, total, met = numbers_on(table, value, dense), np.zeros(len(r)), np.zeros(len(r), bool)
        for dr, dc, k in cells:
            v = a[r + dr, c + dc]
            met |= ~np.isnan(v)
            total += k * np.nan_to_num(v)
        return {"value": pa.array(total, mask=~met)}

    return on_pixels(df, [value], max(h, w), make, [StructField("value", DoubleType())], block).select("row", "col", "value")


def gaussian_kernel(sigma: float, radius: int) -> list[list[float]]:
    line = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    total = sum(line) ** 2
    return [[a * b / total for b in line] for a in line]


def erode(df: DataFrame, mask: str, height: int, width: int) -> DataFrame:
    """3 x 3 erosion of a dense mask; outside the grid counts as 0."""
    edge = (F.col("row") > 0) & (F.col("row") < height - 1) & (F.col("col") > 0) & (F.col("col") < width - 1)
    return box(df, {"m": (mask, "min")}, 1).select("row", "col", F.when(edge, F.col("m")).otherwise(0).alias(mask))


def dilate(df: DataFrame, mask: str) -> DataFrame:
    return box(df, {"m": (mask, "max")}, 1).select("row", "col", F.col("m").alias(mask))


def closing(df: DataFrame, mask: str, height: int, width: int, block: int = BLOCK) -> DataFrame:
    """erode(dilate(df)), worked out at once in blocks that see two more pixels on each side."""

    def make(table: pa.Table, dense: np.ndarray, r: np.ndarray, c: np.ndarray) -> dict:
        a = numbers_on(table, mask, dense)
        over = lambda f, x: f.reduce([x[1 + i : len(x) - 1 + i, 1 + j : x.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        wide = np.where(dense[1:-1, 1:-1] < 0, np.nan, over(np.fmax, a))
        found = over(np.fmin, wide)[r - 2, c - 2]
        edge = (table.column("row").to_numpy() > 0) & (table.column("row").to_numpy() < height - 1) & (table.column("col").to_numpy() > 0) & (table.column("col").to_numpy() < width - 1)
        found = np.where(edge[dense[r, c]], found, 0)
        return {"closed": pa.array(np.nan_to_num(found).astype(np.int32), mask=np.isnan(found))}

    found = on_pixels(df, [mask], 2, make, [StructField("closed", IntegerType())], block)
    return found.select("row", "col", F.col("closed").alias(mask))


def quantize(df: DataFrame, value: str, levels: int) -> DataFrame:
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    level = F.when(F.col("hi") <= F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * levels), F.lit(levels - 1)))
    return df.crossJoin(F.broadcast(edge)).select("row", "col", level.cast("int").alias("level"))


def glcm(levels: DataFrame, half: int = 1, dr: int = 0, dc: int = 1) -> DataFrame:
    """Contrast, dissimilarity and homogeneity of the pairs at an offset whose both pixels lie in each window."""
    pair = with_neighbours(levels, "level", {"other": (dr, dc)}).filter("other is not null")
    d = F.abs(F.col("level") - F.col("other"))
    terms = pair.select("row", "col", F.lit(1).alias("n"), (d * d).alias("c"), d.alias("d"), (1 / (1 + d * d)).alias("h"))
    # A pair belongs to a window when both its pixels do: the window of first pixels is shorter by the offset.
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-half + max(0, -dr), half - max(0, dr))
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-half + max(0, -dc), half - max(0, dc))
    names = ("n", "c", "d", "h")
    dense = levels.select("row", "col").join(terms, ["row", "col"], "left")
    first = dense.select("row", "col", *(F.sum(x).over(down).alias(x) for x in names))
    both = first.select("row", "col", *(F.sum(x).over(across).alias(x) for x in names)).filter("n > 0")
    return both.select("row", "col", (F.col("c") / F.col("n")).alias("contrast"), (F.col("d") / F.col("n")).alias("dissimilarity"), (F.col("h") / F.col("n")).alias("homogeneity"))


def local_entropy(levels: DataFrame, half: int = 1, block: int = BLOCK) -> DataFrame:
    """Entropy (natural log) of the levels in each window."""

    def make(table: pa.Table, dense: np.ndarray, r: np.ndarray, c: np.ndarray) -> dict:
        a = numbers_on(table, "level", dense)
        counts = [window_sums(a == v, r, c, (-half, half), (-half, half)) for v in np.unique(a[~np.isnan(a)])]
        n = sum(counts, np.zeros(len(r)))
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = sum((np.where(k > 0, k * np.log(np.maximum(k, 1)), 0) for k in counts), np.zeros(len(r)))
            return {"entropy": pa.array(np.log(n) - bits / n, mask=n == 0)}

    found = on_pixels(levels, ["level"], half + 1, make, [StructField("entropy", DoubleType())], block)
    return found.select("row", "col", "entropy")


def focal_sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
