"""Neighbourhood operators on blocks with a halo: each pixel travels once for each block that sees it, four at most.

Numpy works on one dense block at a time; grids are padded at their outer edges as the operator asks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from .focal import BLOCK as FOCAL_BLOCK, gradient, numbers_on, on_pixels, window_sums

BLOCK = 128


def on_blocks(df: DataFrame, value: str, half: int, work: Callable[[np.ndarray], np.ndarray], height: int, width: int, mode: str = "edge", block: int = BLOCK) -> DataFrame:
    """(row, col, value) of work(array) for every pixel with a value.

    work gets a block (missing pixels are NaN) with `half` more pixels on each side and returns the inner part. Outside the grid
    the block repeats its edge ('edge') or mirrors it ('symmetric').
    """
    if half > block:
        raise ValueError("a halo is at most a block wide")
    sees = lambda at, size: F.sequence(F.greatest(F.floor((F.col(at) - half) / block), F.lit(0)), F.least(F.floor((F.col(at) + half) / block), F.lit((size - 1) // block)))
    sent = df.filter("row is not null and col is not null").select("row", "col", F.col(value).cast("double").alias("v"), F.explode(sees("row", height)).alias("br")).withColumn("bc", F.explode(sees("col", width)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(part["br"].iloc[0]), int(part["bc"].iloc[0])
        r0, c0 = max(br * block - half, 0), max(bc * block - half, 0)
        r1, c1 = min((br + 1) * block + half, height), min((bc + 1) * block + half, width)
        a = np.full((r1 - r0, c1 - c0), np.nan)
        a[part["row"].to_numpy() - r0, part["col"].to_numpy() - c0] = part["v"].to_numpy()
        inner_r, inner_c = min((br + 1) * block, height) - br * block, min((bc + 1) * block, width) - bc * block
        before = (half - (br * block - r0), half - (bc * block - c0))
        after = (half - (r1 - br * block - inner_r), half - (c1 - bc * block - inner_c))
        out = work(np.pad(a, ((before[0], after[0]), (before[1], after[1])), mode=mode))
        own = part[(part["row"] // block == br) & (part["col"] // block == bc) & part["v"].notna()]
        return pd.DataFrame({"row": own["row"], "col": own["col"], "value": out[own["row"].to_numpy() - br * block, own["col"].to_numpy() - bc * block].astype(float)})

    return sent.groupBy("br", "bc").applyInPandas(run, "row long, col long, value double")


def gabor_kernels(frequency: float, theta: float, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Real part (mean taken off) and imaginary part, each with absolute sum 1."""
    if frequency <= 0 or sigma <= 0:
        raise ValueError("frequency and sigma must be positive")
    n = max(1, math.ceil(3 * sigma))
    y, x = np.mgrid[-n : n + 1, -n : n + 1].astype(float)
    t = math.radians(theta)
    along = x * math.cos(t) + y * math.sin(t)
    bell = np.exp(-(x * x + y * y) / (2 * sigma * sigma))
    real, imaginary = bell * np.cos(2 * math.pi * frequency * along), bell * np.sin(2 * math.pi * frequency * along)
    real -= real.mean()
    return tuple(k / total if (total := np.abs(k).sum()) > 0 else k for k in (real, imaginary))


def gabor(df: DataFrame, value: str, height: int, width: int, frequency: float = 0.2, theta: float = 0.0, sigma: float = 1.0) -> DataFrame:
    """Magnitude of the Gabor response; missing pixels count as the grid's mean and have none."""
    real, imaginary = gabor_kernels(frequency, theta, sigma)
    half = len(real) // 2
    mean = df.agg(F.avg(value)).first()[0] or 0.0

    def work(a: np.ndarray) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(np.where(np.isnan(a), mean, a), real.shape)
        return np.hypot(*(np.einsum("ijkl,kl->ij", windows, k[::-1, ::-1]) for k in (real, imaginary)))

    return on_blocks(df, value, half, work, height, width)


def lbp(df: DataFrame, value: str, height: int, width: int, radius: float = 1.0, points: int = 8) -> DataFrame:
    """Local binary pattern: bit p is set where the p-th sample on the circle is not below the center.

    Samples are bilinear; missing pixels count as the grid's mean, and a code is NULL where the pixel nearest to a sample is missing.
    """
    if not (radius > 0 and 1 <= points <= 24):
        raise ValueError("the radius must be positive and points from 1 to 24")
    half = math.ceil(radius)
    mean = df.agg(F.avg(value)).first()[0] or 0.0

    def work(a: np.ndarray) -> np.ndarray:
        filled, here = np.where(np.isnan(a), mean, a), ~np.isnan(a)
        h, w = a.shape[0] - 2 * half, a.shape[1] - 2 * half
        part = lambda x, r, c: x[half + r : half + r + h, half + c : half + c + w]
        codes, whole, center = np.zeros((h, w)), np.ones((h, w), bool), part(filled, 0, 0)
        for p in range(points):
            r, c = -radius * math.sin(2 * math.pi * p / points), radius * math.cos(2 * math.pi * p / points)
            r, c = (round(x) if abs(x - round(x)) < 1e-6 else x for x in (r, c))
            fr, fc = r - math.floor(r), c - math.floor(c)
            sample = sum(wr * wc * part(filled, math.floor(r) + i, math.floor(c) + j) for i, wr in ((0, 1 - fr), (1, fr)) for j, wc in ((0, 1 - fc), (1, fc)) if wr and wc)
            codes += np.where(sample >= center, 2.0**p, 0.0)
            whole &= part(here, math.floor(r + 0.5), math.floor(c + 0.5))
        return np.where(whole, codes, np.nan)

    found = on_blocks(df, value, half, work, height, width)
    return found.select("row", "col", F.when(~F.isnan("value"), F.col("value").cast("long")).alias("code"))


def median_labels(df: DataFrame, label: str, height: int, width: int, half: int = 1) -> DataFrame:
    """Median label of each window; missing pixels count as 0 and stay missing, edges are mirrored."""

    def work(a: np.ndarray) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(np.nan_to_num(a), (2 * half + 1,) * 2)
        return np.median(windows, axis=(2, 3))

    return on_blocks(df, label, half, work, height, width, "symmetric").select("row", "col", F.col("value").cast("int").alias("label"))


def _pair_windows(levels: DataFrame, half: int, dr: int, dc: int, columns: list[str], work: Callable, block: int) -> DataFrame:
    """work(a, b, here, sums) of each window's level pairs at an offset whose both pixels lie in the window; sums adds up over windows."""
    # First pixels of such pairs lie in a window that is shorter by the offset.
    rows, cols = (-half + max(0, -dr), half - max(0, dr)), (-half + max(0, -dc), half - max(0, dc))
    reach = max(abs(dr), abs(dc))

    def make(table: pa.Table, dense: np.ndarray, r: np.ndarray, c: np.ndarray) -> dict:
        a = np.pad(numbers_on(table, "level", dense), reach, constant_values=np.nan)
        b = a[reach + dr : a.shape[0] - reach + dr, reach + dc : a.shape[1] - reach + dc]
        a = a[reach : a.shape[0] - reach, reach : a.shape[1] - reach]
        here = ~np.isnan(a) & ~np.isnan(b)
        a, b = np.where(here, a, 0), np.where(here, b, 0)
        found = work(a, b, here, lambda x: np.round(window_sums(x, r, c, rows, cols), 9))
        none = window_sums(here, r, c, rows, cols) < 0.5
        return {n: pa.array(v, mask=none) for n, v in found.items()}

    found = on_pixels(levels, ["level"], half + reach + 1, make, [StructField(n, DoubleType()) for n in columns], block)
    return found.select("row", "col", *columns).filter(F.col(columns[0]).isNotNull())


def glcm_histogram(levels: DataFrame, half: int = 1, dr: int = 0, dc: int = 1, block: int = FOCAL_BLOCK) -> DataFrame:
    """Angular second moment, energy and entropy (natural log) of the level pairs in each window."""

    def work(a: np.ndarray, b: np.ndarray, here: np.ndarray, sums: Callable) -> dict:
        code = np.where(here, a * (b.max(initial=0) + 1) + b, -1)
        counts = [sums(code == v) for v in np.unique(code[here])] or [sums(here)]
        n = np.maximum(sum(counts), 1)
        asm = sum(k * k for k in counts) / (n * n)
        return {"asm": asm, "energy": np.sqrt(asm), "entropy": np.log(n) - sum(k * np.log(np.maximum(k, 1)) for k in counts) / n}

    return _pair_windows(levels, half, dr, dc, ["asm", "energy", "entropy"], work, block)


def glcm_correlation(levels: DataFrame, half: int = 1, dr: int = 0, dc: int = 1, block: int = FOCAL_BLOCK) -> DataFrame:
    """Correlation of the level pairs in each window, 0 where a side does not vary."""

    def work(a: np.ndarray, b: np.ndarray, here: np.ndarray, sums: Callable) -> dict:
        n = np.maximum(sums(here), 1)
        ma, mb = sums(a) / n, sums(b) / n
        spread = np.sqrt(np.maximum(sums(a * a) / n - ma * ma, 0) * np.maximum(sums(b * b) / n - mb * mb, 0))
        return {"correlation": np.where(spread > 1e-12, (sums(a * b) / n - ma * mb) / np.maximum(spread, 1e-12), 0.0)}

    return _pair_windows(levels, half, dr, dc, ["correlation"], work, block)


def curvature(df: DataFrame, value: str, height: int, width: int, cell: float = 1.0) -> DataFrame:
    """Second differences along columns and rows: the gradient's gradient."""
    g = gradient(df, value, height, width, cell)
    x = gradient(g.select("row", "col", F.col("gx").alias("s")), "s", height, width, cell).select("row", "col", F.col("gx").alias("xx"))
    y = gradient(g.select("row", "col", F.col("gy").alias("s")), "s", height, width, cell).select("row", "col", F.col("gy").alias("yy"))
    return x.join(y, ["row", "col"]).select("row", "col", (F.col("xx") + F.col("yy")).alias("curvature"))


def edge_strength(df: DataFrame, value: str, height: int, width: int, missing: float = 0.0) -> DataFrame:
    """df with edge, the gradient's length: central differences, one-sided at the grid's edges, 0 along a side of one pixel.

    Neighbours that are missing inside the grid count as `missing`.
    """

    def make(table: pa.Table, dense: np.ndarray, r: np.ndarray, c: np.ndarray) -> dict:
        a = numbers_on(table, value, dense)
        a = np.where(np.isnan(a), missing, a)

        def along(name: str, size: int, dr: int, dc: int) -> np.ndarray:
            at, here = table.column(name).to_numpy()[dense[r, c]], a[r, c]
            before, after = np.where(at > 0, a[r - dr, c - dc], here), np.where(at < size - 1, a[r + dr, c + dc], here)
            return (after - before) / np.maximum((at > 0).astype(int) + (at < size - 1), 1)

        return {"edge": pa.array(np.hypot(along("row", height, 1, 0), along("col", width, 0, 1)))}

    return on_pixels(df, [c for c in df.columns if c not in ("row", "col")], 1, make, [StructField("edge", DoubleType())])


def wetness(accumulation: DataFrame, slopes: DataFrame, cell: float = 1.0, least_degrees: float = 0.1) -> DataFrame:
    """Topographic wetness ln(a / tan b) of accumulation(row, col, accumulation) and slopes(row, col, slope in degrees)."""
    area = F.greatest(F.col("accumulation") * cell, F.lit(cell))
    steep = F.tan(F.radians(F.greatest(F.col("slope"), F.lit(max(least_degrees, 1e-6)))))
    return accumulation.join(slopes, ["row", "col"]).select("row", "col", F.log(area / steep).alias("twi"))
