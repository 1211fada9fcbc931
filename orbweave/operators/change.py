"""Change between two dates on one grid, and stacking of rasters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def threshold_mask(x: Column, threshold: float, mode: str = "abs") -> Column:
    """1 where x passes: abs(x) > t, x > t (positive) or x < -t (negative)."""
    test = {"abs": F.abs(x) > threshold, "positive": x > threshold, "negative": x < -threshold}[mode]
    return test.cast("int")


def _pair(t1: DataFrame, t2: DataFrame, bands: list[str]) -> DataFrame:
    a = t1.select("row", "col", *(F.col(b).alias(f"{b}_1") for b in bands))
    return a.join(t2.select("row", "col", *(F.col(b).alias(f"{b}_2") for b in bands)), ["row", "col"])


def band_diff(t1: DataFrame, t2: DataFrame, band: str, threshold: float, mode: str = "abs") -> DataFrame:
    p = _pair(t1, t2, [band]).select("row", "col", (F.col(f"{band}_2") - F.col(f"{band}_1")).alias("diff"))
    return p.withColumn("mask", threshold_mask(F.col("diff"), threshold, mode))


def band_ratio(t1: DataFrame, t2: DataFrame, band: str, threshold: float) -> DataFrame:
    p = _pair(t1, t2, [band]).select("row", "col", (F.col(f"{band}_2") / (F.col(f"{band}_1") + 1e-6)).alias("ratio"))
    return p.withColumn("mask", threshold_mask(F.col("ratio") - 1, threshold))


def index_diff(t1: DataFrame, t2: DataFrame, first: str, second: str, threshold: float, mode: str = "abs") -> DataFrame:
    index = lambda t: (F.col(f"{first}_{t}") - F.col(f"{second}_{t}")) / (F.col(f"{first}_{t}") + F.col(f"{second}_{t}") + 1e-6)
    p = _pair(t1, t2, [first, second]).select("row", "col", (index(2) - index(1)).alias("diff"))
    return p.withColumn("mask", threshold_mask(F.col("diff"), threshold, mode))


def area_ratio(changed: DataFrame, width: int, height: int) -> DataFrame:
    return changed.agg(F.round(F.sum("mask") / (width * height), 6).alias("ratio"))


def merge(sources: list[tuple[DataFrame, int]]) -> DataFrame:
    """Bands of several rasters (pixels, number of bands) one after another; a pixel stays where every source is valid."""
    shifted, before = [], 0
    for i, (pixels, bands) in enumerate(sources):
        shifted.append(pixels.select("row", "col", (F.col("band") + before).alias("band"), "value", F.lit(i).alias("source")))
        before += bands
    stack = reduce(DataFrame.unionByName, shifted)
    valid = stack.filter("value is not null").groupBy("row", "col").agg(F.count_distinct("source").alias("n")).filter(F.col("n") == len(sources))
    return stack.join(valid, ["row", "col"], "left_semi").drop("source")


def stack_bands(scenes: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """(row, col, band, value) of the named bands of several rasters on one grid, numbered on from raster to raster."""
    parts, before = [], 0
    for pixels, bands in scenes:
        pairs = ", ".join(f"{before + i + 1}, {b}" for i, b in enumerate(bands))
        parts.append(pixels.select("row", "col", F.expr(f"stack({len(bands)}, {pairs}) as (band, value)")))
        before += len(bands)
    return reduce(DataFrame.unionByName, parts)
