"""Ready-made raster jobs that users start from: vegetation index of two rasters, band report, smoothing, stack, binary.

A raster is (row, col, value); a pixel that is absent, null or NaN is masked and stays so. Defined cases: rasters meet on their
grid, and a pixel masked in one input of the index is masked in the result; an empty raster gives no rows; a report of no valid
pixel has no range; a raster of one value has no pixel above its threshold; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from .focal import BLOCK, numbers_on, on_pixels
from .stats import otsu


def _valid(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def vegetation_raster(red: DataFrame, nir: DataFrame) -> DataFrame:
    """(nir - red) / (nir + red + 1e-8) of two single-band rasters in 32-bit numbers; what is not finite is masked."""
    a = red.filter(_valid(F.col("value"))).select("row", "col", F.col("value").cast("float").alias("red"))
    b = nir.filter(_valid(F.col("value"))).select("row", "col", F.col("value").cast("float").alias("nir"))
    above = F.col("nir") - F.col("red")
    below = F.col("nir") + F.col("red") + F.lit(1e-8).cast("float")
    value = F.try_divide(above.cast("double"), below.cast("double")).cast("float")
    out = a.join(b, ["row", "col"]).select("row", "col", value.alias("value"))
    return out.filter(_valid(F.col("value")) & (F.abs("value") < float("inf")))


def raster_report(raster: DataFrame) -> DataFrame:
    """One row: valid pixels and their range."""
    return raster.filter(_valid(F.col("value"))).agg(F.count("*").alias("valid"), F.min("value").alias("low"), F.max("value").alias("high"))


def band_report(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """Per band of pixels(row, col, band, value): valid pixels, range, mean, population deviation.

    Values equal to nodata are masked. Without a nodata value and without any masked pixel, zeros count as masked: the background
    of rasters that never declared one. A band without valid pixels gives no row.
    """
    seen = pixels.select("band", F.when(_valid(F.col("value")), F.col("value")).alias("v"))
    if nodata is not None:
        kept = seen.filter(F.col("v") != nodata)
    else:
        masked = seen.agg(F.coalesce(F.bool_or(F.col("v").isNull()), F.lit(False)).alias("masked"))  # one row
        kept = seen.crossJoin(F.broadcast(masked)).filter("v is not null and (masked or v <> 0)")
    return kept.groupBy("band").agg(F.count("*").alias("valid"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def gaussian_line(sigma: float, radius: int) -> np.ndarray:
    line = np.array([math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)])
    return line / line.sum()


def _mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Places beyond the edges of 0..size-1 mirrored inside, the edge pixel itself repeated."""
    at = at % (2 * size)
    return np.where(at < size, at, 2 * size - 1 - at)


def smoothed(raster: DataFrame, height: int, width: int, sigma: float = 2.0, reach: float = 4.0, block: int = BLOCK) -> DataFrame:
    """Gaussian smoothing in the raster's own type: masked pixels count as 0 and stay masked, edges are mirrored.

    The kernel ends at `reach` deviations. Rows, then columns, block by block with a halo as wide as the kernel.
    """
    half = int(reach * sigma + 0.5)
    line = gaussian_line(sigma, half)

    def make(table: pa.Table, dense: np.ndarray, r: np.ndarray, c: np.ndarray) -> dict:
        if not len(r):
            return {"smooth": pa.array([], pa.float64())}
        a = numbers_on(table, "value", dense)
        masked = np.isnan(a[r, c])
        first = int(dense[r[0], c[0]])
        pick = []
        for name, at, size in (("row", r, height), ("col", c, width)):
            base = table.column(name)[first].as_py() - int(at[0])
            # Beyond the frame no own pixel looks, so any place will do there.
            pick.append(np.clip(_mirrored(np.arange(len(a)) + base, size) - base, 0, len(a) - 1))
        a = np.nan_to_num(a)[np.ix_(*pick)]
        n = len(a) - 2 * half
        down = sum(k * a[i : i + n] for i, k in enumerate(line))
        both = sum(k * down[:, i : i + n] for i, k in enumerate(line))
        return {"smooth": pa.array(both[r - half, c - half], mask=masked)}

    kind = raster.schema["value"].dataType
    inside = raster.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    found = on_pixels(inside.select("row", "col", "value"), ["value"], half, make, [StructField("smooth", DoubleType())], block)
    return found.filter("smooth is not null").select("row", "col", F.col("smooth").cast(kind).alias("value"))


def binary(raster: DataFrame, bins: int = 256) -> DataFrame:
    """255 above the raster's own Otsu threshold (bins from its least to its largest value), else 0."""
    valid = raster.filter(_valid(F.col("value"))).select("row", "col", F.col("value").cast("double").alias("value"))
    low, high = valid.agg(F.min("value"), F.max("value")).first()
    if low is None or low == high:
        return valid.select("row", "col", F.lit(0).alias("value"))
    threshold = otsu(valid, "value", bins, low, high)  # one row
    return valid.crossJoin(F.broadcast(threshold)).select("row", "col", F.when(F.col("value") > F.col("threshold"), 255).otherwise(0).alias("value"))
