"""Grids: alignment, resampling, overviews, coordinate systems as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

AGGREGATES = {
    "average": lambda v: F.avg(v), "max": lambda v: F.max(v), "min": lambda v: F.min(v), "med": lambda v: F.percentile(v, F.lit(0.5)),
    "q1": lambda v: F.percentile(v, F.lit(0.25)), "q3": lambda v: F.percentile(v, F.lit(0.75)), "mode": lambda v: F.mode(v, True),
}


def downsample(df: DataFrame, value: str, factor: int, method: str) -> DataFrame:
    """Each target cell from the pixels whose centers it holds."""
    return df.groupBy(F.expr(f"row div {factor}").alias("row"), F.expr(f"col div {factor}").alias("col")).agg(AGGREGATES[method](value).alias("value"))


def overview(df: DataFrame, value: str, level: int) -> DataFrame:
    """Nearest pick: the pixel at the middle of each level x level cell."""
    half = level // 2
    return df.filter((F.col("row") % level == half) & (F.col("col") % level == half)).select(F.expr(f"row div {level}").alias("row"), F.expr(f"col div {level}").alias("col"), F.col(value).alias("value"))


def nearest(target: DataFrame, source: DataFrame, value: str, row: Column, col: Column) -> DataFrame:
    """Target pixels with the source pixel that holds their center; row and col give its fractional place."""
    at = target.select("row", "col", F.floor(row).alias("sr"), F.floor(col).alias("sc"))
    return at.join(source.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).alias("value")), ["sr", "sc"], "left").select("row", "col", "value")


def bilinear(target: DataFrame, source: DataFrame, value: str, row: Column, col: Column) -> DataFrame:
    """Weighted mean of the valid ones among the four surrounding pixel centers."""
    at = target.select("row", "col", (row - 0.5).alias("fr"), (col - 0.5).alias("fc"))
    corner = lambda i, j: F.struct(
        (F.floor("fr") + i).alias("sr"), (F.floor("fc") + j).alias("sc"),
        ((1 - F.abs(F.col("fr") - F.floor("fr") - i)) * (1 - F.abs(F.col("fc") - F.floor("fc") - j))).alias("w"),
    )
    corners = at.select("row", "col", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("k")).select("row", "col", "k.*").filter("w > 0")
    met = corners.join(source.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).alias("v")).filter("v is not null"), ["sr", "sc"])
    return met.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone; 3857 outside 80 S to 84 N."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")
    return F.when((lat < -80) | (lat > 84), 3857).otherwise(F.when(lat >= 0, 32600).otherwise(32700) + zone)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(latitude, longitude) series of the WGS84 ellipsoid."""
    p = F.radians(lat)
    return 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p), 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the point's own zone (Krueger series of third order)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    center = F.floor((lon + 180) / 6) * 6 - 177
    p, q = F.radians(lat), F.radians(lon - center)
    t = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(q)), F.atanh(F.sin(q) / F.sqrt(1 + t * t))
    east = eta + sum(k * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, k in enumerate(alpha))
    north = xi + sum(k * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, k in enumerate(alpha))
    return 500000 + 0.9996 * big * east, F.when(lat < 0, 10000000.0).otherwise(0.0) + 0.9996 * big * north


def affine(df: DataFrame, shift_x: float, shift_y: float, scale: float, degrees: float, height: int, width: int) -> DataFrame:
    """Pixel centers after scaling and turning about the grid's center, then shifting."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    x, y = F.col("col") + 0.5 - width / 2, F.col("row") + 0.5 - height / 2
    return df.select("row", "col", ((x * c - y * s) * scale + width / 2 + shift_x).alias("x"), ((x * s + y * c) * scale + height / 2 + shift_y).alias("y"))
