"""Warping: reference systems as column expressions, target grids, sampling by any separable kernel, control points.

A grid is north-up: pixel (row, col) of a Grid has its center at x0 + (col + 0.5) * dx, y0 - (row + 0.5) * dy. Target pixels
are carried back to fractional source places by expressions; then source pixels, with a halo as wide as the kernel, and
target pixels meet block by block, so a source pixel travels once for each block that sees it and a target pixel once.
Systems: EPSG:4326, EPSG:3857, and the UTM zones EPSG:326zz and EPSG:327zz (the zones' exceptions in Norway and
Svalbard are not treated: a zone is 6 degrees wide everywhere).

Defined cases: source pixels with a null or NaN value, or without a place, are invalid; a target pixel has a value where the source pixel that holds its
place is valid, and weights are shared out among the valid ones under the kernel; other target pixels have no row; where
what is left of the weights is not positive, the pixel that holds the place decides; an empty source gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .globe import normal_position
from .resample import AGGREGATES, from_mercator, to_mercator, utm_zone

BLOCK = 256
#: Where the Mercator square ends.
MERCATOR_LATITUDE = math.degrees(math.atan(math.sinh(math.pi)))
A, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
N3 = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)
#: Third-order series in the third flattening: forward, inverse, and from conformal to geographic latitude.
ALPHA = (N3 / 2 - 2 * N3**2 / 3 + 5 * N3**3 / 16, 13 * N3**2 / 48 - 3 * N3**3 / 5, 61 * N3**3 / 240)
BETA = (N3 / 2 - 2 * N3**2 / 3 + 37 * N3**3 / 96, N3**2 / 48 + N3**3 / 15, 17 * N3**3 / 480)
DELTA = (2 * N3 - 2 * N3**2 / 3 - 2 * N3**3, 7 * N3**2 / 3 - 8 * N3**3 / 5, 56 * N3**3 / 15)


@dataclass(frozen=True)
class Grid:
    crs: str
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int


def _zone(crs: str) -> tuple[int, bool]:
    code = int(crs.split(":")[1])
    if not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError(f"no such reference system here: {crs}")
    return code % 100, code >= 32700


def to_crs(crs: str, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Geographic degrees in another system."""
    if crs == "EPSG:4326":
        return lon, lat
    if crs == "EPSG:3857":
        return to_mercator(lon, lat)
    zone, south = _zone(crs)
    p, q = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(N3) / (1 + N3)
    t = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(q)), F.atanh(F.sin(q) / F.sqrt(1 + t * t))
    east = eta + sum(k * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, k in enumerate(ALPHA))
    north = xi + sum(k * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, k in enumerate(ALPHA))
    return 500000 + SCALE * RADIUS * east, (10000000.0 if south else 0.0) + SCALE * RADIUS * north


def from_crs(crs: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Geographic degrees of places in another system."""
    if crs == "EPSG:4326":
        return x, y
    if crs == "EPSG:3857":
        return from_mercator(x, y)
    zone, south = _zone(crs)
    xi, eta = (y - (10000000.0 if south else 0.0)) / (SCALE * RADIUS), (x - 500000) / (SCALE * RADIUS)
    u = xi - sum(k * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, k in enumerate(BETA))
    v = eta - sum(k * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, k in enumerate(BETA))
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi + sum(k * F.sin(2 * (j + 1) * chi) for j, k in enumerate(DELTA))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


def bounds_in(spark: SparkSession, grid: Grid, crs: str, steps: int = 21) -> tuple[float, float, float, float]:
    """(left, bottom, right, top) of a grid's border in another system, its sides cut into so many steps.

    In Mercator metres latitudes end at the square's edge: what lies beyond has no place there, but the square is met up to it.
    """
    i, side = (F.col("id") % (steps + 1)) / F.lit(steps), F.floor(F.col("id") / (steps + 1))
    across, down = F.when(side < 2, i).otherwise(F.when(side == 2, 0.0).otherwise(1.0)), F.when(side >= 2, i).otherwise(F.when(side == 0, 0.0).otherwise(1.0))
    points = spark.range(4 * (steps + 1)).select((grid.x0 + across * grid.width * grid.dx).alias("x"), (grid.y0 - down * grid.height * grid.dy).alias("y"))
    lon, lat = from_crs(grid.crs, F.col("x"), F.col("y"))
    if crs == "EPSG:3857":
        lat = F.greatest(F.least(lat, F.lit(MERCATOR_LATITUDE)), F.lit(-MERCATOR_LATITUDE))
    x, y = to_crs(crs, lon, lat)
    return tuple(points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first())


def target_grid(spark: SparkSession, source: Grid, crs: str, res: tuple[float, float] | None = None) -> Grid:
    """The grid of another system that holds the source; without a resolution, one with as many pixels along the diagonal."""
    left, bottom, right, top = bounds_in(spark, source, crs) if crs != source.crs else (source.x0, source.y0 - source.height * source.dy, source.x0 + source.width * source.dx, source.y0)
    if res is None:
        res = (math.hypot(right - left, top - bottom) / math.hypot(source.width, source.height),) * 2
    if not (res[0] > 0 and res[1] > 0):
        raise ValueError("a resolution must be positive")
    size = lambda extent, step: max(1, math.ceil(extent / step - 1e-9))
    return Grid(crs, left, top, res[0], res[1], size(right - left, res[0]), size(top - bottom, res[1]))


def unit_crs(spark: SparkSession, source: Grid, unit: str) -> str:
    """The system in which a resolution of this unit counts: the source's own, degrees, or metres (the local zone of the grid's middle)."""
    if unit == "source" or unit == "metres" and source.crs != "EPSG:4326":
        return source.crs
    if unit == "degrees":
        return "EPSG:4326"
    if unit != "metres":
        raise ValueError(f"a unit is source, degrees or metres, not {unit}")
    left, bottom, right, top = bounds_in(spark, source, "EPSG:4326")
    # A grid may run on beyond a pole: its middle is a place on the other side then.
    middle = normal_position(F.lit((left + right) / 2), F.lit((bottom + top) / 2))
    return "EPSG:" + str(spark.range(1).select(utm_zone(*middle)).first()[0])


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


def _spline(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 2 / 3 - x**2 + x**3 / 2, np.where(x < 2, (2 - x) ** 3 / 6, 0))


#: Kernels with their radius, for places a pixel apart.
KERNELS: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray]]] = {
    "nearest": (0, lambda x: np.ones_like(x)), "bilinear": (1, lambda x: np.maximum(1 - np.abs(x), 0)), "cubic": (2, _cubic), "cubic_spline": (2, _spline),
    "lanczos": (3, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)),
}


def _sampler(method: str, scale: tuple[float, float], halo: tuple[int, int], block: int) -> Callable:
    _, kernel = KERNELS[method]

    def run(places: pa.Table, pixels: pa.Table) -> pa.Table:
        if not places.num_rows or not pixels.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "col": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        r0, c0 = (places.column(b)[0].as_py() * block - h for b, h in zip(("br", "bc"), halo, strict=True))
        source = np.full((block + 2 * halo[0] + 1, block + 2 * halo[1] + 1), np.nan)
        source[pixels.column("row").to_numpy() - r0, pixels.column("col").to_numpy() - c0] = pixels.column("value").to_numpy()
        fr, fc = places.column("fr").to_numpy() - r0, places.column("fc").to_numpy() - c0
        near = source[np.floor(fr).astype(int), np.floor(fc).astype(int)]
        value = near
        if method != "nearest":
            total, weight = np.zeros(len(fr)), np.zeros(len(fr))
            base_r, base_c = np.floor(fr - 0.5).astype(int), np.floor(fc - 0.5).astype(int)
            for i in range(1 - halo[0], halo[0] + 1):
                wr = kernel((base_r + i + 0.5 - fr) / scale[0])
                for j in range(1 - halo[1], halo[1] + 1):
                    v = source[base_r + i, base_c + j]
                    w = np.where(np.isnan(v), 0, wr * kernel((base_c + j + 0.5 - fc) / scale[1]))
                    total, weight = total + w * np.nan_to_num(v), weight + w
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(weight > 1e-6, total / weight, near)
        keep = pa.array(~np.isnan(near))
        return pa.table({"row": places.column("row"), "col": places.column("col"), "value": pa.array(value)}).filter(keep)

    return run


def sample(places: DataFrame, pixels: DataFrame, value: str, method: str, scale: tuple[float, float] = (1.0, 1.0), block: int = BLOCK) -> DataFrame:
    """(row, col, value) of places(row, col, fr, fc), whose fractional source place is (fr, fc), among pixels(row, col, value).

    scale: how many source pixels one target pixel spans (down, across); kernels widen with it where it is above one.
    """
    if method not in KERNELS:
        raise ValueError(f"a method is one of {', '.join(KERNELS)}, not {method}")
    scale = tuple(max(1.0, s) for s in scale)
    halo = tuple(math.ceil(KERNELS[method][0] * s) for s in scale)
    if max(halo) > block:
        raise ValueError("a kernel reaches one block at most")
    dealt = places.filter("fr is not null and fc is not null and not isnan(fr) and not isnan(fc)").select("row", "col", "fr", "fc", F.expr(f"floor(fr / {block})").alias("br"), F.expr(f"floor(fc / {block})").alias("bc"))
    sees = lambda at, h: F.explode(F.array_distinct(F.array(*(F.expr(f"floor(({at} + {d}) / {block})") for d in ((0,) if not h else (-h, 0, h))))))
    pixels = pixels.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col(value).cast("double").alias("value")).filter("value is not null and not isnan(value) and row is not null and col is not null")
    sent = pixels.select("row", "col", "value", sees("row", halo[0]).alias("br")).withColumn("bc", sees("col", halo[1])).toDF("row", "col", "value", "br", "bc")
    return dealt.groupBy("br", "bc").cogroup(sent.groupBy("br", "bc")).applyInArrow(_sampler(method, scale, halo, block), "row long, col long, value double")


def places_in(spark: SparkSession, target: Grid, source: Grid) -> DataFrame:
    """Every target pixel with its center's fractional place in the source, where it lies in it."""
    cells = spark.range(target.width * target.height).select(F.expr(f"id div {target.width}").alias("row"), F.expr(f"id % {target.width}").alias("col"))
    x, y = target.x0 + (F.col("col") + 0.5) * target.dx, target.y0 - (F.col("row") + 0.5) * target.dy
    if target.crs != source.crs:
        x, y = to_crs(source.crs, *from_crs(target.crs, x, y))
    found = cells.select("row", "col", ((source.y0 - y) / source.dy).alias("fr"), ((x - source.x0) / source.dx).alias("fc"))
    return found.filter((F.col("fr") >= 0) & (F.col("fr") < source.height) & (F.col("fc") >= 0) & (F.col("fc") < source.width))


def reproject(pixels: DataFrame, value: str, source: Grid, target: Grid, method: str = "nearest", block: int = BLOCK) -> DataFrame:
    """(row, col, value) of the target grid's pixels; invalid and uncovered ones have no row."""
    scale = (target.dy / source.dy, target.dx / source.dx) if target.crs == source.crs else (1.0, 1.0)
    return sample(places_in(pixels.sparkSession, target, source), pixels, value, method, scale, block)


def resample(pixels: DataFrame, value: str, source: Grid, res: tuple[float, float], unit: str = "source", method: str = "bilinear") -> tuple[DataFrame, Grid]:
    """(row, col, value) at another pixel size in source units, degrees or metres, and the new grid.

    Kernels sample at target centers; average, max, min, med, q1, q3 and mode take the pixels whose centers a target cell holds.
    """
    spark = pixels.sparkSession
    target = target_grid(spark, source, unit_crs(spark, source, unit), res)
    if method not in AGGREGATES:
        return reproject(pixels, value, source, target, method), target
    x, y = source.x0 + (F.col("col") + 0.5) * source.dx, source.y0 - (F.col("row") + 0.5) * source.dy
    if target.crs != source.crs:
        x, y = to_crs(target.crs, *from_crs(source.crs, x, y))
    cells = pixels.select(F.floor((target.y0 - y) / target.dy).alias("row"), F.floor((x - target.x0) / target.dx).alias("col"), F.col(value).cast("double").alias("value"))
    return cells.filter("value is not null and not isnan(value)").groupBy("row", "col").agg(AGGREGATES[method]("value").alias("value")), target


def fit_control_points(points: DataFrame, key: str) -> DataFrame:
    """Least-squares affine transforms of points(key, row, col, x, y): x = ax * col + bx * row + cx, y likewise.

    One row per key: ax, bx, cx, ay, by, cy, points, error. Fewer than three points, or points on one line, have an error and
    no coefficients. Moments are partial sums, so a key of any size is summed map-side.
    """
    p = points.filter("row is not null and col is not null and x is not null and y is not null")
    moments = {f"s_{a}{b}": F.covar_pop(a, b) for a, b in (("col", "col"), ("col", "row"), ("row", "row"), ("col", "x"), ("row", "x"), ("col", "y"), ("row", "y"))}
    m = p.groupBy(key).agg(F.count("*").alias("points"), *(F.avg(c).alias(f"m_{c}") for c in ("col", "row", "x", "y")), *(v.alias(n) for n, v in moments.items()))
    s = lambda a, b: F.col(f"s_{a}{b}")
    det = s("col", "col") * s("row", "row") - s("col", "row") * s("col", "row")
    error = F.when(F.col("points") < 3, "fewer than three points").when(det <= 1e-9 * s("col", "col") * s("row", "row"), "points on one line")
    m = m.withColumn("error", error)
    out = [key]
    for to in ("x", "y"):
        a = (s("col", to) * s("row", "row") - s("row", to) * s("col", "row")) / det
        b = (s("row", to) * s("col", "col") - s("col", to) * s("col", "row")) / det
        c = F.col(f"m_{to}") - a * F.col("m_col") - b * F.col("m_row")
        out += [F.when(F.col("error").isNull(), v).alias(f"{n}{to}") for n, v in (("a", a), ("b", b), ("c", c))]
    return m.select(*out, "points", "error")


def residuals(points: DataFrame, fits: DataFrame, key: str) -> DataFrame:
    """(key, rms): root mean square distance of control points from where their transform puts them."""
    off = lambda to: F.col(f"a{to}") * F.col("col") + F.col(f"b{to}") * F.col("row") + F.col(f"c{to}") - F.col(to)
    met = points.join(fits.filter("error is null"), key)
    return met.groupBy(key).agg(F.sqrt(F.avg(off("x") * off("x") + off("y") * off("y"))).alias("rms"))


def correct(pixels: DataFrame, value: str, transform: tuple[float, float, float, float, float, float], height: int, width: int, crs: str, method: str = "bilinear", res: tuple[float, float] | None = None) -> tuple[DataFrame, Grid]:
    """Pixels under an affine transform (ax, bx, cx, ay, by, cy: x = ax * col + bx * row + cx) on the north-up grid that holds them."""
    ax, bx, cx, ay, by, cy = transform
    det = ax * by - bx * ay
    if abs(det) < 1e-15:
        raise ValueError("the transform has no inverse")
    corners = [(ax * c + bx * r + cx, ay * c + by * r + cy) for c in (0, width) for r in (0, height)]
    left, top = min(x for x, _ in corners), max(y for _, y in corners)
    res = res or (math.hypot(ax, ay), math.hypot(bx, by))
    size = lambda extent, step: max(1, math.ceil(extent / step - 1e-9))
    target = Grid(crs, left, top, res[0], res[1], size(max(x for x, _ in corners) - left, res[0]), size(top - min(y for _, y in corners), res[1]))
    cells = pixels.sparkSession.range(target.width * target.height).select(F.expr(f"id div {target.width}").alias("row"), F.expr(f"id % {target.width}").alias("col"))
    x, y = target.x0 + (F.col("col") + 0.5) * target.dx - cx, target.y0 - (F.col("row") + 0.5) * target.dy - cy
    places = cells.select("row", "col", ((ax * y - ay * x) / det).alias("fr"), ((by * x - bx * y) / det).alias("fc")).filter(f"fr >= 0 and fr < {height} and fc >= 0 and fc < {width}")
    return sample(places, pixels, value, method), target
