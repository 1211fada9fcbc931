"""Rings and paths: validity, clipping by boxes, simplification, the antimeridian; samples of grids at points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .graph import stored
from .overlay import candidates, shared_shapes, spread

RING = "array<struct<x:double,y:double>>"
TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")


def segments(ring: Column) -> Column:
    return F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))


def _side(o: Column, a: Column, b: Column) -> Column:
    return F.signum((a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"]))


def ring_is_valid(ring: Column) -> Column:
    """Closed, of at least four points, without two sides that cross (every side is tested against all others)."""
    cross = lambda s, t: (_side(s["a"], s["b"], t["a"]) * _side(s["a"], s["b"], t["b"]) < 0) & (_side(t["a"], t["b"], s["a"]) * _side(t["a"], t["b"], s["b"]) < 0)
    parts = segments(ring)
    crossing = F.exists(parts, lambda s: F.exists(parts, lambda t: cross(s, t)))
    return F.coalesce((F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)) & ~crossing, F.lit(False))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _half_plane(ring: Column, axis: str, limit: Column, low: bool) -> Column:
    """A closed ring on one side of a line along an axis, closed again; empty where nothing is left."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: p[axis] >= limit if low else p[axis] <= limit

    def met(a: Column, b: Column) -> Column:
        along = a[other] + (b[other] - a[other]) * (limit - a[axis]) / (b[axis] - a[axis])
        ends = {axis: limit, other: along}
        return F.when(inside(a) != inside(b), F.struct(ends["x"].alias("x"), ends["y"].alias("y")))

    n = F.greatest(F.size(ring) - 1, F.lit(0))
    sides = F.arrays_zip(F.slice(ring, 1, n).alias("a"), F.slice(ring, 2, n).alias("b"))
    points = F.flatten(F.transform(sides, lambda s: F.array_compact(F.array(met(s["a"], s["b"]), F.when(inside(s["b"]), F.struct(s["b"]["x"].alias("x"), s["b"]["y"].alias("y")))))))
    return _let(points, lambda p: F.when(F.size(p) > 0, F.concat(F.slice(p, -1, 1), p)).otherwise(p))


def clip_ring(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a closed ring inside a box, a closed ring again, half plane by half plane; empty where nothing is left."""
    cut = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    keep = lambda axis, limit, low: lambda r: _half_plane(r, axis, limit.cast("double"), low)
    for side in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        cut = _let(cut, keep(*side))
    return cut


def ring_area(ring: Column) -> Column:
    """Area in the ring's own plane."""
    return F.abs(F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def clip_zones(zones: DataFrame, boxes: DataFrame, sliver: float = 1e-10, whole: bool = False) -> DataFrame:
    """zones(zone_id, ring) cut by boxes(box_id, x0, y0, x1, y1): (zone_id, box_id, ring, area), slivers left out.

    whole: only zones of which a box cuts off nothing. Pairs are found by cells of each side's own size, four at most a level, so
    a zone of any extent costs the same. A shape is cut once by a box that lies the same way from it; copies are joined back.
    """
    xs, ys = F.transform("ring", lambda p: p["x"].cast("double")), F.transform("ring", lambda p: p["y"].cast("double"))
    level = F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9)))).cast("int")
    z = zones.filter("zone_id is not null and size(ring) > 0 and not exists(ring, p -> p.x is null or p.y is null)")
    z = z.select("zone_id", "ring", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")).withColumn("level", level)
    b = boxes.select("box_id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).filter("x0 < x1 and y0 < y1").withColumn("level", level)
    shapes, members = shared_shapes(z.withColumn("rings", F.array(F.col("ring").cast(RING))).drop("ring"), "zone_id")
    place, box = ["shape", "x0", "y0"], ["b_x0", "b_y0", "b_x1", "b_y1"]
    met = candidates(members.drop("zone_id").distinct(), b.drop("box_id").distinct())
    way = {"u0": F.col("b_x0") - F.col("x0"), "v0": F.col("b_y0") - F.col("y0"), "u1": F.col("b_x1") - F.col("x0"), "v1": F.col("b_y1") - F.col("y0")}
    met = stored(met.select(*place, *box, *(c.alias(n) for n, c in way.items())), "met")
    kinds = spread(met.select("shape", *way).distinct(), "shape", *way).join(shapes.select("shape", F.get("rings", F.lit(0)).alias("ring")), "shape")
    cut = clip_ring(F.col("ring"), *(F.col(n) for n in way))
    # One expression that keeps or drops a piece: a filter on it would be worked out a second time.
    area = lambda r: F.when(F.size(r) >= 4, ring_area(r)).otherwise(0.0)
    own = F.abs(ring_area(F.col("ring")) - F.col("area")) < 1e-9
    pieces = F.filter(F.transform(F.array(cut), lambda r: F.struct(r.alias("piece"), area(r).alias("area"))), lambda p: p["area"] > sliver)
    pieces = kinds.withColumn("p", F.explode(pieces)).select("shape", *way, "ring", "p.*")
    found = spread(met.join((pieces.filter(own) if whole else pieces).drop("ring"), ["shape", *way]), *place, *box)
    found = found.join(members.select("zone_id", *place), place).join(b.select("box_id", *(F.col(c[2:]).alias(c) for c in box)), box)
    return found.select("zone_id", "box_id", moved(F.col("piece"), lambda x, y: (x + F.col("x0"), y + F.col("y0"))).alias("ring"), "area")


def moved(ring: Column, to: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A ring with every point in another reference system."""

    def point(p: Column) -> Column:
        x, y = to(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, point)


def _thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    keep, todo = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base, rest = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*base)
        off = np.abs(base[0] * rest[:, 1] - base[1] * rest[:, 0]) / length if length else np.hypot(rest[:, 0], rest[:, 1])
        i = int(off.argmax())
        if off[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def simplified(lines: DataFrame, key: str, path: str, tolerance: float) -> DataFrame:
    """Points farther than the tolerance from the line of their neighbours stay; closed rings keep four points at least."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for line in part[path]:
                points = np.array([(p["x"], p["y"]) for p in line], float)
                keep = _thin(points, tolerance) if len(points) > 2 else np.ones(len(points), bool)
                if len(points) >= 4 and (points[0] == points[-1]).all() and keep.sum() < 4:
                    keep[:] = True
                rows.append([{"x": x, "y": y} for x, y in points[keep].tolist()])
            yield pd.DataFrame({key: part[key], path: rows})

    kind = dict(lines.dtypes)[key]
    lines = lines.filter(F.col(path).isNotNull() & ~F.exists(path, lambda p: p["x"].isNull() | p["y"].isNull()))  # no line, nothing to thin
    return lines.select(key, path).mapInPandas(run, f"{key} {kind}, {path} {RING}")


def split_antimeridian(paths: DataFrame, key: str) -> DataFrame:
    """paths(key, i, lon, lat), points in order: (key, i, part, lon0, lat0, lon1, lat1), no segment crossing 180 degrees.

    The shorter way round is taken; a segment that crosses is cut in two at the antimeridian.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("i")
    s = paths.select(key, "i", F.col("lon").alias("a"), F.col("lat").alias("lat0"), F.lead("lon").over(w).alias("b"), F.lead("lat").over(w).alias("lat1")).filter("b is not null")
    turn = F.when(F.col("b") - F.col("a") > 180, -360.0).when(F.col("b") - F.col("a") < -180, 360.0).otherwise(0.0)
    s = s.withColumn("turn", turn).withColumn("edge", F.when(F.col("turn") > 0, 180.0).otherwise(-180.0))
    share = (F.col("edge") - F.col("a")) / (F.col("b") + F.col("turn") - F.col("a"))
    cut = F.col("lat0") + share * (F.col("lat1") - F.col("lat0"))
    piece = lambda n, *v: F.struct(F.lit(n).alias("part"), *(x.cast("double").alias(c) for x, c in zip(v, ("lon0", "lat0", "lon1", "lat1"), strict=True)))
    both = F.array(piece(0, F.col("a"), F.col("lat0"), F.col("edge"), cut), piece(1, -F.col("edge"), cut, F.col("b"), F.col("lat1")))
    return s.select(key, "i", F.explode(F.when(F.col("turn") == 0, F.array(piece(0, F.col("a"), F.col("lat0"), F.col("b"), F.col("lat1")))).otherwise(both)).alias("p")).select(key, "i", "p.*")


def spherical(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Position on the unit sphere."""
    p, q = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)


def tile_bounds(x: Column, y: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of an XYZ tile in degrees; NULL outside the zoom's range."""
    n = 1 << zoom
    ok = x.between(0, n - 1) & y.between(0, n - 1)
    lat = lambda t: F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * t / n))))
    return tuple(F.when(ok, v) for v in (x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)))


def spectrum(points: DataFrame, pixels: DataFrame, bands: list[str], row: Column, col: Column) -> DataFrame:
    """points with the values of all bands at their pixel; error 'outside' or 'no valid band' where there is none."""
    at = points.withColumns({"row": F.floor(row), "col": F.floor(col)})
    found = at.join(pixels.select("row", "col", *bands, F.lit(True).alias("found")), ["row", "col"], "left")
    error = F.when(F.col("found").isNull(), "outside").when(F.coalesce(*bands).isNull(), "no valid band")
    return found.withColumn("error", error).drop("found")


def inset_samples(pixels: DataFrame, value: str, height: int, width: int, n: int = 9) -> DataFrame:
    """n x n inset sample pixels, row first from the upper left: (sample, row, col, value)."""
    at = lambda size: F.array(*(F.lit((2 * i + 1) * size // (2 * n)) for i in range(n)))
    places = pixels.sparkSession.range(1).select(F.posexplode(at(height)).alias("i", "row")).select("i", "row", F.posexplode(at(width)).alias("j", "col"))
    places = places.select((F.col("i") * n + F.col("j")).alias("sample"), F.col("row").cast("long"), F.col("col").cast("long"))
    return pixels.select("row", "col", value).join(F.broadcast(places), ["row", "col"]).select("sample", "row", "col", value)
