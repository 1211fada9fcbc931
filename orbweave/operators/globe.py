"""Rings on the globe: positions beyond a pole, great-circle sides, rings across the antimeridian or around a pole.

Defined cases: a position with a null or non-finite coordinate is left out; latitudes beyond a pole come down the other side;
sides between opposite positions go over the pole that is nearer; a ring of fewer than three different corners has no row; a ring
that goes around a pole is closed along that pole; only the outer ring of a polygon may do so; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import stored
from .overlay import clip, uncut
from .vector import box_ring

#: Turns around the globe, each way, that a ring may take.
WORLDS = 4
TINY = 1e-12


def normal_position(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The position with a latitude of -90 to 90 and a longitude of -180 up to 180."""
    y = F.pmod(lat + 90.0, F.lit(360.0))
    over = y > 180
    return F.pmod(lon + F.when(over, 360.0).otherwise(180.0), F.lit(360.0)) - 180.0, F.when(over, 270.0 - y).otherwise(y - 90.0)


def _xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def _angle(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    return F.acos(F.greatest(F.least(sum(a * b for a, b in zip(_xyz(lon0, lat0), _xyz(lon1, lat1), strict=True)), F.lit(1.0)), F.lit(-1.0)))


def _steps(angle: Column, step: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.degrees(angle) / step - 1e-9)).cast("int")


def _on_side(i: Column, steps: Column, angle: Column, lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """The position (x, y) after i of the steps of a side."""
    p, q = _xyz(lon0, lat0), _xyz(lon1, lat1)
    # Between opposite positions the way goes over the pole of the nearer hemisphere: its direction at the first end.
    pole = F.when(lat0 + lat1 < 0, -1.0).otherwise(1.0)
    up = (-pole * p[2] * p[0], -pole * p[2] * p[1], pole * (1 - p[2] * p[2]))
    size = F.sqrt(sum(u * u for u in up))
    t = i / steps
    opposite, same = F.lit(3.141592653589793) - angle < 1e-9, angle < TINY
    a = F.when(same, 1.0).when(opposite, F.cos(angle * t)).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    b = F.when(same, 0.0).when(opposite, F.sin(angle * t) / size).otherwise(F.sin(t * angle) / F.sin(angle))
    x, y, z = (a * u + b * F.when(opposite, v).otherwise(w) for u, v, w in zip(p, up, q, strict=True))
    return F.struct(F.when(i == 0, lon0).otherwise(F.degrees(F.atan2(y, x))).alias("x"), F.when(i == 0, lat0).otherwise(F.degrees(F.atan2(z, F.hypot(x, y)))).alias("y"))


def great_circle(lon0: Column, lat0: Column, lon1: Column, lat1: Column, step: float = 5.0) -> Column:
    """Positions (x, y) from a side's first end up to, but without, its last: equal steps of at most `step` degrees."""
    angle = _angle(lon0, lat0, lon1, lat1)
    steps = _steps(angle, step)
    return F.transform(F.sequence(F.lit(0), steps - 1), lambda i: _on_side(i, steps, angle, lon0, lat0, lon1, lat1))


def dense_rings(polygons: DataFrame, key: str, step: float = 5.0) -> DataFrame:
    """(key, ring, i, x, y, turns): the positions of each ring with great-circle sides and unbroken longitudes, without the closing one.

    turns is how often the whole ring goes around the globe eastward.
    """
    r = polygons.select(key, F.posexplode("rings").alias("ring", "points")).select(key, "ring", F.posexplode("points").alias("i", "p"))
    lon, lat = normal_position(F.col("p.x"), F.col("p.y"))
    r = r.filter("p.x is not null and p.y is not null and abs(p.x) < 1e9 and abs(p.y) < 1e9").select(key, "ring", "i", lon.alias("lon"), lat.alias("lat"))
    along, whole = Window.partitionBy(key, "ring").orderBy("i"), Window.partitionBy(key, "ring")
    r = r.withColumn("after", F.lead(F.struct("lon", "lat")).over(along)).filter("after is not null and (abs(after.lon - lon) > 1e-12 or abs(after.lat - lat) > 1e-12)")
    r = r.withColumn("corners", F.count("*").over(whole)).filter("corners >= 3")
    # Angles are worked out once a side, before its steps become rows: in an array's expression each step would do it several times.
    ends = [F.col(c) for c in ("lon", "lat", "lon1", "lat1")]
    r = r.select(key, "ring", "i", "lon", "lat", F.col("after.lon").alias("lon1"), F.col("after.lat").alias("lat1")).withColumn("angle", _angle(*ends)).withColumn("steps", _steps(F.col("angle"), step))
    r = r.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("steps") - 1))).withColumn("p", _on_side(F.col("j"), F.col("steps"), F.col("angle"), *ends)).select(key, "ring", F.struct("i", "j").alias("at"), "p.x", "p.y")
    # A jump of more than half the globe is a step across the antimeridian the other way.
    along = Window.partitionBy(key, "ring").orderBy("at")
    jump = lambda a, b: -F.round((a - b) / 360.0)
    r = r.withColumn("turn", F.coalesce(jump(F.col("x"), F.lag("x").over(along)), F.lit(0.0)))
    offset = F.sum("turn").over(along)
    last, first = F.last("x").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.first("x").over(along)
    total = F.sum("turn").over(whole) + jump(first, last)
    return r.select(key, "ring", (F.row_number().over(along) - 1).alias("i"), (F.col("x") + 360.0 * offset).alias("x"), "y", total.cast("int").alias("turns"))


def whole_rings(dense: DataFrame, key: str) -> DataFrame:
    """(key, rings): closed rings of dense positions; one that goes around the globe is closed along the pole on its side."""
    point = F.struct("x", "y")
    r = dense.groupBy(key, "ring", "turns").agg(F.array_sort(F.collect_list(F.struct("i", point.alias("p")))).alias("s"), F.avg("y").alias("middle"))
    points = F.transform("s", lambda e: e["p"])
    start, pole = points[0], F.when(F.col("middle") < 0, -90.0).otherwise(90.0)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    far = start["x"] + 360.0 * F.col("turns")
    ring = F.when(F.col("turns") == 0, F.concat(points, F.array(start))).otherwise(F.concat(points, F.array(at(far, start["y"]), at(far, pole), at(start["x"], pole), start)))
    rings = r.select(key, "ring", ring.alias("points")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("by"))
    # Holes lie in the same world as the outer ring.
    rings = rings.select(key, F.transform("by", lambda e: e["points"]).alias("rings"))
    west = F.get(F.get("rings", F.lit(0)), F.lit(0))["x"]
    near = lambda r: 360.0 * F.round((west - r[0]["x"]) / 360.0)
    return rings.select(key, F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] + near(r)).alias("x"), p["y"].alias("y")))).alias("rings"))


def split_polygons(polygons: DataFrame, key: str, step: float = 5.0) -> DataFrame:
    """(key, world, rings, parts, holes) of polygons(key, rings of lon, lat): great-circle sides, cut at the antimeridian, longitudes of -180 to 180.

    Equal polygons are worked on once and joined back to all their keys; only those that leave their world are cut.
    """
    spark = polygons.sparkSession
    shapes = stored(polygons.select("rings").filter("rings is not null").distinct().withColumn("_shape", F.monotonically_increasing_id()), "polygons")
    whole = stored(whole_rings(dense_rings(shapes, "_shape", step), "_shape"), "whole")
    xs = F.transform(F.flatten("rings"), lambda p: p["x"])
    world = F.floor((F.array_min(xs) + 180.0) / 360.0)
    alone = F.array_max(xs) <= world * 360.0 + 180.0
    inside = uncut(whole.filter(alone), "_shape").withColumn("world", world).filter(F.abs("world") <= WORLDS)
    worlds = spark.range(-WORLDS, WORLDS + 1).select(F.col("id").alias("world"), F.array(box_ring(F.col("id") * 360.0 - 180.0, F.lit(-91.0), F.col("id") * 360.0 + 180.0, F.lit(91.0))).alias("rings"))
    found = clip(whole.filter(~alone), worlds, "_shape", "world").unionByName(inside)
    within = lambda v, most: F.greatest(F.least(v, F.lit(most)), F.lit(-most))
    moved = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(within(p["x"] - 360.0 * F.col("world"), 180.0).alias("x"), within(p["y"], 90.0).alias("y"))))
    found = found.select("_shape", "world", moved.alias("rings"), "parts", "holes")
    return polygons.join(shapes, "rings").select(key, "_shape").join(found, "_shape").select(key, "world", "rings", "parts", "holes")
