"""Queries over rings on the globe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import globe
from . import views as V
from .registry import register


def triangles(s, d):
    """A triangle east of each customer, 40 degrees wide; some cross the antimeridian."""
    p = lambda dx, dy: F.struct((F.floor("lon") + dx).cast("double").alias("x"), (F.round(F.col("lat") * 0.9, 2) + dy).alias("y"))
    return V.features(s, d).select("feature_id", F.array(F.array(p(0, 0.0), p(40, 0.0), p(20, 15.0), p(0, 0.0))).alias("rings"))


BASE = "t AS (SELECT feature_id, floor(lon) AS x, round(lat * 0.9::DOUBLE, 2) AS y FROM features)"
SIDE = "acos(greatest(least(cos(radians({a})) * cos(radians({b})) * cos(radians({w})) + sin(radians({a})) * sin(radians({b})), 1), -1))"
STEPS = " + ".join(f"greatest(1, ceil(degrees({SIDE.format(a=a, b=b, w=w)}) / 5 - 1e-9))" for a, b, w in (("y", "y", 40), ("y", "y + 15", 20), ("y + 15", "y", 20)))
register("geom_densify", lambda s, d: globe.dense_rings(triangles(s, d), "feature_id").groupBy("feature_id").agg(F.count("*").alias("points"), F.max("turns").alias("turns"), F.round(F.min("x"), 6).alias("west"), F.round(F.max("x"), 6).alias("east")), V.with_views(f", {BASE} SELECT feature_id, ({STEPS})::BIGINT AS points, 0 AS turns, x AS west, x + 40 AS east FROM t", "features"))


def split(s, d):
    found = globe.split_polygons(triangles(s, d), "feature_id")
    xs = F.transform(F.flatten("rings"), lambda p: p["x"])
    return found.select("feature_id", "world", "parts", "holes", F.round(F.array_min(xs), 4).alias("west"), F.round(F.array_max(xs), 4).alias("east"))


register("geom_split_antimeridian_polygons", split, V.with_views(f""", {BASE} SELECT feature_id, 0::BIGINT AS world, 1::BIGINT AS parts, 0::BIGINT AS holes, x AS west, least(x + 40, 180) AS east FROM t
 UNION ALL SELECT feature_id, 1, 1, 0, -180, x + 40 - 360 FROM t WHERE x + 40 > 180""", "features"))
