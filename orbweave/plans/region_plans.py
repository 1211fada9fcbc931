"""Queries over regions: polygons of a classified grid, the footprint of valid pixels, polygons cut by polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlay, regions, vector as X
from . import views as V
from .registry import register
from .shape_plans import cutters
from .spatial_plans import L_SHAPE, LABELS, over

#: What every polygon of a label must come to: counts of its pixels, sides and corners. A corner is where one or three of
#: the four pixels around a point belong to the region; two that only touch there make two corners and part two rings.
COUNTS = f"""{LABELS},
 w AS (SELECT label, row + i AS y, col + j AS x, count(*) AS n, count(*) FILTER (i = j) AS d FROM l, range(2) a(i), range(2) b(j) GROUP BY ALL),
 k AS (SELECT label, count(*) FILTER (n = 4) AS inner_points, count(*) FILTER (n = 2 AND d <> 1) AS touching, count(*) FILTER (n IN (1, 3)) + 2 * count(*) FILTER (n = 2 AND d <> 1) AS corners FROM w GROUP BY label),
 e AS (SELECT label, count(*) AS joints FROM adj JOIN l ON l.id = adj.a GROUP BY label),
 f AS (SELECT label, any_value(v) AS v, count(*) AS pixels, min(col) AS xmin, max(col) + 1 AS xmax, min(row) AS ymin, max(row) + 1 AS ymax FROM l GROUP BY label)
 SELECT label // 4294967296 AS label_row, label % 4294967296 AS label_col, {{value}}pixels::DOUBLE AS area, (4 * pixels - 2 * coalesce(joints, 0))::BIGINT AS perimeter,
  (1 - pixels + coalesce(joints, 0) - inner_points + touching)::BIGINT AS holes, corners::BIGINT AS corners, xmin, xmax, ymin, ymax FROM f JOIN k USING (label) LEFT JOIN e USING (label)"""


def counted(found, *value):
    side = lambda f, c: f(F.transform("outer", lambda p: p[c]))
    corners = F.aggregate("holes", F.size("outer") - 1, lambda t, h: t + F.size(h) - 1).cast("long")
    return found.select(
        "label_row", "label_col", *value, "area", "perimeter", F.size("holes").cast("long").alias("holes"), corners.alias("corners"),
        side(F.array_min, "x").alias("xmin"), side(F.array_max, "x").alias("xmax"), side(F.array_min, "y").alias("ymin"), side(F.array_max, "y").alias("ymax"),
    )


def classes(s, d):
    return V.dem(s, d).select("row", "col", F.floor(F.col("z") / 250).cast("double").alias("v"))


def valid(s, d):
    """Pixels whose fifth band is not below its noise floor."""
    return V.grid_bands(s, d).filter("b5 >= 0.25").select("row", "col")


register("raster_to_vector", lambda s, d: counted(regions.polygons(classes(s, d), "v", max_features=10_000_000), "value"), over(f", x AS (SELECT row, col, floor(z / 250)::DOUBLE AS v FROM dem WHERE z >= 250), {COUNTS.format(value='v AS value, ')}"))
register("raster_to_vector_mask", lambda s, d: counted(regions.polygons(V.dem(s, d).select("row", "col", (F.col("z") > 300).cast("int").alias("mask")), "mask")), over(f", x AS (SELECT row, col, 1.0::DOUBLE AS v FROM dem WHERE z > 300), {COUNTS.format(value='')}"))
register("valid_footprint", lambda s, d: counted(regions.footprint(valid(s, d))), over(f", x AS (SELECT row, col, 1.0::DOUBLE AS v FROM grid_bands WHERE b5 >= 0.25), {COUNTS.format(value='')}", "grid_bands"))


def frames(s, d):
    """Cutting boxes with a hole in their middle."""
    w, h = "(x1 - x0)", "(y1 - y0)"
    b = cutters(s, d).selectExpr("box_id as clip_id", "x0", "y0", "x1", "y1", f"x0 + 0.3D * {w} as u0", f"y0 + 0.3D * {h} as v0", f"x0 + 0.7D * {w} as u1", f"y0 + 0.7D * {h} as v1")
    ring = lambda *c: X.box_ring(*(F.col(x) for x in c))
    return b.select("clip_id", F.array(ring("x0", "y0", "x1", "y1"), ring("u0", "v0", "u1", "v1")).alias("rings"))


def shapes(s, d):
    return L_SHAPE(s, d).select("zone_id", F.array("ring").alias("rings"))


def share(a: str, b: str) -> str:
    """Common area of two boxes, each with columns named by a prefix."""
    return f"greatest(least({a}x1, {b}x1) - greatest({a}x0, {b}x0), 0) * greatest(least({a}y1, {b}y1) - greatest({a}y0, {b}y0), 0)"


CLIPPED = f"""z AS (SELECT zone_id, greatest(w, h) * 2 AS size, c0 AS zx0, r0 AS zy0, c0 + 2 * w AS zx1, r0 + 2 * h AS zy1, c0 + w AS qx0, r0 AS qy0, c0 + 2 * w AS qx1, r0 + h AS qy1 FROM boxes),
 o AS (SELECT zone_id AS clip_id, c0 + w / 2.0::DOUBLE AS ox0, r0 + h / 2.0::DOUBLE AS oy0, c0 + w * 1.5::DOUBLE AS ox1, r0 + h * 1.5::DOUBLE AS oy1, w, h FROM boxes),
 f AS (SELECT *, ox0 + 0.3::DOUBLE * w AS hx0, oy0 + 0.3::DOUBLE * h AS hy0, ox0 + 0.7::DOUBLE * w AS hx1, oy0 + 0.7::DOUBLE * h AS hy1 FROM o),
 c AS (SELECT zone_id, clip_id, size, {share('z', 'o')} - ({share('q', 'o')}) - ({share('z', 'h')}) + {share('q', 'h')} AS area FROM z JOIN f ON zx0 < ox1 AND ox0 < zx1 AND zy0 < oy1 AND oy0 < zy1)"""
register("clip_vector_polygons", lambda s, d: overlay.clip(shapes(s, d), frames(s, d)).select("zone_id", "clip_id", F.round(F.col("area") + 3e-6, 4).alias("area")), V.with_views(f", {CLIPPED} SELECT zone_id, clip_id, round(area + 3e-6, 4) AS area FROM c WHERE area > 1e-7 * size * size", "boxes"))
register("clip_vector_report", lambda s, d: overlay.clip_report(shapes(s, d), overlay.kept(shapes(s, d), frames(s, d).filter("clip_id % 5 = 0"))), V.with_views(f", {CLIPPED}, k AS (SELECT DISTINCT zone_id FROM c WHERE clip_id % 5 = 0 AND area > 1e-7 * size * size) SELECT count(*) AS features, (SELECT count(*) FROM k) AS kept, count(*) - (SELECT count(*) FROM k) AS dropped FROM boxes", "boxes"))
