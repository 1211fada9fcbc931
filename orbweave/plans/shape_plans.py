"""Queries over rings, paths, tiles, and samples of grids at points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as R, shapes as P, vector as X
from ..operators.overlay import validity
from . import views as V
from .pixel_plans import at, rounded
from .registry import register
from .spatial_plans import H, L_SHAPE, boxes_ring, height, over, shown


def cutters(s, d):
    """Boxes that cut zones: the supplier boxes moved by half their size."""
    return V.boxes(s, d).selectExpr("zone_id as box_id", "c0 + w / 2D as x0", "r0 + h / 2D as y0", "c0 + w / 2D + w as x1", "r0 + h / 2D + h as y1")


CUT = "b AS (SELECT zone_id AS box_id, c0 + w / 2.0::DOUBLE AS x0, r0 + h / 2.0::DOUBLE AS y0, c0 + w / 2.0::DOUBLE + w AS x1, r0 + h / 2.0::DOUBLE + h AS y1 FROM boxes)"
SHARE = "greatest(least(z.c0 + z.w, b.x1) - greatest(z.c0, b.x0), 0) * greatest(least(z.r0 + z.h, b.y1) - greatest(z.r0, b.y0), 0)"
register("clip_vector_clip", lambda s, d: P.clip_zones(boxes_ring(s, d), cutters(s, d)).select("zone_id", "box_id", F.round("area", 6).alias("area")), over(f", {CUT} SELECT z.zone_id, b.box_id, round({SHARE}, 6) AS area FROM boxes z JOIN b ON {SHARE} > 1e-10", "boxes"))


def within(s, d):
    """Zones that lie inside a cutting box: what the box leaves of them is all of them."""
    big = cutters(s, d).selectExpr("box_id", "x0 - 6 as x0", "y0 - 6 as y0", "x1 + 6 as x1", "y1 + 6 as y1")
    return P.clip_zones(boxes_ring(s, d), big, whole=True).select("zone_id", "box_id")


register("clip_vector_within", within, over(f", {CUT} SELECT z.zone_id, b.box_id FROM boxes z JOIN b ON z.c0 >= b.x0 - 6 AND z.c0 + z.w <= b.x1 + 6 AND z.r0 >= b.y0 - 6 AND z.r0 + z.h <= b.y1 + 6", "boxes"))


def crooked(s, d):
    """Rings of boxes; every third crosses itself, every seventh is not closed."""
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    v = V.boxes(s, d).selectExpr("zone_id", "c0 as x0", "r0 as y0", "c0 + w as x1", "r0 + h as y1")
    plain, bow = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0")), F.array(p("x0", "y0"), p("x1", "y1"), p("x1", "y0"), p("x0", "y1"), p("x0", "y0"))
    return v.select("zone_id", F.when(F.col("zone_id") % 3 == 0, bow).when(F.col("zone_id") % 7 == 0, F.slice(plain, 1, 4)).otherwise(plain).alias("ring"))


def with_holes(s, d):
    """Crooked rings, every other one with a hole; every tenth hole sticks out of its polygon."""
    p = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    v = V.boxes(s, d).selectExpr("zone_id", "c0 + w / 4D as x0", "r0 + h / 4D as y0", "c0 + w * if(zone_id % 10 = 0, 2, 0.5D) as x1", "r0 + h / 2D as y1")
    hole = v.select(F.col("zone_id").alias("z"), F.array(p("x0", "y0"), p("x0", "y1"), p("x1", "y1"), p("x1", "y0"), p("x0", "y0")).alias("hole"))
    rings = F.when(F.col("zone_id") % 2 == 0, F.array("ring", "hole")).otherwise(F.array("ring"))
    return crooked(s, d).join(hole, F.col("zone_id") == F.col("z")).select("zone_id", rings.alias("rings"))


register("geom_is_valid", lambda s, d: validity(crooked(s, d).select("zone_id", F.array("ring").alias("rings")), "zone_id").select("zone_id", "valid"), over("SELECT zone_id, zone_id % 3 <> 0 AND zone_id % 7 <> 0 AS valid FROM boxes", "boxes"))
register("geom_is_valid_with_holes", lambda s, d: validity(with_holes(s, d), "zone_id"), over("SELECT zone_id, reason IS NULL AS valid, reason FROM (SELECT zone_id, CASE WHEN zone_id % 3 <> 0 AND zone_id % 7 = 0 THEN 'not closed' WHEN zone_id % 3 = 0 OR zone_id % 10 = 0 THEN 'sides cross' END AS reason FROM boxes)", "boxes"))
kind = "CASE zone_id % 4 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'Circle' WHEN 2 THEN 'MultiPoint' ELSE 'Curve' END"
register("geom_type_guard", lambda s, d: V.boxes(s, d).select("zone_id", F.expr(kind).alias("kind")).withColumn("allowed", F.col("kind").isin(*P.TYPES)), over(f"SELECT zone_id, {kind} AS kind, zone_id % 2 = 0 AS allowed FROM boxes", "boxes"))


def reprojected(s, d):
    moved = boxes_ring(s, d).select("zone_id", F.posexplode(P.moved(F.col("ring"), R.to_mercator)).alias("i", "p"))
    return moved.select("zone_id", "i", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


register("geom_reproject", reprojected, over("SELECT zone_id, i::INTEGER AS i, round(radians(c0 + CASE WHEN i IN (1, 2) THEN w ELSE 0 END) * 6378137.0::DOUBLE, 3) AS x, round(ln(tan(pi() / 4 + radians(r0 + CASE WHEN i IN (2, 3) THEN h ELSE 0 END) / 2)) * 6378137.0::DOUBLE, 3) AS y FROM boxes, range(5) t(i)", "boxes"))
register("geom_simplify", lambda s, d: P.simplified(L_SHAPE(s, d).select("zone_id", F.flatten(F.transform("ring", lambda p: F.array(p, p))).alias("ring")), "zone_id", "ring", 0.01).select("zone_id", F.size("ring").alias("points")), over("SELECT zone_id, 7 AS points FROM boxes", "boxes"))


def paths(s, d):
    """A path over the customers of each nation in order of their number."""
    return V.features(s, d).select("layer_id", F.col("feature_id").alias("i"), "lon", "lat")


register("geom_split_antimeridian", lambda s, d: rounded(P.split_antimeridian(paths(s, d), "layer_id"), "lon0", "lat0", "lon1", "lat1"), over("""
 , s AS (SELECT layer_id, feature_id AS i, lon AS a, lat AS lat0, lead(lon) OVER w AS b, lead(lat) OVER w AS lat1 FROM features WINDOW w AS (PARTITION BY layer_id ORDER BY feature_id)),
 t AS (SELECT *, CASE WHEN b - a > 180 THEN -360 WHEN b - a < -180 THEN 360 ELSE 0 END AS turn, CASE WHEN b - a < -180 THEN 180.0::DOUBLE ELSE -180.0::DOUBLE END AS edge FROM s WHERE b IS NOT NULL),
 c AS (SELECT *, lat0 + (edge - a) / (b + turn - a) * (lat1 - lat0) AS cut FROM t)
 SELECT layer_id, i, 0 AS part, round(a, 6) AS lon0, round(lat0, 6) AS lat0, round(CASE WHEN turn = 0 THEN b ELSE edge END, 6) AS lon1, round(CASE WHEN turn = 0 THEN lat1 ELSE cut END, 6) AS lat1 FROM c
 UNION ALL SELECT layer_id, i, 1, round(-edge, 6), round(cut, 6), round(b, 6), round(lat1, 6) FROM c WHERE turn <> 0""", "features"))
register("spherical_position", lambda s, d: shown(s, d, *(F.round(c, 6).alias(n) for c, n in zip(P.spherical(at.lon, at.lat), ("x", "y", "z"), strict=True))), over("SELECT feature_id, round(cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) AS y, round(sin(radians(lat)), 6) AS z FROM features", "features"))


def tiles(s, d):
    t = V.features(s, d).select(*(c.alias(n) for c, n in zip(X.tile_of(at.lon, at.lat, 6), ("x", "y"), strict=True))).distinct()
    return t.select("x", "y", *(F.round(c, 6).alias(n) for c, n in zip(P.tile_bounds(F.col("x"), F.col("y"), 6), ("west", "south", "east", "north"), strict=True)))


LATITUDE = "round(degrees(atan((exp(pi() * (1 - 2 * {0} / 64.0::DOUBLE)) - exp(-pi() * (1 - 2 * {0} / 64.0::DOUBLE))) / 2)), 6)"
register("tile_bounds", tiles, over(f""", t AS (SELECT DISTINCT greatest(least(floor((lon + 180) / 360 * 64)::BIGINT, 63), 0) AS x, greatest(least(floor((1 - ln(tan(p) + 1 / cos(p)) / pi()) / 2 * 64)::BIGINT, 63), 0) AS y
 FROM (SELECT *, radians(greatest(least(lat, 85.05112878::DOUBLE), -85.05112878::DOUBLE)) AS p FROM features))
 SELECT x, y, round(x / 64.0::DOUBLE * 360 - 180, 6) AS west, {LATITUDE.format('(y + 1)')} AS south, round((x + 1) / 64.0::DOUBLE * 360 - 180, 6) AS east, {LATITUDE.format('y')} AS north FROM t""", "features"))


def spectra(s, d):
    """Band values at every feature, the grid lying over the globe at two degrees of latitude and three of longitude."""
    return P.spectrum(V.features(s, d).select("feature_id", "lon", "lat"), V.grid_bands(s, d), ["b1", "b2", "b3", "b4", "b5", "b6"], (at.lat + 80) / 2, (at.lon + 180) / 3)


register("query_spectrum", lambda s, d: spectra(s, d).select("feature_id", "row", "col", "b1", "b4", "b6", "error"), over("SELECT feature_id, f.row, f.col, b1, b4, b6, CASE WHEN g.row IS NULL THEN 'outside' END AS error FROM (SELECT feature_id, floor((lat + 80) / 2)::BIGINT AS row, floor((lon + 180) / 3)::BIGINT AS col FROM features) f LEFT JOIN grid_bands g ON g.row = f.row AND g.col = f.col", "features", "grid_bands"))
register("grid_sample", lambda s, d: P.inset_samples(V.dem(s, d), "z", height(s, d), 128), over(f"SELECT i * 9 + j AS sample, row, col, z FROM (SELECT i, j, (2 * i + 1) * {H} // 18 AS r, (2 * j + 1) * 128 // 18 AS c FROM range(9) a(i), range(9) b(j)) JOIN dem ON row = r AND col = c"))


def geometry(s, d):
    """WGS84 bounds and center of scenes whose native bounds are in Mercator metres."""
    x, y = R.to_mercator(at.lon, at.lat)
    native = V.scenes(s, d).select("scene_id", (x - 1000).alias("x0"), (y - 1000).alias("y0"), (x + 1000).alias("x1"), (y + 1000).alias("y1"))
    (w, so), (e, n) = R.from_mercator(F.col("x0"), F.col("y0")), R.from_mercator(F.col("x1"), F.col("y1"))
    return native.select("scene_id", *(F.round(c, 7).alias(k) for k, c in (("west", w), ("south", so), ("east", e), ("north", n), ("center_lon", (w + e) / 2), ("center_lat", (so + n) / 2))))


BACK = "degrees(2 * atan(exp({0})) - pi() / 2)"
register("scene_geometry", geometry, over(f""", m AS (SELECT scene_id, radians(lon) * 6378137.0::DOUBLE AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE AS y FROM scenes),
 b AS (SELECT scene_id, degrees((x - 1000) / 6378137.0::DOUBLE) AS w, {BACK.format('(y - 1000) / 6378137.0::DOUBLE')} AS s, degrees((x + 1000) / 6378137.0::DOUBLE) AS e, {BACK.format('(y + 1000) / 6378137.0::DOUBLE')} AS n FROM m)
 SELECT scene_id, round(w, 7) AS west, round(s, 7) AS south, round(e, 7) AS east, round(n, 7) AS north, round((w + e) / 2, 7) AS center_lon, round((s + n) / 2, 7) AS center_lat FROM b""", "scenes"))


def samples(s, d):
    """Training vectors at feature places: labels are categories numbered by first use, places without valid pixels left out."""
    first = V.features(s, d).groupBy("category").agg(F.min("feature_id").alias("first"))
    numbered = first.join(first.select(F.col("first").alias("f")), F.col("f") <= F.col("first")).groupBy("category").agg(F.count("*").cast("int").alias("label"))  # one row per label
    found = spectra(s, d).filter("error is null").join(V.features(s, d).select("feature_id", "category"), "feature_id")
    return found.join(F.broadcast(numbered), "category").select("feature_id", "label", "b1", "b2", "b3", "b4")


register("training_samples", samples, over(""", f AS (SELECT feature_id, category, floor((lat + 80) / 2)::BIGINT AS row, floor((lon + 180) / 3)::BIGINT AS col FROM features),
 n AS (SELECT category, row_number() OVER (ORDER BY min(feature_id))::INTEGER AS label FROM features GROUP BY category)
 SELECT feature_id, label, b1, b2, b3, b4 FROM f JOIN grid_bands g ON g.row = f.row AND g.col = f.col JOIN n USING (category)""", "features", "grid_bands"))
