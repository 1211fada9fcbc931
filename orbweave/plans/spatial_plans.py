"""Queries over neighbourhoods, grid graphs, transforms, grids, vectors and tiles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import focal as N, gridgraph as G, learn, resample as R, transforms, vector as X, warp as W
from . import views as V
from .pixel_plans import SIX, at, nd, rounded
from .registry import register


height = V.height


def over(body: str, *names: str) -> str:
    return V.with_views(body, *(names or ("dem",)))


H = "(SELECT max(row) + 1 FROM dem)"
GRAD = f"""g AS (SELECT a.row, a.col, a.z,
 CASE WHEN a.col = 0 THEN r.z - a.z WHEN a.col = 127 THEN a.z - l.z ELSE (r.z - l.z) / 2 END AS gx,
 CASE WHEN a.row = 0 THEN d.z - a.z WHEN a.row = {H} - 1 THEN a.z - u.z ELSE (d.z - u.z) / 2 END AS gy
 FROM dem a LEFT JOIN dem l ON l.row = a.row AND l.col = a.col - 1 LEFT JOIN dem r ON r.row = a.row AND r.col = a.col + 1
 LEFT JOIN dem u ON u.row = a.row - 1 AND u.col = a.col LEFT JOIN dem d ON d.row = a.row + 1 AND d.col = a.col)"""


def grad(s, d):
    return N.gradient(V.dem(s, d), "z", height(s, d), 128)


register("dem_elevation", lambda s, d: V.dem(s, d).select("row", "col", F.col("z").cast("float").alias("z")), over("SELECT row, col, z::FLOAT AS z FROM dem"))
register("dem_gradient", lambda s, d: rounded(grad(s, d), "gx", "gy"), over(f", {GRAD} SELECT row, col, z, round(gx, 6) AS gx, round(gy, 6) AS gy FROM g"))
register("dem_slope", lambda s, d: grad(s, d).select("row", "col", F.round(N.slope(None), 5).alias("slope")), over(f", {GRAD} SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope FROM g"))
register("dem_aspect", lambda s, d: grad(s, d).select("row", "col", F.round(N.aspect(None), 5).alias("aspect")), over(f", {GRAD}, a AS (SELECT row, col, gx, gy, degrees(atan2(-gx, gy)) + 360 AS x FROM g) SELECT row, col, round(CASE WHEN gx = 0 AND gy = 0 THEN -1 ELSE x - 360 * floor(x / 360) END, 5) AS aspect FROM a"))
za, al = math.radians(315.0), math.radians(45.0)
register("dem_hillshade", lambda s, d: grad(s, d).select("row", "col", F.round(N.hillshade(), 5).alias("shade")), over(f", {GRAD} SELECT row, col, round(greatest(least((-gx * ({math.cos(al) * math.sin(za)!r})::DOUBLE + gy * ({math.cos(al) * math.cos(za)!r})::DOUBLE + ({math.sin(al)!r})::DOUBLE) / sqrt(gx * gx + gy * gy + 1) * 255, 255.0::DOUBLE), 0.0::DOUBLE), 5) AS shade FROM g"))
BOX = "FROM {t} a JOIN {t} b ON b.row BETWEEN a.row - {h} AND a.row + {h} AND b.col BETWEEN a.col - {h} AND a.col + {h} GROUP BY a.row, a.col"
register("dem_relief", lambda s, d: N.box(V.dem(s, d), {"hi": ("z", "max"), "lo": ("z", "min")}, 1).select("row", "col", (F.col("hi") - F.col("lo")).alias("relief")), over(f"SELECT a.row, a.col, max(b.z) - min(b.z) AS relief {BOX.format(t='dem', h=1)}"))
VARIANCE = "greatest(sum(b.z * b.z) / count(b.z) - (sum(b.z) / count(b.z)) * (sum(b.z) / count(b.z)), 0)"
local = lambda s, d: N.local_statistics(V.dem(s, d), "z").select("row", "col", *(F.round(c, 3).alias(c) for c in ("mean", "variance", "std")), "range")
register("local_statistics", local, over(f"SELECT a.row, a.col, round(avg(b.z), 3) AS mean, round({VARIANCE}, 3) AS variance, round(sqrt({VARIANCE}), 3) AS std, max(b.z) - min(b.z) AS range {BOX.format(t='dem', h=1)}"))
LAPLACE = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
register("convolve2d", lambda s, d: N.convolve(V.dem(s, d), "z", LAPLACE), over(f"SELECT a.row, a.col, sum(CASE WHEN a.row = b.row AND a.col = b.col THEN -4 * b.z WHEN a.row = b.row OR a.col = b.col THEN b.z ELSE 0 END) AS value {BOX.format(t='dem', h=1)}"))
BELL = ", ".join(f"({i - 2}, {j - 2}, {k!r}::DOUBLE)" for i, line in enumerate(N.gaussian_kernel(2.0, 2)) for j, k in enumerate(line))
register("gaussian_filter", lambda s, d: rounded(N.convolve(V.dem(s, d), "z", N.gaussian_kernel(2.0, 2)), "value"), over(f", k AS (SELECT * FROM (VALUES {BELL}) t(i, j, k)) SELECT a.row, a.col, round(sum(k * b.z), 6) AS value FROM dem a CROSS JOIN k JOIN dem b ON b.row = a.row + i AND b.col = a.col + j GROUP BY a.row, a.col"))
QUANT = "q AS (SELECT row, col, least(floor((z - lo) / (hi - lo) * 8), 7)::INTEGER AS level FROM dem, (SELECT min(z) lo, max(z) hi FROM dem))"
levels = lambda s, d: N.quantize(V.dem(s, d), "z", 8)
register("quantize", levels, over(f", {QUANT} SELECT row, col, level FROM q"))
register("glcm", lambda s, d: rounded(N.glcm(levels(s, d)), "contrast", "dissimilarity", "homogeneity"), over(f", {QUANT}, p AS (SELECT a.row, a.col, abs(a.level - b.level) AS d FROM q a JOIN q b ON b.row = a.row AND b.col = a.col + 1) SELECT w.row, w.col, round(avg(d * d), 6) AS contrast, round(avg(d), 6) AS dissimilarity, round(avg(1.0::DOUBLE / (1 + d * d)), 6) AS homogeneity FROM q w JOIN p ON p.row BETWEEN w.row - 1 AND w.row + 1 AND p.col BETWEEN w.col - 1 AND w.col GROUP BY w.row, w.col"))
register("local_entropy", lambda s, d: rounded(N.local_entropy(levels(s, d)), "entropy"), over(f", {QUANT}, c AS (SELECT a.row, a.col, b.level, count(*) AS n FROM q a JOIN q b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL) SELECT row, col, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM c GROUP BY row, col"))
high = lambda s, d: V.dem(s, d).select("row", "col", (F.col("z") > 300).cast("int").alias("mask"))
MASK = "m AS (SELECT row, col, (z > 300)::INTEGER AS mask FROM dem)"
register("erode", lambda s, d: N.erode(high(s, d), "mask", height(s, d), 128), over(f", {MASK} SELECT a.row, a.col, CASE WHEN a.row > 0 AND a.col > 0 AND a.col < 127 AND a.row < {H} - 1 THEN min(b.mask) ELSE 0 END AS mask {BOX.format(t='m', h=1)}"))
register("dilate", lambda s, d: N.dilate(high(s, d), "mask"), over(f", {MASK} SELECT a.row, a.col, max(b.mask) AS mask {BOX.format(t='m', h=1)}"))
register("edge_magnitude", lambda s, d: grad(s, d).select("row", "col", F.round(F.hypot("gx", "gy"), 6).alias("edge")), over(f", {GRAD} SELECT row, col, round(sqrt(gx * gx + gy * gy), 6) AS edge FROM g"))

FLOW = """o AS (SELECT * FROM (VALUES (0, 0, 1, 1), (1, 1, 1, 2), (2, 1, 0, 4), (3, 1, -1, 8), (4, 0, -1, 16), (5, -1, -1, 32), (6, -1, 0, 64), (7, -1, 1, 128)) t(k, dr, dc, code)),
 s AS (SELECT a.row, a.col, k, code, dr, dc, ((a.z - b.z) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1 END)::FLOAT AS fall FROM dem a CROSS JOIN o JOIN dem b ON b.row = a.row + dr AND b.col = a.col + dc),
 f AS (SELECT row, col, code, row + dr AS to_row, col + dc AS to_col FROM s WHERE fall > 0 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY fall DESC, k) = 1),
 flow AS (SELECT dem.row, dem.col, coalesce(code, 0) AS code, coalesce(to_row, dem.row) AS to_row, coalesce(to_col, dem.col) AS to_col FROM dem LEFT JOIN f USING (row, col))"""
register("d8_flow_direction", lambda s, d: G.d8_flow(V.dem(s, d)), over(f", {FLOW} SELECT row, col, code, to_row, to_col FROM flow"))
register("flow_accumulation", lambda s, d: G.flow_accumulation(G.stored(G.d8_flow(V.dem(s, d)), "d8")), over(f", {FLOW}, walk AS (SELECT row AS r, col AS c, row, col FROM dem UNION ALL SELECT r, c, to_row, to_col FROM walk JOIN flow USING (row, col) WHERE to_row <> row OR to_col <> col) SELECT row, col, count(*) AS accumulation FROM walk GROUP BY row, col"))
register("watershed", lambda s, d: G.watershed(G.stored(G.d8_flow(V.dem(s, d)), "d8")), over(f", {FLOW}, walk AS (SELECT row AS r, col AS c, row, col FROM dem UNION ALL SELECT r, c, to_row, to_col FROM walk JOIN flow USING (row, col) WHERE to_row <> row OR to_col <> col), e AS (SELECT r, c, w.row, w.col FROM walk w JOIN flow f USING (row, col) WHERE f.code = 0), k AS (SELECT row, col, (row_number() OVER (ORDER BY min(r * 128 + c)))::INTEGER AS basin FROM e GROUP BY row, col) SELECT r AS row, c AS col, basin FROM e JOIN k USING (row, col)"))
wet = lambda s, d: V.dem(s, d).filter("z > 550").select("row", "col")
#: Labels of the cells of `c` (id, row, col, v) by the smallest id that a chain of equal neighbours leads to.
LABELS = """c AS (SELECT row, col, v, row * 4294967296 + col AS id FROM x),
 adj AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON b.row = a.row AND b.col = a.col + 1 AND a.v = b.v UNION ALL SELECT a.id, b.id FROM c a JOIN c b ON b.row = a.row + 1 AND b.col = a.col AND a.v = b.v),
 sides AS (SELECT a, b FROM adj UNION ALL SELECT b, a FROM adj),
 r(id, label) USING KEY (id) AS (SELECT id, id FROM c UNION SELECT sides.b, min(r.label) FROM r JOIN sides ON sides.a = r.id JOIN recurring.r AS k ON k.id = sides.b WHERE r.label < k.label GROUP BY sides.b),
 l AS (SELECT row, col, v, id, label FROM c JOIN r USING (id))"""
WET = "x AS (SELECT row, col, 1 AS v FROM dem WHERE z > 550)"
register("connected_components", lambda s, d: G.components(wet(s, d)), over(f", {WET}, {LABELS} SELECT row, col, label // 4294967296 AS label_row, label % 4294967296 AS label_col FROM l"))
register("component_sizes", lambda s, d: G.components(wet(s, d)).groupBy("label_row", "label_col").count().groupBy("count").agg(F.count("*").alias("components")), over(f", {WET}, {LABELS}, n AS (SELECT count(*) AS count FROM l GROUP BY label) SELECT count, count(*) AS components FROM n GROUP BY count"))
HIGH = "x AS (SELECT row, col, (z > 300)::INTEGER AS v FROM dem)"
register("remove_small_components", lambda s, d: G.remove_small(high(s, d), 5), over(f", {HIGH}, {LABELS} SELECT row, col, CASE WHEN count(*) OVER (PARTITION BY label) < 5 THEN 0 ELSE v END AS mask FROM l"))
register("fill_holes", lambda s, d: G.fill_holes(high(s, d), height(s, d), 128), over(f", {HIGH}, {LABELS} SELECT row, col, CASE WHEN v = 0 AND NOT bool_or(row = 0 OR col = 0 OR col = 127 OR row = {H} - 1) OVER (PARTITION BY label) THEN 1 ELSE v END AS mask FROM l"))


def clean_mask(s, d):
    h = height(s, d)
    opened = N.dilate(N.erode(high(s, d), "mask", h, 128), "mask")
    closed = G.stored(N.erode(N.dilate(opened, "mask"), "mask", h, 128), "closed")
    return G.remove_small(G.fill_holes(closed, h, 128), 9)


register("clean_mask", clean_mask)
EDGE = "SELECT a.row, a.col, a.v, o.side FROM x a CROSS JOIN (VALUES ('up', -1, 0), ('down', 1, 0), ('left', 0, -1), ('right', 0, 1)) o(side, dr, dc) LEFT JOIN x b ON b.row = a.row + dr AND b.col = a.col + dc WHERE b.v IS NULL OR b.v <> a.v"
register("raster_to_vector_edges", lambda s, d: G.boundary_edges(V.dem(s, d).select("row", "col", F.floor(F.col("z") / 250).alias("v")), "v"), over(f", x AS (SELECT row, col, floor(z / 250)::BIGINT AS v FROM dem) {EDGE}"))
register("valid_bounds", lambda s, d: V.grid_bands(s, d).agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"), F.count("*").alias("valid")), over("SELECT min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1, count(*) AS valid FROM grid_bands", "grid_bands"))

AT = "max(CASE WHEN row % 2 = {} AND col % 2 = {} THEN z END)"
register("haar_wavelet", lambda s, d: rounded(transforms.haar(V.dem(s, d), "z"), "ll", "lh", "hl", "hh"), over(f", q AS (SELECT row // 2 AS row, col // 2 AS col, {AT.format(0, 0)} a, {AT.format(0, 1)} b0, {AT.format(1, 0)} c0, {AT.format(1, 1)} d0 FROM dem GROUP BY 1, 2), x AS (SELECT row, col, a, coalesce(b0, a) b, coalesce(c0, a) c, coalesce(d0, CASE WHEN b0 IS NULL THEN coalesce(c0, a) ELSE coalesce(b0, a) END) d FROM q) SELECT row, col, round((a+b+c+d)/4, 6) AS ll, round((a-b+c-d)/4, 6) AS lh, round((a+b-c-d)/4, 6) AS hl, round((a-b-c+d)/4, 6) AS hh FROM x"))
register("pca", lambda s, d: rounded(transforms.pca(V.grid_bands(s, d), SIX, 3)[0], "pc1", "pc2", "pc3"))
#: Both passes of the transform as sums; angles go through whole numbers, so large products lose nothing.
FOURIER = f"""h AS (SELECT {H} AS h, (SELECT avg(z) FROM dem) AS mean), g AS (SELECT r.i AS row, c.i AS col, coalesce(z, mean) AS z FROM h, range(h.h) r(i) CROSS JOIN range(128) c(i) LEFT JOIN dem ON dem.row = r.i AND dem.col = c.i),
 a AS (SELECT k.i AS k, c.i AS c, cos(2 * pi() * (k.i * c.i % 128) / 128) AS x, -sin(2 * pi() * (k.i * c.i % 128) / 128) AS y FROM range(128) k(i), range(128) c(i)),
 p AS (SELECT row, k AS col, sum(z * x) AS re, sum(z * y) AS im FROM g JOIN a ON a.c = g.col GROUP BY row, k),
 b AS (SELECT k.i AS k, r.i AS r, cos(2 * pi() * (k.i * r.i % h) / h) AS x, -sin(2 * pi() * (k.i * r.i % h) / h) AS y FROM h, range(h.h) k(i), range(h.h) r(i)),
 q AS (SELECT b.k AS row, col, sum(re * x - im * y) AS re, sum(re * y + im * x) AS im FROM p JOIN b ON b.r = p.row GROUP BY b.k, col)"""
register("fourier_2d", lambda s, d: rounded(transforms.fourier(V.dem(s, d), "z", height(s, d), 128), "value"), over(f", {FOURIER} SELECT (row + h // 2) % h AS row, (col + 64) % 128 AS col, round(ln(1 + sqrt(re * re + im * im)), 6) AS value FROM q, h"))
register("map_chunks", lambda s, d: transforms.map_chunks(V.dem(s, d).select("row", "col", "z"), lambda p: p.assign(z=p["z"] - p["z"].mean()).groupby(["crow", "ccol"], as_index=False).agg(n=("z", "size"), spread=("z", "std")).round(6), "crow long, ccol long, n long, spread double", 64), over("SELECT row // 64 AS crow, col // 64 AS ccol, count(*) AS n, round(stddev_samp(z), 6) AS spread FROM dem GROUP BY 1, 2"))
register("predict_chunks", lambda s, d: rounded(transforms.predict_chunks(V.grid_bands(s, d), lambda m: m @ [0.5, 0.25, 0.25], ["b1", "b2", "b3"]), "score"), over("SELECT row, col, round(0.5::DOUBLE * b1 + 0.25::DOUBLE * b2 + 0.25::DOUBLE * b3, 6) AS score FROM grid_bands", "grid_bands"))

DUCK = {"average": "avg(z)", "max": "max(z)", "min": "min(z)", "med": "quantile_cont(z, 0.5)", "q1": "quantile_cont(z, 0.25)", "q3": "quantile_cont(z, 0.75)"}
for method, sql in DUCK.items():
    register(f"resample_{method}", lambda s, d, m=method: rounded(R.downsample(V.dem(s, d), "z", 4, m), "value"), over(f"SELECT row // 4 AS row, col // 4 AS col, round({sql}, 6) AS value FROM dem GROUP BY 1, 2"))
register("build_overviews", lambda s, d: R.overview(V.dem(s, d), "z", 2).withColumn("level", F.lit(2)).union(R.overview(V.dem(s, d), "z", 4).withColumn("level", F.lit(4))), over("SELECT row // 2 AS row, col // 2 AS col, z AS value, 2 AS level FROM dem WHERE row % 2 = 1 AND col % 2 = 1 UNION ALL SELECT row // 4, col // 4, z, 4 FROM dem WHERE row % 4 = 2 AND col % 4 = 2"))
half = lambda s, d: V.dem(s, d).select("row", "col")
register("align_to_grid_nearest", lambda s, d: R.nearest(half(s, d), V.dem(s, d), "z", (F.col("row") + 0.5) * 0.75, (F.col("col") + 0.5) * 0.75), over("SELECT t.row, t.col, s.z AS value FROM dem t LEFT JOIN dem s ON s.row = floor((t.row + 0.5::DOUBLE) * 0.75::DOUBLE) AND s.col = floor((t.col + 0.5::DOUBLE) * 0.75::DOUBLE)"))
register("align_to_grid_bilinear", lambda s, d: rounded(R.bilinear(half(s, d), V.dem(s, d), "z", (F.col("row") + 0.5) * 0.75, (F.col("col") + 0.5) * 0.75), "value"), over("""SELECT t.row, t.col, round(sum(w * z) / sum(w), 6) AS value FROM (SELECT row, col, floor(fr) + i AS sr, floor(fc) + j AS sc, (1 - abs(fr - floor(fr) - i)) * (1 - abs(fc - floor(fc) - j)) AS w
 FROM (SELECT row, col, (row + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE AS fr, (col + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE AS fc FROM dem), range(2) a(i), range(2) b(j)) t JOIN dem s ON s.row = sr AND s.col = sc WHERE w > 0 GROUP BY t.row, t.col"""))
register("geometric_correction", lambda s, d: rounded(R.affine(V.dem(s, d), 2.0, -1.0, 1.5, 30.0, height(s, d), 128), "x", "y"), over(f"SELECT row, col, round(((col + 0.5::DOUBLE - 64) * {math.cos(math.pi / 6)!r}::DOUBLE - (row + 0.5::DOUBLE - {H} / 2.0::DOUBLE) * {math.sin(math.pi / 6)!r}::DOUBLE) * 1.5::DOUBLE + 66, 6) AS x, round(((col + 0.5::DOUBLE - 64) * {math.sin(math.pi / 6)!r}::DOUBLE + (row + 0.5::DOUBLE - {H} / 2.0::DOUBLE) * {math.cos(math.pi / 6)!r}::DOUBLE) * 1.5::DOUBLE + {H} / 2.0::DOUBLE - 1, 6) AS y FROM dem"))


def shown(s, d, *columns):
    return V.features(s, d).select("feature_id", *columns)


register("utm_zone", lambda s, d: shown(s, d, R.utm_zone(at.lon, at.lat).alias("epsg")), over("SELECT feature_id, CASE WHEN lat < -80 OR lat > 84 THEN 3857 ELSE CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(floor((lon + 180) / 6) + 1, 60) END::INTEGER AS epsg FROM features", "features"))
register("reproject_points", lambda s, d: shown(s, d, *(F.round(c, 3).alias(n) for c, n in zip(R.to_mercator(at.lon, at.lat), ("x", "y"), strict=True))), over("SELECT feature_id, round(radians(lon) * 6378137.0::DOUBLE, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE, 3) AS y FROM features", "features"))
SERIES = lambda r, i: " + ".join(f"({float(k)!r})::DOUBLE * {r}({2 * (j + 1)} * xi) * {i}({2 * (j + 1)} * eta)" for j, k in enumerate(W.ALPHA))
FIRST, RADIUS = 2 * math.sqrt(W.N3) / (1 + W.N3), W.SCALE * W.RADIUS
UTM = f""", a AS (SELECT feature_id, lat, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) AS q, sinh(atanh(sin(radians(lat))) - {FIRST!r}::DOUBLE * atanh({FIRST!r}::DOUBLE * sin(radians(lat)))) AS t FROM features),
 b AS (SELECT *, atan2(t, cos(q)) AS xi, atanh(sin(q) / sqrt(1 + t * t)) AS eta FROM a)
 SELECT feature_id, round(500000 + {RADIUS!r}::DOUBLE * (eta + {SERIES('cos', 'sinh')}), 3) AS easting, round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + {RADIUS!r}::DOUBLE * (xi + {SERIES('sin', 'cosh')}), 3) AS northing FROM b"""
register("reproject_utm", lambda s, d: shown(s, d, *(F.round(c, 3).alias(n) for c, n in zip(R.to_utm(at.lon, at.lat), ("easting", "northing"), strict=True))), over(UTM, "features"))
register("dem_cell_size", lambda s, d: shown(s, d, *(F.round(c, 4).alias(n) for c, n in zip(R.metres_per_degree(at.lat), ("per_lat", "per_lon"), strict=True))), over("SELECT feature_id, round(111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * radians(lat)) + 1.175::DOUBLE * cos(4 * radians(lat)) - 0.0023::DOUBLE * cos(6 * radians(lat)), 4) AS per_lat, round(111412.84::DOUBLE * cos(radians(lat)) - 93.5::DOUBLE * cos(3 * radians(lat)) + 0.118::DOUBLE * cos(5 * radians(lat)), 4) AS per_lon FROM features", "features"))

register("bbox_filter", lambda s, d: X.bbox_filter(V.features(s, d), -20, -10, 60, 40).select("feature_id"), over("SELECT feature_id FROM features WHERE lon BETWEEN -20 AND 60 AND lat BETWEEN -10 AND 40", "features"))


def antimeridian(s, d):
    found = [X.bbox_filter(V.features(s, d), *b).select("feature_id") for b in X.split_view(170.0, -30.0, 200.0, 30.0)]
    return found[0].union(found[1]).distinct()


register("bbox_antimeridian", antimeridian, over("SELECT feature_id FROM features WHERE (lon BETWEEN 170 AND 180 OR lon BETWEEN -180 AND -160) AND lat BETWEEN -30 AND 30", "features"))
register("normalize_longitude", lambda s, d: shown(s, d, F.round(X.normalize_longitude(at.lon * 3), 6).alias("lon")), over("SELECT feature_id, round(lon * 3 + 180 - 360 * floor((lon * 3 + 180) / 360) - 180, 6) AS lon FROM features", "features"))
register("features_by_layer", lambda s, d: V.features(s, d).filter("layer_id = 3").select("feature_id", "category"), over("SELECT feature_id, category FROM features WHERE layer_id = 3", "features"))
register("feature_to_geojson", lambda s, d: V.features(s, d).select("feature_id", F.get_json_object(X.feature_geojson(), "$.properties.category").alias("category"), F.get_json_object(X.feature_geojson(), "$.geometry.type").alias("kind")), over("SELECT feature_id, category, 'Point' AS kind FROM features", "features"))
register("category_counts", lambda s, d: V.features(s, d).groupBy("category").count(), over("SELECT category, count(*) AS count FROM features GROUP BY 1", "features"))
register("layer_extent", lambda s, d: V.features(s, d).groupBy("layer_id").agg(F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax")), over("SELECT layer_id, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM features GROUP BY 1", "features"))
register("layer_summary", lambda s, d: V.features(s, d).groupBy("layer_id").agg(F.count("*").alias("features"), F.count_distinct("category").alias("categories"), F.min("balance").alias("low"), F.max("balance").alias("high"), F.round(F.avg("balance"), 6).alias("mean")), over("SELECT layer_id, count(*) AS features, count(DISTINCT category) AS categories, min(balance) AS low, max(balance) AS high, round(avg(balance), 6) AS mean FROM features GROUP BY 1", "features"))
register("vector_attribute_query", lambda s, d: V.features(s, d).filter((F.col("balance") > 5000) & F.col("category").ilike("%build%")).orderBy("feature_id").limit(50).select("feature_id", "balance"), over("SELECT feature_id, balance FROM features WHERE balance > 5000 AND category ILIKE '%build%' ORDER BY feature_id LIMIT 50", "features"))
def with_properties(s, d):
    """Customers with properties as JSON text: a number that is a word for some, and one that only some have."""
    balance = F.when(F.col("feature_id") % 7 == 3, F.lit('"none"')).otherwise(F.col("balance").cast("string"))
    extra = F.when(F.col("feature_id") % 2 == 0, F.concat(F.lit(', "ratio": '), F.col("feature_id").cast("string"), F.lit(".5"))).otherwise("")
    return V.features(s, d).withColumn("properties", F.concat(F.lit('{"name": "'), "name", F.lit('", "balance": '), balance, extra, F.lit("}")))


PROPERTIES = """p AS (SELECT feature_id, layer_id, unnest(['name', 'balance', 'ratio']) AS property, name, balance FROM features),
 v AS (SELECT layer_id, feature_id, property, CASE property WHEN 'name' THEN 'string' WHEN 'balance' THEN CASE WHEN feature_id % 7 = 3 THEN 'string' ELSE 'bigint' END ELSE 'double' END AS type,
  CASE property WHEN 'balance' THEN CASE WHEN feature_id % 7 <> 3 THEN balance::DOUBLE END WHEN 'ratio' THEN feature_id + 0.5::DOUBLE END AS number FROM p WHERE property <> 'ratio' OR feature_id % 2 = 0)"""
register("layer_properties", lambda s, d: rounded(X.property_summary(with_properties(s, d)), "mean"), over(f", {PROPERTIES} SELECT layer_id, property, arg_min(type, feature_id) AS type, count(number) AS numbers, min(number) AS low, max(number) AS high, round(avg(number), 6) AS mean FROM v GROUP BY 1, 2", "features"))
register("layer_samples", lambda s, d: X.layer_samples(V.features(s, d)).select("layer_id", "sample", "feature_id", "category"), over("SELECT layer_id, (row_number() OVER (PARTITION BY layer_id ORDER BY feature_id))::INTEGER AS sample, feature_id, category FROM features QUALIFY row_number() OVER (PARTITION BY layer_id ORDER BY feature_id) <= 3", "features"))
boxes_ring = lambda s, d: V.boxes(s, d).select("zone_id", X.box_ring(F.col("c0"), F.col("r0"), F.col("c0") + F.col("w"), F.col("r0") + F.col("h")).alias("ring"))
centers = lambda s, d: V.dem(s, d).select("row", "col", "z", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
IN = "dem JOIN boxes ON row >= r0 AND row < r0 + h AND col >= c0 AND col < c0 + w"
register("point_in_polygon", lambda s, d: X.points_in_zones(centers(s, d), boxes_ring(s, d)).select("row", "col", "zone_id"), over(f"SELECT row, col, zone_id FROM {IN}", "dem", "boxes"))
register("zonal_statistics", lambda s, d: rounded(X.points_in_zones(centers(s, d), boxes_ring(s, d)).groupBy("zone_id").agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.min("z").alias("low"), F.max("z").alias("high")), "mean"), over(f"SELECT zone_id, count(z) AS n, round(avg(z), 6) AS mean, min(z) AS low, max(z) AS high FROM {IN} GROUP BY 1", "dem", "boxes"))
register("clip_raster_by_vector", lambda s, d: centers(s, d).join(X.points_in_zones(centers(s, d), boxes_ring(s, d)).select("row", "col").distinct(), ["row", "col"], "left_semi").select("row", "col", "z"), over(f"SELECT DISTINCT row, col, z FROM {IN}", "dem", "boxes"))
register("rasterize_features", lambda s, d: X.rasterize(V.boxes(s, d), "h"), over("SELECT row, col, arg_max(h, zone_id) AS value FROM (SELECT zone_id, h, r0 + i AS row, c0 + j AS col FROM boxes, range(10) a(i), range(9) b(j) WHERE i < h AND j < w) GROUP BY row, col", "boxes"))
L_SHAPE = lambda s, d: V.boxes(s, d).select("zone_id", X.l_ring(F.col("c0"), F.col("r0"), F.col("w") * 2, F.col("h") * 2).alias("ring"))
register("clip_vector_intersects", lambda s, d: X.points_in_zones(centers(s, d).select("row", "col", "x", "y"), L_SHAPE(s, d)).select("row", "col", "zone_id"), over("SELECT row, col, zone_id FROM dem JOIN boxes ON col >= c0 AND col + 0.5::DOUBLE < c0 + 2 * w AND row >= r0 AND row + 0.5::DOUBLE < r0 + 2 * h AND NOT (col + 0.5::DOUBLE > c0 + w AND row + 0.5::DOUBLE < r0 + h)", "dem", "boxes"))
register("geom_bounds", lambda s, d: L_SHAPE(s, d).select("zone_id", X.ring_bounds(F.col("ring")).alias("b")).select("zone_id", "b.*"), over("SELECT zone_id, c0::DOUBLE AS xmin, r0::DOUBLE AS ymin, (c0 + 2 * w)::DOUBLE AS xmax, (r0 + 2 * h)::DOUBLE AS ymax FROM boxes", "boxes"))
E2 = 1 - (6356.752314245 / 6378.137) ** 2
QS = "((1 - {e2!r}::DOUBLE) * ({s} / (1 - {e2!r}::DOUBLE * {s} * {s}) - ln((1 - {e!r}::DOUBLE * {s}) / (1 + {e!r}::DOUBLE * {s})) / (2 * {e!r}::DOUBLE)))"
BETA = lambda lat: QS.format(e2=E2, e=math.sqrt(E2), s=f"sin(radians({lat}))") + " / q1"
KM2 = f""", q AS (SELECT {QS.format(e2=E2, e=math.sqrt(E2), s="1.0::DOUBLE")} AS q1) SELECT zone_id, round(abs(radians(w) * (2 + 2 * {BETA("r0 - 50")}) - radians(w) * (2 + 2 * {BETA("r0 - 50 + h")})) * (6378.137::DOUBLE * 6378.137::DOUBLE * q1 / 2) / 2, 3) AS km2 FROM boxes, q"""
register("geom_area_km2", lambda s, d: V.boxes(s, d).select("zone_id", F.round(X.ring_area_km2(X.box_ring(F.col("c0"), F.col("r0") - 50, F.col("c0") + F.col("w"), F.col("r0") - 50 + F.col("h"))), 3).alias("km2")), over(KM2, "boxes"))
TILE = "(lon + 180) / 360 * 64 AS fx, (1 - ln(tan(p) + 1 / cos(p)) / pi()) / 2 * 64 AS fy FROM (SELECT *, radians(greatest(least(lat, 85.05112878::DOUBLE), -85.05112878::DOUBLE)) AS p FROM features)"
register("xyz_tile_of_point", lambda s, d: shown(s, d, *(c.alias(n) for c, n in zip(X.tile_of(at.lon, at.lat, 6), ("x", "y"), strict=True))), over(f", t AS (SELECT feature_id, {TILE}) SELECT feature_id, greatest(least(floor(fx)::BIGINT, 63), 0) AS x, greatest(least(floor(fy)::BIGINT, 63), 0) AS y FROM t", "features"))
register("vtile_assign", lambda s, d: V.features(s, d).groupBy(*(c.alias(n) for c, n in zip(X.tile_of(at.lon, at.lat, 6), ("x", "y"), strict=True))).agg(F.count("*").alias("features")), over(f", t AS (SELECT feature_id, {TILE}) SELECT greatest(least(floor(fx)::BIGINT, 63), 0) AS x, greatest(least(floor(fy)::BIGINT, 63), 0) AS y, count(*) AS features FROM t GROUP BY 1, 2", "features"))
register("vtile_quantize", lambda s, d: shown(s, d, *(c.alias(n) for c, n in zip(X.tile_place(at.lon, at.lat, 6), ("x", "y", "qx", "qy"), strict=True))), over(f", t AS (SELECT feature_id, {TILE}), k AS (SELECT feature_id, fx, fy, greatest(least(floor(fx)::BIGINT, 63), 0) AS x, greatest(least(floor(fy)::BIGINT, 63), 0) AS y FROM t) SELECT feature_id, x, y, floor((fx - x) * 4096)::BIGINT AS qx, floor((fy - y) * 4096)::BIGINT AS qy FROM k", "features"))
register("classify_kmeans", lambda s, d: learn.kmeans_labels(V.grid_bands(s, d), ["b1", "b2", "b3", "b4"], 4))


def spectra(s, d):
    return V.read(s, d, "embeddings").select("vec_id", "label", *(F.floor(F.col("embedding")[i].cast("double") * 4096).alias(f"e{i}") for i in range(64)))


E64 = [f"e{i}" for i in range(64)]
register("classify_centroid", lambda s, d: learn.nearest_centroid(spectra(s, d), spectra(s, d), "vec_id", E64, "label"), "WITH x AS (SELECT vec_id, label, " + ", ".join(f"floor(embedding[{i + 1}]::DOUBLE * 4096) AS e{i}" for i in range(64)) + "), c AS (SELECT label AS center, " .replace("), c", " FROM embeddings), c") + ", ".join(f"avg(e{i}) AS m{i}" for i in range(64)) + " FROM x GROUP BY label), k AS (SELECT vec_id, center, round(" + " + ".join(f"(e{i} - m{i}) * (e{i} - m{i})" for i in range(64)) + ", 9) AS d FROM x, c) SELECT vec_id, arg_min(center, (d, center)) AS predicted FROM k GROUP BY vec_id")
bands = lambda s, d: V.read(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 4096).cast("double")).alias("bands"))
register("classify_random_forest", lambda s, d: learn.random_forest(bands(s, d), bands(s, d), "bands", "label").select("vec_id", "prediction"))
register("scores_to_labels", lambda s, d: learn.scores_to_labels(V.grid_bands(s, d).select("row", "col", F.posexplode(F.array("b1", "b2", "b3")).alias("channel", "score"))), over("SELECT row, col, CASE WHEN b1 >= b2 AND b1 >= b3 THEN 1 WHEN b2 >= b3 THEN 2 ELSE 3 END AS label FROM grid_bands", "grid_bands"))
