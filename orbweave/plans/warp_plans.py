"""Queries over warping: reprojection there and back, kernels, metre units, control points, map tiles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import tiles as T, warp as W
from . import views as V
from .registry import register
from .spatial_plans import H, height, over

#: Degrees of a pixel of the order grid, which is laid around 9 degrees east.
STEP, WEST, NORTH = 0.01, 8.4, 52.0


#: Added before rounding: exact halves would go either way by the last bit of a sum.
NUDGE = 3e-8


def steady(df, digits, *columns):
    return df.withColumns({c: F.round(F.col(c) + NUDGE, digits) for c in columns})


def masked(s, d):
    """The order grid with every seventh pixel invalid."""
    return V.dem(s, d).filter("(row * 31 + col * 17) % 7 <> 0")


def grid(s, d):
    return W.Grid("EPSG:4326", WEST, NORTH, STEP, STEP, V.GRID, height(s, d))


MASKED = f"p AS (SELECT row, col, z FROM dem WHERE (row * 31 + col * 17) % 7 <> 0), h AS (SELECT {H} AS h)"
KERNEL = {
    "bilinear": (1, "greatest(1 - {x}, 0)"), "cubic": (2, "CASE WHEN {x} < 1 THEN 1.5::DOUBLE * {x} * {x} * {x} - 2.5::DOUBLE * {x} * {x} + 1 WHEN {x} < 2 THEN -0.5::DOUBLE * {x} * {x} * {x} + 2.5::DOUBLE * {x} * {x} - 4 * {x} + 2 ELSE 0 END"),
    "cubic_spline": (2, "CASE WHEN {x} < 1 THEN 2.0::DOUBLE / 3 - {x} * {x} + {x} * {x} * {x} / 2 WHEN {x} < 2 THEN (2 - {x}) * (2 - {x}) * (2 - {x}) / 6 ELSE 0 END"),
    "lanczos": (3, "CASE WHEN {x} < 1e-12 THEN 1 WHEN {x} < 3 THEN 3 * sin(pi() * {x}) * sin(pi() * {x} / 3) / (pi() * pi() * {x} * {x}) ELSE 0 END"),
}
for method, (radius, weight) in KERNEL.items():
    for name, ratio in (("finer", 0.75), ("coarser", 2.5)):
        reach = math.ceil(radius * max(1, ratio))
        w = " * ".join(f"({weight.format(x=f'(abs(k{a} + 0.5::DOUBLE - f{a}) / {max(1, ratio)}::DOUBLE)')})" for a in ("r", "c"))
        sql = f""", {MASKED}, t AS (SELECT i AS row, j AS col, (i + 0.5::DOUBLE) * {ratio}::DOUBLE AS fr, (j + 0.5::DOUBLE) * {ratio}::DOUBLE AS fc FROM h, range(ceil(h / {ratio}::DOUBLE - 1e-9)::BIGINT) a(i), range(ceil(128 / {ratio}::DOUBLE - 1e-9)::BIGINT) b(j)),
 n AS (SELECT t.*, z AS near FROM t JOIN p ON p.row = floor(fr) AND p.col = floor(fc)),
 k AS (SELECT n.*, floor(fr - 0.5::DOUBLE)::BIGINT + i AS kr, floor(fc - 0.5::DOUBLE)::BIGINT + j AS kc FROM n, range({1 - reach}, {reach + 1}) a(i), range({1 - reach}, {reach + 1}) b(j)),
 w AS (SELECT k.row, k.col, near, z, {w} AS w FROM k JOIN p ON p.row = kr AND p.col = kc)
 SELECT row, col, round(CASE WHEN sum(w) > 1e-6 THEN sum(w * z) / sum(w) ELSE any_value(near) END + {NUDGE}, 4) AS value FROM w GROUP BY row, col"""
        register(f"resample_{method}_{name}", lambda s, d, m=method, q=ratio: steady(W.resample(masked(s, d), "z", grid(s, d), (STEP * q, STEP * q), "source", m)[0], 4, "value"), over(sql))

#: The projection as SQL, from longitude and latitude to metres of zone 32 and back.
SUM = lambda series, r, i, xi, eta: " + ".join(f"({float(k)!r})::DOUBLE * {r}({2 * (j + 1)} * {xi}) * {i}({2 * (j + 1)} * {eta})" for j, k in enumerate(series))
E1 = 2 * math.sqrt(W.N3) / (1 + W.N3)
KA = f"({W.SCALE * W.RADIUS!r})::DOUBLE"
FORWARD = f"""q1 AS (SELECT *, sinh(atanh(sin(radians(lat))) - {E1!r}::DOUBLE * atanh({E1!r}::DOUBLE * sin(radians(lat)))) AS ct, radians(lon - 9) AS cq FROM q0),
 q2 AS (SELECT *, atan2(ct, cos(cq)) AS xi, atanh(sin(cq) / sqrt(1 + ct * ct)) AS eta FROM q1),
 q3 AS (SELECT *, 500000 + {KA} * (eta + {SUM(W.ALPHA, 'cos', 'sinh', 'xi', 'eta')}) AS e, {KA} * (xi + {SUM(W.ALPHA, 'sin', 'cosh', 'xi', 'eta')}) AS n FROM q2)"""
INVERSE = f"""b0 AS (SELECT *, n / {KA} AS xi, (e - 500000) / {KA} AS eta FROM b),
 b1 AS (SELECT *, xi - ({SUM(W.BETA, 'sin', 'cosh', 'xi', 'eta')}) AS u, eta - ({SUM(W.BETA, 'cos', 'sinh', 'xi', 'eta')}) AS v FROM b0),
 b2 AS (SELECT *, asin(sin(u) / cosh(v)) AS chi FROM b1),
 b3 AS (SELECT *, 9 + degrees(atan2(sinh(v), cos(u))) AS lon, degrees(chi + {' + '.join(f'({float(k)!r})::DOUBLE * sin({2 * (j + 1)} * chi)' for j, k in enumerate(W.DELTA))}) AS lat FROM b2)"""
UTM = "EPSG:32632"


def to_zone(s, d, method):
    source = grid(s, d)
    return W.reproject(masked(s, d), "z", source, W.target_grid(s, source, UTM, (900.0, 900.0)), method)


#: Border points, bounds and the target grid of 900 m, then the fractional source place of every target pixel.
TARGET = f"""{MASKED}, q0 AS (SELECT DISTINCT {WEST}::DOUBLE + x * 128 * {STEP}::DOUBLE AS lon, {NORTH}::DOUBLE - y * h * {STEP}::DOUBLE AS lat FROM h, (SELECT i / 21.0::DOUBLE AS x, j / 21.0::DOUBLE AS y FROM range(22) a(i), range(22) b(j) WHERE i IN (0, 21) OR j IN (0, 21))),
 {FORWARD}, g AS (SELECT min(e) AS x0, max(n) AS y0, greatest(1, ceil((max(e) - min(e)) / 900 - 1e-9))::BIGINT AS w, greatest(1, ceil((max(n) - min(n)) / 900 - 1e-9))::BIGINT AS t FROM q3),
 b AS (SELECT i AS row, j AS col, x0 + (j + 0.5::DOUBLE) * 900 AS e, y0 - (i + 0.5::DOUBLE) * 900 AS n FROM g, range(g.t) a(i), range(g.w) c(j)), {INVERSE},
 f AS (SELECT row, col, ({NORTH}::DOUBLE - lat) / {STEP}::DOUBLE AS fr, (lon - {WEST}::DOUBLE) / {STEP}::DOUBLE AS fc FROM b3)"""
register("reproject", lambda s, d: to_zone(s, d, "nearest"), over(f", {TARGET} SELECT f.row, f.col, z AS value FROM f JOIN p ON p.row = floor(fr) AND p.col = floor(fc)"))
register("reproject_bilinear", lambda s, d: steady(to_zone(s, d, "bilinear"), 4, "value"), over(f""", {TARGET}, k AS (SELECT f.*, floor(fr - 0.5::DOUBLE) + i AS kr, floor(fc - 0.5::DOUBLE) + j AS kc FROM f JOIN p ON p.row = floor(fr) AND p.col = floor(fc), range(2) a(i), range(2) c(j)),
 w AS (SELECT k.row, k.col, z, greatest(1 - abs(kr + 0.5::DOUBLE - fr), 0) * greatest(1 - abs(kc + 0.5::DOUBLE - fc), 0) AS w FROM k JOIN p ON p.row = kr AND p.col = kc) SELECT row, col, round(sum(w * z) / sum(w) + {NUDGE}, 4) AS value FROM w GROUP BY row, col"""))
register("resample_metres_average", lambda s, d: steady(W.resample(masked(s, d), "z", grid(s, d), (2500.0, 2500.0), "metres", "average")[0], 6, "value"), over(f""", {MASKED}, q0 AS (SELECT DISTINCT true AS edge, 0::DOUBLE AS z, {WEST}::DOUBLE + x * 128 * {STEP}::DOUBLE AS lon, {NORTH}::DOUBLE - y * h * {STEP}::DOUBLE AS lat FROM h, (SELECT i / 21.0::DOUBLE AS x, j / 21.0::DOUBLE AS y FROM range(22) a(i), range(22) b(j) WHERE i IN (0, 21) OR j IN (0, 21))
  UNION ALL SELECT false, z, {WEST}::DOUBLE + (col + 0.5::DOUBLE) * {STEP}::DOUBLE, {NORTH}::DOUBLE - (row + 0.5::DOUBLE) * {STEP}::DOUBLE FROM p), {FORWARD}, g AS (SELECT min(e) AS x0, max(n) AS y0 FROM q3 WHERE edge)
 SELECT floor((y0 - n) / 2500)::BIGINT AS row, floor((e - x0) / 2500)::BIGINT AS col, round(avg(z) + {NUDGE}, 6) AS value FROM q3, g WHERE NOT edge GROUP BY 1, 2"""))


def control_points(s, d):
    """Control points of scenes: places of orders, of which some scenes have fewer than three, or a column alone."""
    o = V.read(s, d, "orders").selectExpr("o_custkey as scene_id", "o_orderkey as k")
    return o.selectExpr("scene_id", "k % 97 as row", "case when scene_id % 10 = 3 then 5 else k % 89 end as col", "k").selectExpr("scene_id", "row", "col", "30D * col + 0.5D * row + 100 + (k % 7) / 10D as x", "5000 - 30D * row + 0.25D * col + (k % 5) / 10D as y")


POINTS = "c AS (SELECT o_custkey AS scene_id, o_orderkey % 97 AS row, CASE WHEN o_custkey % 10 = 3 THEN 5 ELSE o_orderkey % 89 END AS col, o_orderkey AS k FROM orders), p AS (SELECT scene_id, row, col, 30 * col + 0.5::DOUBLE * row + 100 + (k % 7) / 10.0::DOUBLE AS x, 5000 - 30 * row + 0.25::DOUBLE * col + (k % 5) / 10.0::DOUBLE AS y FROM c)"
FIT = """m AS (SELECT scene_id, count(*) AS points, avg(col) AS mc, avg(row) AS mr, avg(x) AS mx, avg(y) AS my, var_pop(col) AS cc, var_pop(row) AS rr, covar_pop(col, row) AS cr, covar_pop(col, x) AS cx, covar_pop(row, x) AS rx, covar_pop(col, y) AS cy, covar_pop(row, y) AS ry FROM p GROUP BY scene_id),
 f AS (SELECT *, CASE WHEN points < 3 THEN 'fewer than three points' WHEN cc * rr - cr * cr <= 1e-9 * cc * rr THEN 'points on one line' END AS error, cc * rr - cr * cr AS det FROM m),
 t AS (SELECT *, CASE WHEN error IS NULL THEN (cx * rr - rx * cr) / det END AS ax, CASE WHEN error IS NULL THEN (rx * cc - cx * cr) / det END AS bx, CASE WHEN error IS NULL THEN (cy * rr - ry * cr) / det END AS ay, CASE WHEN error IS NULL THEN (ry * cc - cy * cr) / det END AS by FROM f)"""


def fitted(s, d):
    fits = W.fit_control_points(control_points(s, d), "scene_id")
    off = W.residuals(control_points(s, d), fits, "scene_id")
    return steady(steady(fits.join(off, "scene_id", "left"), 4, "ax", "bx", "ay", "by", "rms"), 2, "cx", "cy")


register("control_point_fit", fitted, f"""WITH {POINTS}, {FIT}, z AS (SELECT *, mx - ax * mc - bx * mr AS tx, my - ay * mc - "by" * mr AS ty FROM t),
 e AS (SELECT p.scene_id, sqrt(avg((ax * col + bx * row + tx - x) * (ax * col + bx * row + tx - x) + (ay * col + "by" * row + ty - y) * (ay * col + "by" * row + ty - y))) AS rms FROM p JOIN z USING (scene_id) WHERE error IS NULL GROUP BY p.scene_id)
 SELECT scene_id, round(ax + {NUDGE}, 4) AS ax, round(bx + {NUDGE}, 4) AS bx, round(ay + {NUDGE}, 4) AS ay, round("by" + {NUDGE}, 4) AS "by", round(tx + {NUDGE}, 2) AS cx, round(ty + {NUDGE}, 2) AS cy, points, error, round(rms + {NUDGE}, 4) AS rms FROM z LEFT JOIN e USING (scene_id)""")
register("geometric_correction_warp", lambda s, d: W.correct(masked(s, d), "z", (0.9, 0.2, 10.0, 0.2, -0.9, 400.0), height(s, d), V.GRID, "EPSG:3857", "nearest")[0], over(f""", {MASKED}, k AS (SELECT min(x) AS x0, max(x) AS x1, max(y) AS y0, min(y) AS y1, sqrt(0.81::DOUBLE + 0.04::DOUBLE) AS s FROM (SELECT 0.9::DOUBLE * c + 0.2::DOUBLE * r + 10 AS x, 0.2::DOUBLE * c - 0.9::DOUBLE * r + 400 AS y FROM h, (VALUES (0), (128)) a(c), (SELECT 0 AS r UNION ALL SELECT h FROM h))),
 b AS (SELECT i AS row, j AS col, x0 + (j + 0.5::DOUBLE) * s - 10 AS x, y0 - (i + 0.5::DOUBLE) * s - 400 AS y FROM k, range(ceil((y0 - y1) / s - 1e-9)::BIGINT) a(i), range(ceil((x1 - x0) / s - 1e-9)::BIGINT) c(j)),
 f AS (SELECT row, col, (0.9::DOUBLE * y - 0.2::DOUBLE * x) / -0.85::DOUBLE AS fr, (-0.9::DOUBLE * x - 0.2::DOUBLE * y) / -0.85::DOUBLE AS fc FROM b) SELECT f.row, f.col, z AS value FROM f JOIN p ON p.row = floor(fr) AND p.col = floor(fc)"""))
ZOOM = 7


def numbers(s, d):
    """Three bands as whole numbers, which are stretched by their percentiles."""
    return V.grid_bands(s, d).select("row", "col", *(F.expr(f"round({b} * 4000) + 100").alias(b) for b in ("b3", "b2", "b1")))


def tiled(s, d):
    return T.render(numbers(s, d), ["b3", "b2", "b1"], W.Grid("EPSG:4326", WEST, NORTH, STEP, STEP, V.GRID, height(s, d)), ZOOM).drop("rgba")


SHOWN = ", ".join(f"sum(floor(greatest(least(({b} - lo_{b}) / (hi_{b} - lo_{b}) * 255, 255), 0)))::BIGINT AS {c}" for b, c in (("b3", "red"), ("b2", "green"), ("b1", "blue")))
PIXELS = 256 << ZOOM
register("render_tiles", tiled, over(f""", n AS (SELECT row, col, {", ".join(f"round({b} * 4000) + 100 AS {b}" for b in ("b3", "b2", "b1"))} FROM grid_bands), q AS (SELECT {", ".join(f"quantile_cont({b}, 0.02) AS lo_{b}, quantile_cont({b}, 0.98) AS hi_{b}" for b in ("b3", "b2", "b1"))} FROM n),
 gx AS (SELECT i AS gx, floor(((i + 0.5::DOUBLE) / {PIXELS} * 360 - 180 - {WEST}::DOUBLE) / {STEP}::DOUBLE) AS col FROM range({PIXELS}) a(i)), gy AS (SELECT i AS gy, floor(({NORTH}::DOUBLE - degrees(atan(sinh(pi() * (1 - 2 * (i + 0.5::DOUBLE) / {PIXELS}))))) / {STEP}::DOUBLE) AS row FROM range({PIXELS}) a(i))
 SELECT gx // 256 AS x, gy // 256 AS y, count(*) AS opaque, {SHOWN} FROM n JOIN gx USING (col) JOIN gy USING (row), q GROUP BY 1, 2""", "grid_bands"))
