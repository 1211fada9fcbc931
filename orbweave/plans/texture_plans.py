"""Queries over blocks with halos, second differences, wetness and spectral-spatial labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import focal as N, gridgraph as G, learn, texture as T
from . import views as V
from .pixel_plans import rounded
from .registry import register
from .spatial_plans import FLOW, GRAD, H, QUANT, grad, height, levels, over

SECOND = f"""{GRAD}, k AS (SELECT a.row, a.col,
 CASE WHEN a.col = 0 THEN r.gx - a.gx WHEN a.col = 127 THEN a.gx - l.gx ELSE (r.gx - l.gx) / 2 END + CASE WHEN a.row = 0 THEN d.gy - a.gy WHEN a.row = {H} - 1 THEN a.gy - u.gy ELSE (d.gy - u.gy) / 2 END AS curvature
 FROM g a LEFT JOIN g l ON l.row = a.row AND l.col = a.col - 1 LEFT JOIN g r ON r.row = a.row AND r.col = a.col + 1
 LEFT JOIN g u ON u.row = a.row - 1 AND u.col = a.col LEFT JOIN g d ON d.row = a.row + 1 AND d.col = a.col)"""
register("dem_curvature", lambda s, d: rounded(T.curvature(V.dem(s, d), "z", height(s, d), 128), "curvature"), over(f", {SECOND} SELECT row, col, round(curvature, 6) AS curvature FROM k"))


def wetness(s, d):
    flow = G.flow_accumulation(G.stored(G.d8_flow(V.dem(s, d)), "d8"))
    return T.wetness(flow, grad(s, d).select("row", "col", N.slope(None).alias("slope"))).select("row", "col", F.round("twi", 5).alias("twi"))


register("dem_twi", wetness, over(f""", {GRAD}, {FLOW}, walk AS (SELECT row AS r, col AS c, row, col FROM dem UNION ALL SELECT r, c, to_row, to_col FROM walk JOIN flow USING (row, col) WHERE to_row <> row OR to_col <> col),
 acc AS (SELECT row, col, count(*) AS n FROM walk GROUP BY row, col)
 SELECT g.row, g.col, round(ln(greatest(n, 1) / tan(greatest(atan(sqrt(gx * gx + gy * gy)), radians(0.1::DOUBLE)))), 5) AS twi FROM g JOIN acc USING (row, col)"""))
PAIR = "p AS (SELECT a.row, a.col, a.level AS a, b.level AS b FROM q a JOIN q b ON b.row = a.row AND b.col = a.col + 1), w AS (SELECT q.row, q.col, p.a, p.b FROM q JOIN p ON p.row BETWEEN q.row - 1 AND q.row + 1 AND p.col BETWEEN q.col - 1 AND q.col)"
register("glcm_histogram", lambda s, d: rounded(T.glcm_histogram(levels(s, d)), "asm", "energy", "entropy"), over(f""", {QUANT}, {PAIR}, n AS (SELECT row, col, a, b, count(*) AS n FROM w GROUP BY ALL)
 SELECT row, col, round(sum(n * n) / (sum(n) * sum(n)), 6) AS asm, round(sqrt(sum(n * n) / (sum(n) * sum(n))), 6) AS energy, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM n GROUP BY row, col"""))
register("glcm_correlation", lambda s, d: rounded(T.glcm_correlation(levels(s, d)), "correlation"), over(f""", {QUANT}, {PAIR}, m AS (SELECT row, col, sum(a * b) / count(*) - (sum(a) / count(*)) * (sum(b) / count(*)) AS ab,
 sqrt(greatest(sum(a * a) / count(*) - (sum(a) / count(*)) * (sum(a) / count(*)), 0) * greatest(sum(b * b) / count(*) - (sum(b) / count(*)) * (sum(b) / count(*)), 0)) AS s FROM w GROUP BY row, col)
 SELECT row, col, round(CASE WHEN s > 1e-12 THEN ab / s ELSE 0 END, 6) AS correlation FROM m"""))
#: Pixels with their neighbours, the grid's edge repeated.
NEAR = f"s AS (SELECT a.row, a.col, a.z, t.i, t.j, b.z AS v FROM dem a CROSS JOIN (SELECT i, j FROM range(-{{h}}, {{h}} + 1) x(i), range(-{{h}}, {{h}} + 1) y(j)) t LEFT JOIN dem b ON b.row = greatest(least(a.row + t.i, {H} - 1), 0) AND b.col = greatest(least(a.col + t.j, 127), 0))"
register("lbp", lambda s, d: T.lbp(V.dem(s, d), "z", height(s, d), 128, 1.0, 4), over(f", {NEAR.format(h=1)}, k AS (SELECT row, col, sum(CASE WHEN v >= z THEN CASE WHEN i = 0 AND j = 1 THEN 1 WHEN i = -1 AND j = 0 THEN 2 WHEN i = 0 AND j = -1 THEN 4 WHEN i = 1 AND j = 0 THEN 8 ELSE 0 END ELSE 0 END) AS code, bool_or(v IS NULL AND abs(i) + abs(j) = 1) AS open FROM s GROUP BY row, col) SELECT row, col, CASE WHEN NOT open THEN code::BIGINT END AS code FROM k"))
REAL, IMAGINARY = T.gabor_kernels(0.2, 30.0, 0.6)
KERNEL = ", ".join(f"({i - 2}, {j - 2}, {float(REAL[i, j])!r}::DOUBLE, {float(IMAGINARY[i, j])!r}::DOUBLE)" for i in range(5) for j in range(5))
register("gabor", lambda s, d: T.gabor(V.dem(s, d), "z", height(s, d), 128, 0.2, 30.0, 0.6).select("row", "col", F.round("value", 4).alias("value")), over(f", {NEAR.format(h=2)}, k AS (SELECT * FROM (VALUES {KERNEL}) t(di, dj, re, im)), m AS (SELECT avg(z) AS mean FROM dem) SELECT row, col, round(sqrt(sum(re * coalesce(v, mean)) * sum(re * coalesce(v, mean)) + sum(im * coalesce(v, mean)) * sum(im * coalesce(v, mean))), 4) AS value FROM s JOIN k ON di = -i AND dj = -j CROSS JOIN m GROUP BY row, col"))
classes = lambda s, d: V.dem(s, d).select("row", "col", (F.floor(F.col("z") / 200) + 1).cast("int").alias("label"))
register("median_filter_labels", lambda s, d: T.median_labels(classes(s, d), "label", height(s, d), 128), over(f", {NEAR.format(h=1)} SELECT row, col, quantile_disc(coalesce(floor(v / 200)::INTEGER + 1, 0), 0.5)::INTEGER AS label FROM s GROUP BY row, col"))


register("segment_spectral_spatial", lambda s, d: learn.spectral_spatial(V.grid_bands(s, d), list(V.BANDS), V.scene_height(s, d), 128, 5))
register("classify_svm", lambda s, d: learn.kernel_svm(V.read(s, d, "embeddings").select("vec_id", "label", "embedding"), "embedding", "label").select("vec_id", "prediction"))
