"""Queries of the ready-made raster jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import change, stats, templates as M
from . import views as V
from .pixel_plans import SIX, long_sql, rounded
from .registry import register


def raster(df: DataFrame, band: str) -> DataFrame:
    return df.select("row", "col", F.col(band).alias("value"))


def index(s, d) -> DataFrame:
    return M.vegetation_raster(raster(V.grid_t1(s, d), "b3"), raster(V.grid_t2(s, d), "b4"))


INDEX = """, i AS (SELECT row, col, ((n - r)::DOUBLE / nullif((n + r + 1e-8::FLOAT)::DOUBLE, 0))::FLOAT AS value
 FROM (SELECT row, col, a.b3::FLOAT AS r, b.b4::FLOAT AS n FROM grid_t1 a JOIN grid_t2 b USING (row, col)))"""
register("template_ndvi", lambda s, d: index(s, d).select("row", "col", F.round(F.col("value").cast("double"), 5).alias("value")), V.with_views(f"{INDEX} SELECT row, col, round(value::DOUBLE, 5) AS value FROM i WHERE value IS NOT NULL", "grid_t1", "grid_t2"))
register("template_ndvi_report", lambda s, d: M.raster_report(index(s, d)).select("valid", *(F.round(F.col(c).cast("double"), 5).alias(c) for c in ("low", "high"))), V.with_views(f"{INDEX} SELECT count(value) AS valid, round(min(value)::DOUBLE, 5) AS low, round(max(value)::DOUBLE, 5) AS high FROM i", "grid_t1", "grid_t2"))
register(
    "template_band_statistics",
    lambda s, d: rounded(M.band_report(stats.long_bands(V.grid_bands(s, d), SIX)), "low", "high", "mean", "std"),
    V.with_views(f", l AS ({long_sql}), m AS (SELECT bool_or(value IS NULL) AS masked FROM l) SELECT band, count(*) AS valid, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM l, m WHERE value IS NOT NULL AND (masked OR value <> 0) GROUP BY band", "grid_bands"),
)
LINE = ", ".join(f"({i - 8}, {k!r}::DOUBLE)" for i, k in enumerate(M.gaussian_line(2.0, 8).tolist()))
MIRROR = "CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END"
register(
    "template_gaussian",
    lambda s, d: rounded(M.smoothed(raster(V.dem(s, d), "z"), V.height(s, d), V.GRID), "value"),
    V.with_views(
        f", k AS (SELECT * FROM (VALUES {LINE}) t(i, w)), h AS (SELECT max(row) + 1 AS h FROM dem),"
        f" p AS (SELECT a.row, a.col, u.w * v.w AS w, {MIRROR.format(x='a.row + u.i', n='h')} AS r, {MIRROR.format(x='a.col + v.i', n='128')} AS c FROM dem a, h, k u, k v)"
        " SELECT p.row, p.col, round(sum(p.w * b.z), 6) AS value FROM p JOIN dem b ON b.row = r AND b.col = c GROUP BY p.row, p.col",
        "dem",
    ),
)
register(
    "template_composite",
    lambda s, d: change.stack_bands([(V.grid_t1(s, d), ["b1"]), (V.grid_t2(s, d), ["b1"]), (V.grid_bands(s, d), ["b1"])]),
    V.with_views("SELECT row, col, 1 AS band, b1 AS value FROM grid_t1 UNION ALL SELECT row, col, 2, b1 FROM grid_t2 UNION ALL SELECT row, col, 3, b1 FROM grid_bands", "grid_t1", "grid_t2", "grid_bands"),
)
register(
    "template_otsu",
    lambda s, d: M.binary(raster(V.grid_bands(s, d), "b1")),
    V.with_views(
        """, x AS (SELECT row, col, b1 AS v FROM grid_bands), r AS (SELECT min(v) AS lo, max(v) AS hi FROM x), c AS (SELECT least(floor((v - lo) / (hi - lo) * 256), 255)::BIGINT AS bin, count(*) AS n FROM x, r GROUP BY 1),
 e AS (SELECT i AS bin, coalesce(n, 0) AS n, lo + (i + 0.5::DOUBLE) * ((hi - lo) / 256) AS x FROM range(256) t(i) LEFT JOIN c ON c.bin = t.i CROSS JOIN r),
 w AS (SELECT bin, x, sum(n) OVER (ORDER BY bin) w1, sum(n * x) OVER (ORDER BY bin) m1, sum(n) OVER (ORDER BY bin DESC) w2, sum(n * x) OVER (ORDER BY bin DESC) m2 FROM e),
 l AS (SELECT bin, x, w1, m1, lead(w2) OVER (ORDER BY bin) w2, lead(m2) OVER (ORDER BY bin) m2 FROM w),
 o AS (SELECT x AS threshold FROM l WHERE w1 > 0 AND w2 > 0 ORDER BY w1 * w2 * (m1 / w1 - m2 / w2) * (m1 / w1 - m2 / w2) DESC, bin LIMIT 1)
 SELECT row, col, CASE WHEN v > threshold THEN 255 ELSE 0 END AS value FROM x, o""",
        "grid_bands",
    ),
)
