"""Queries over time series of pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as T
from . import views as V
from .pixel_plans import rounded, texts
from .registry import register


def gappy(spark, d):
    """The series with every fifth day of a pixel missing."""
    return V.series(spark, d).withColumn("value", F.when((F.dayofyear("day") + F.col("col")) % 5 != 0, F.col("value")))


GAPPY = "gappy AS (SELECT row, col, day, CASE WHEN (dayofyear(day) + col) % 5 <> 0 THEN value END AS value FROM series)"
FILL = GAPPY + """, i AS (SELECT *, row_number() OVER w - 1 AS idx FROM gappy WINDOW w AS (PARTITION BY row, col ORDER BY day)),
 f AS (SELECT row, col, day, idx, value,
  last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0,
  first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS i1 FROM i
  WINDOW b AS (PARTITION BY row, col ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY row, col ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 filled AS (SELECT row, col, day, idx, CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (idx - i0) / (i1 - i0) END AS value FROM f)"""


def over(body: str) -> str:
    return V.with_views(body, "series")


for name, spark_format, duck in (("ts_monthly_composite", "yyyy-MM", "%Y-%m"), ("ts_annual_composite", "yyyy", "%Y")):
    register(name, lambda s, d, f=spark_format: rounded(T.calendar_composite(V.series(s, d), f), "value"), over(f"SELECT row, col, strftime(day, '{duck}') AS label, round(avg(value), 6) AS value FROM series GROUP BY ALL"))
register("ts_max_composite", lambda s, d: T.composite(V.series(s, d), "max"), over("SELECT row, col, max(value) AS value FROM series GROUP BY ALL"))
register("ts_median_composite", lambda s, d: rounded(T.composite(V.series(s, d), "median"), "value"), over("SELECT row, col, round(quantile_cont(value, 0.5), 6) AS value FROM series GROUP BY ALL"))
register("ts_moving_window", lambda s, d: texts(rounded(T.moving_window(gappy(s, d), 4), "value"), "day"), over(f", {GAPPY} SELECT row, col, day::VARCHAR AS day, round(avg(value) OVER (PARTITION BY row, col ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS value FROM gappy"))
register("ts_gap_fill", lambda s, d: texts(rounded(T.gap_fill(gappy(s, d)), "value"), "day"), over(f", {FILL} SELECT row, col, day::VARCHAR AS day, idx::INTEGER AS idx, round(value, 6) AS value FROM filled"))
KERNEL = ", ".join(f"({size}, {p}, {j}, {w!r}::DOUBLE)" for size in (3, 5) for p, line in enumerate(T.savgol_weights(size, 2)) for j, w in enumerate(line))
register("ts_savgol", lambda s, d: texts(rounded(T.savgol(gappy(s, d)), "value"), "day"), over(f""", {FILL}, k AS (SELECT * FROM (VALUES {KERNEL}) t(size, place, j, w)),
 n AS (SELECT *, least(5, c - (c % 2 = 0)::INTEGER) AS size FROM (SELECT *, count(*) OVER (PARTITION BY row, col) AS c FROM filled) WHERE c >= 3), b AS (SELECT *, least(greatest(idx - size // 2, 0), c - size) AS start FROM n)
 SELECT b.row, b.col, b.day::VARCHAR AS day, round(sum(w * f.value), 6) AS value FROM b JOIN k ON k.size = b.size AND k.place = b.idx - b.start JOIN filled f ON f.row = b.row AND f.col = b.col AND f.idx = b.start + j GROUP BY b.row, b.col, b.day"""))
register("ts_trend", lambda s, d: rounded(T.trend(V.series(s, d)), "slope", "intercept", "r2"), over(", x AS (SELECT row, col, value, date_diff('day', min(day) OVER (PARTITION BY row, col), day) AS x FROM series) SELECT row, col, round(regr_slope(value, x), 6) AS slope, round(regr_intercept(value, x), 6) AS intercept, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, regr_r2(value, x))), 6) AS r2 FROM x GROUP BY row, col HAVING count(DISTINCT x) >= 2"))
register("ts_seasonality", lambda s, d: rounded(T.seasonality(V.series(s, d)), "mean", "amplitude"), over("SELECT row, col, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS amplitude, arg_max(dayofyear(day), (value, -date_diff('day', DATE '1970-01-01', day)))::INTEGER AS peak, arg_min(dayofyear(day), (value, date_diff('day', DATE '1970-01-01', day)))::INTEGER AS trough FROM series GROUP BY row, col"))
register("ts_phenology", lambda s, d: rounded(T.phenology(gappy(s, d)), "amplitude"), over(f""", {FILL}, e AS (SELECT *, min(value) OVER p AS lo, max(value) OVER p AS hi FROM filled WHERE value IS NOT NULL WINDOW p AS (PARTITION BY row, col)),
 g AS (SELECT row, col, arg_min(dayofyear(day), idx) FILTER (WHERE value >= lo + 0.5::DOUBLE * (hi - lo)) AS "start", arg_max(dayofyear(day), idx) FILTER (WHERE value >= lo + 0.5::DOUBLE * (hi - lo)) AS "end", arg_max(dayofyear(day), (value, -idx)) AS peak, max(hi) - max(lo) AS amplitude FROM e WHERE hi > lo GROUP BY row, col)
 SELECT row, col, "start"::INTEGER AS "start", "end"::INTEGER AS "end", peak::INTEGER AS peak, ("end" - "start")::INTEGER AS length, round(amplitude, 6) AS amplitude FROM g"""))
register("ts_cadence_check", lambda s, d: T.cadence(V.series(s, d)), over(", g AS (SELECT row, col, date_diff('day', lag(day) OVER (PARTITION BY row, col ORDER BY day), day)::INTEGER AS gap FROM series) SELECT row, col, min(gap) AS least, max(gap) AS most, count(DISTINCT gap) > 1 AS irregular, coalesce(bool_or(gap = 0), false) AS repeated FROM g GROUP BY row, col"))
register("timing_value", lambda s, d: V.series(s, d).select("row", "col", F.col("day").cast("string").alias("day"), F.dayofyear("day").alias("timing")), over("SELECT row, col, day::VARCHAR AS day, dayofyear(day)::INTEGER AS timing FROM series"))
register("time_axis", lambda s, d: V.series(s, d).withColumn("axis", F.datediff("day", F.min("day").over(T.Window.partitionBy("row", "col")))).select("row", "col", F.col("day").cast("string").alias("day"), "axis"), over("SELECT row, col, day::VARCHAR AS day, date_diff('day', min(day) OVER (PARTITION BY row, col), day)::INTEGER AS axis FROM series"))
register("month_label", lambda s, d: V.series(s, d).groupBy(F.date_format("day", "yyyy-MM").alias("label")).count(), over("SELECT strftime(day, '%Y-%m') AS label, count(*) AS count FROM series GROUP BY 1"))
register("ts_report", lambda s, d: gappy(s, d).groupBy("row", "col").agg(F.count("*").alias("inputs"), F.count("value").alias("used"), F.round(F.count("value") / F.count("*"), 6).alias("coverage"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day")), over(f", {GAPPY} SELECT row, col, count(*) AS inputs, count(value) AS used, round(count(value)::DOUBLE / count(*), 6) AS coverage, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM gappy GROUP BY row, col"))
