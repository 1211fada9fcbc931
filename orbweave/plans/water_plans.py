"""Queries over water masks that decide from the scene: units of the bands, thresholds, seeds, trained trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import water as W
from . import views as V
from .pixel_plans import at
from .registry import register
from .spatial_plans import height

FIVE = {"green": "b2", "swir": "b5", "nir": "b4", "red": "b3", "blue": "b1"}
#: The bands as numbers of each unit, from reflectance b.
NUMBERS = {"norm": "{b}", "8bit": "round({b} * 250)", "L2": "round({b} * 4000) + 100", "L1": "round({b} * 20000) + 5000", "unknown": "round({b} * 9000) + 3000"}


def numbers(s, d, unit):
    return V.grid_bands(s, d).select("row", "col", *(F.expr(f"cast({NUMBERS[unit].format(b=b)} as double)").alias(b) for b in FIVE.values()))


def rules(unit: str, mode: str) -> str:
    """The rules in SQL: unit and darkest percent of each band from its own values."""
    vegetation, infrared = W.MODES[mode]
    names = list(FIVE)
    raw = ", ".join(f"CASE WHEN x_{n} <> 0 AND x_{n} < 65535 THEN x_{n} END AS {n}" for n in names)
    source = ", ".join(f"({NUMBERS[unit].format(b=b)})::DOUBLE AS x_{n}" for n, b in FIVE.items())
    stats = ", ".join(f"max({n}) AS hi_{n}, avg({n}) AS mean_{n}, min({n}) AS lo_{n}, quantile_cont({n}, 0.01) AS dark_{n}" for n in names)
    kind = lambda n: f"CASE WHEN hi_{n} <= 1 THEN 'norm' WHEN hi_{n} <= 255 THEN '8bit' WHEN hi_{n} <= 12000 AND mean_{n} BETWEEN 200 AND 3000 THEN 'L2' WHEN hi_{n} > 12000 THEN 'L1' ELSE 'unknown' END"
    value = lambda n: f"CASE unit_{n} WHEN 'norm' THEN {n} WHEN '8bit' THEN {n} / 255 WHEN 'L2' THEN {n} / 10000 WHEN 'L1' THEN CASE WHEN {n} IS NOT NULL THEN greatest({n} - dark_{n}, 0) END / 65535 ELSE ({n} - lo_{n}) / (hi_{n} - lo_{n} + 1e-10::DOUBLE) END AS {n}"
    level = "(SELECT (quantile_cont(index, 0.5) + quantile_cont(index, 0.85)) / 2 FROM i)" if mode == "auto" else "0"
    return V.with_views(f""", x AS (SELECT row, col, {source} FROM grid_bands), r AS (SELECT row, col, {raw} FROM x), s AS (SELECT {stats} FROM r),
 u AS (SELECT r.*, s.*, {", ".join(f"{kind(n)} AS unit_{n}" for n in names)} FROM r, s), v AS (SELECT row, col, unit_green, unit_swir, unit_blue, {", ".join(value(n) for n in names)} FROM u),
 i AS (SELECT *, (green - swir) / (green + swir + 1e-10::DOUBLE) AS index, (nir - red) / (nir + red + 1e-10::DOUBLE) AS plants FROM v)
 SELECT row, col, (coalesce(index > {level} AND plants < {vegetation} AND nir < {infrared} AND green > red AND blue < green * CASE unit_blue WHEN 'L1' THEN 1.1::DOUBLE ELSE 1 END, false)
  OR coalesce(index > -0.1 AND nir < 0.05::DOUBLE * CASE unit_green WHEN 'L1' THEN 1.5 ELSE 1 END AND swir < 0.05::DOUBLE * CASE unit_swir WHEN 'L1' THEN 1.5 ELSE 1 END, false))::INTEGER AS mask,
  round(CASE WHEN index IS NOT NULL AND nir IS NOT NULL AND plants IS NOT NULL THEN greatest(least(0.45::DOUBLE * greatest(least((index + 1) / 2, 1), 0) + 0.3::DOUBLE * greatest(least({infrared}::DOUBLE - nir, {infrared}::DOUBLE), 0) / {infrared}::DOUBLE
   + 0.25::DOUBLE * greatest(least({vegetation}::DOUBLE - plants, {vegetation}::DOUBLE), 0) / {vegetation}::DOUBLE, 1), 0) END + 3e-8, 6) AS probability FROM i""", "grid_bands")


def ruled(s, d, unit, mode):
    found = W.rule_water(numbers(s, d, unit), FIVE, mode)
    return found.withColumn("probability", F.round(F.col("probability") + 3e-8, 6))


for unit in NUMBERS:
    register(f"extract_water_jrc_unit_{unit.lower()}", lambda s, d, u=unit: ruled(s, d, u, "standard"), rules(unit, "standard"))
register("extract_water_jrc_auto", lambda s, d: ruled(s, d, "L2", "auto"), rules("L2", "auto"))
register("extract_water_jrc_prob", lambda s, d: ruled(s, d, "norm", "prob"), rules("norm", "prob"))

GUIDE = "0.7::DOUBLE * (4 * (b2 - b4) - (0.25::DOUBLE * b5 + 2.75::DOUBLE * b6)) + 0.3::DOUBLE * ((b2 - b5) / (b2 + b5 + 1e-7::DOUBLE))"
register("water_seeds", lambda s, d: W.seeds(V.grid_bands(s, d).select("row", "col", W.guide(at.b2, at.b4, at.b5, at.b6).alias("guide"))).withColumn("guide", F.round(F.col("guide") + 3e-8, 6)), V.with_views(f""", g AS (SELECT row, col, {GUIDE} AS guide FROM grid_bands)
 SELECT row, col, round(guide + 3e-8, 6) AS guide, CASE WHEN guide > 0.45::DOUBLE THEN 'water' WHEN guide < -0.45::DOUBLE THEN 'land' WHEN guide > 0 THEN 'water?' WHEN guide < 0 THEN 'land?' END AS seed FROM g""", "grid_bands"))
SIX = {"blue": "b1", "green": "b2", "red": "b3", "nir": "b4", "swir1": "b5", "swir2": "b6"}
register("extract_water_adaptive", lambda s, d: W.adaptive_water(V.grid_bands(s, d), SIX, height(s, d), V.GRID))
# The fallback at every size: the number of seeds beyond 1.9 grows with the scene, so they must be too few by the query's own bound.
register("extract_water_adaptive_fallback", lambda s, d: W.adaptive_water(V.grid_bands(s, d), SIX, height(s, d), V.GRID, threshold=1.9, least_sure=W.MOST_SURE + 1), V.with_views(f"SELECT row, col, ({GUIDE} > 1.9::DOUBLE)::INTEGER AS mask FROM grid_bands", "grid_bands"))
