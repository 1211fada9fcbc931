"""Queries over pixels: indices, masks, statistics, change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import algebra as A, change, stats as S
from . import views as V
from .registry import register



class _Columns:
    """Columns by name, made when a query is built: importing this module needs no session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


at = _Columns()


def nd(a: str, b: str) -> str:
    return f"(CASE WHEN {a} + {b} = 0 THEN sign({a} - {b}) ELSE ({a} - {b}) / ({a} + {b}) END)"


def rt(a: str, b: str) -> str:
    return f"(({a} - {b}) / ({a} + {b} + 1e-10::DOUBLE))"


def cl(x: str) -> str:
    return f"greatest(least({x}, 1.0::DOUBLE), 0.0::DOUBLE)"


def pixel(name: str, value: Callable[[], Column], sql: str, out: str = "value", whole: bool = False) -> None:
    """A per-pixel expression over the grid."""
    shown = value if whole else lambda: F.round(value(), 6)
    register(name, lambda spark, d: V.grid_bands(spark, d).select("row", "col", shown().alias(out)), V.with_views(f"SELECT row, col, {sql if whole else f'round({sql}, 6)'} AS {out} FROM grid_bands", "grid_bands"))


WHITE = "((abs((b1 - (b1+b2+b3)/3) / ((b1+b2+b3)/3 + 1e-10::DOUBLE)) + abs((b2 - (b1+b2+b3)/3) / ((b1+b2+b3)/3 + 1e-10::DOUBLE)) + abs((b3 - (b1+b2+b3)/3) / ((b1+b2+b3)/3 + 1e-10::DOUBLE))) / 3)"
pixel("ndvi", lambda: A.ndvi(at.b3, at.b4), nd("b4", "b3"), "ndvi")
pixel("ndwi", lambda: A.ndwi(at.b2, at.b4), nd("b2", "b4"))
pixel("ndbi", lambda: A.ndbi(at.b5, at.b4), nd("b5", "b4"))
pixel("mndwi", lambda: A.mndwi(at.b2, at.b5), nd("b2", "b5"))
pixel("normalized_difference", lambda: A.normalized_difference(at.b1, at.b6), nd("b1", "b6"))
pixel("awei", lambda: A.awei(at.b2, at.b4, at.b5, at.b6), "4 * (b2 - b5) - (0.25::DOUBLE * b4 + 2.75::DOUBLE * b6)")
pixel("whiteness", lambda: A.whiteness(at.b1, at.b2, at.b3), WHITE)
pixel("hot", lambda: A.haze(at.b1, at.b3), "b1 - 0.5::DOUBLE * b3 - 0.08::DOUBLE")
pixel("ndsi", lambda: A.ratio(at.b2, at.b5), rt("b2", "b5"))


def cloud_sql(p: dict) -> str:
    return (
        f"(0.30::DOUBLE * {cl('((b1+b2+b3)/3 - 0.15::DOUBLE) / 0.55::DOUBLE')} + 0.20::DOUBLE * {cl('(b1 - 0.12::DOUBLE) / 0.50::DOUBLE')} + 0.20::DOUBLE * {cl(f'({p["whiteness"]}::DOUBLE - {WHITE}) / {p["whiteness"]}::DOUBLE')}"
        f" + 0.15::DOUBLE * {cl(f'({p["ndvi"]}::DOUBLE - {rt("b4", "b3")}) / ({p["ndvi"]}::DOUBLE + 1)')} + 0.10::DOUBLE * {cl(f'({p["ndsi"]}::DOUBLE - {rt("b2", "b5")}) / ({p["ndsi"]}::DOUBLE + 1)')}"
        f" + 0.05::DOUBLE * {cl(f'(b1 - 0.5::DOUBLE * b3 - 0.08::DOUBLE - {p["hot"]}::DOUBLE + 0.15::DOUBLE) / 0.40::DOUBLE')})"
    )


def fmask_sql(p: dict) -> str:
    return (
        f"({cloud_sql(p)} > {p['score']}::DOUBLE AND b1 > {p['blue']}::DOUBLE AND (b1+b2+b3)/3 > {p['brightness']}::DOUBLE AND {WHITE} < {p['whiteness']}::DOUBLE"
        f" AND {rt('b4', 'b3')} < {p['ndvi']}::DOUBLE AND {rt('b2', 'b5')} < {p['ndsi']}::DOUBLE AND b1 - 0.5::DOUBLE * b3 - 0.08::DOUBLE > {p['hot']}::DOUBLE)::INTEGER"
    )


def build_sql(p: dict) -> str:
    return f"(0.55::DOUBLE * {cl(f'({rt("b5", "b4")} + 1) / 2')} + 0.25::DOUBLE * {cl(f'({p["ndvi"]}::DOUBLE - {rt("b4", "b3")}) / ({p["ndvi"]}::DOUBLE + 1)')} + 0.20::DOUBLE * {cl(f'({p["mndwi"]}::DOUBLE - {rt("b2", "b5")}) / ({p["mndwi"]}::DOUBLE + 1)')})"


pixel("cloud_score", lambda: A.cloud_score(None), cloud_sql(A.CLOUD["default"]))
pixel("building_score", lambda: A.building_score(None), build_sql(A.BUILDING["default"]))
pixel("water_probability", lambda: 0.45 * A.clip01((A.ratio(at.b2, at.b5) + 1) / 2) + 0.30 * A.clip01((0.15 - at.b4) / 0.15) + 0.25 * A.clip01((0.1 - A.ratio(at.b4, at.b3)) / 1.1), f"0.45::DOUBLE * {cl(f'({rt("b2", "b5")} + 1) / 2')} + 0.30::DOUBLE * {cl('(0.15::DOUBLE - b4) / 0.15::DOUBLE')} + 0.25::DOUBLE * {cl(f'(0.1::DOUBLE - {rt("b4", "b3")}) / 1.1::DOUBLE')}")

flag = lambda c: c.cast("int")
pixel("extract_vegetation", lambda: flag(A.ndvi(at.b3, at.b4) > 0.25), f"({nd('b4', 'b3')} > 0.25::DOUBLE)::INTEGER", "mask", True)
pixel("extract_water_mndwi", lambda: flag(A.mndwi(at.b2, at.b5) > 0), f"({nd('b2', 'b5')} > 0)::INTEGER", "mask", True)
pixel("extract_water_ndwi", lambda: flag(A.ndwi(at.b2, at.b4) > 0), f"({nd('b2', 'b4')} > 0)::INTEGER", "mask", True)
pixel("extract_water_awei", lambda: flag(A.awei(at.b2, at.b4, at.b5, at.b6) > 0), "(4 * (b2 - b5) - (0.25::DOUBLE * b4 + 2.75::DOUBLE * b6) > 0)::INTEGER", "mask", True)
pixel("extract_cloud_threshold", lambda: flag((at.b1 > 0.40) & (at.b5 > 0.2)), "(b1 > 0.40::DOUBLE AND b5 > 0.2::DOUBLE)::INTEGER", "mask", True)
pixel("extract_cloud_cirrus", lambda: flag(at.b6 > 0.01), "(b6 > 0.01::DOUBLE)::INTEGER", "mask", True)
pixel("extract_cloud_score", lambda: flag(A.cloud_score(None) > 0.55), f"({cloud_sql(A.CLOUD['default'])} > 0.55::DOUBLE)::INTEGER", "mask", True)
pixel("extract_building_score", lambda: flag(A.building_score(None) > 0.55), f"({build_sql(A.BUILDING['default'])} > 0.55::DOUBLE)::INTEGER", "mask", True)
pixel("mask_threshold", lambda: flag(F.abs(at.b1 - at.b2) > 0.3), "(abs(b1 - b2) > 0.3::DOUBLE)::INTEGER", "mask", True)
for mode, p in A.CLOUD.items():
    pixel("extract_cloud_fmask" + ("" if mode == "default" else f"_{mode}"), lambda mode=mode, p=p: A.cloud_fmask(None, mode), fmask_sql(p), "mask", True)
for mode, p in A.BUILDING.items():
    limits = f"{rt('b4', 'b3')} < {p['ndvi']}::DOUBLE AND {rt('b2', 'b5')} < {p['mndwi']}::DOUBLE"
    pixel("extract_building_ndbi" + ("" if mode == "default" else f"_{mode}"), lambda mode=mode, p=p: A.building_mask(A.ratio(at.b5, at.b4), p["ndbi"], mode), f"({rt('b5', 'b4')} > {p['ndbi']}::DOUBLE AND {limits})::INTEGER", "mask", True)
IBI = f"(({rt('b5', 'b4')} - ({rt('b4', 'b3')} + {rt('b2', 'b5')}) / 2) / ({rt('b5', 'b4')} + ({rt('b4', 'b3')} + {rt('b2', 'b5')}) / 2 + 1e-10::DOUBLE))"
pixel("extract_building_ui", lambda: flag(A.ratio(at.b5, at.b4) > 0), f"({rt('b5', 'b4')} > 0)::INTEGER", "mask", True)
pixel("extract_building_ibi", lambda: A.building_mask(A.ibi(at.b2, at.b3, at.b4, at.b5), 0.0), f"({IBI} > 0 AND {rt('b4', 'b3')} < 0.2::DOUBLE AND {rt('b2', 'b5')} < 0.0::DOUBLE)::INTEGER", "mask", True)
register("ibi", lambda s, d: V.grid_bands(s, d).select("row", "col", F.round(F.greatest(F.least(A.ibi(at.b2, at.b3, at.b4, at.b5), F.lit(1000.0)), F.lit(-1000.0)), 3).alias("value")), V.with_views(f"SELECT row, col, round(greatest(least({IBI}, 1000.0::DOUBLE), -1000.0::DOUBLE), 3) AS value FROM grid_bands", "grid_bands"))

register("raster_calculator", lambda s, d: A.calculator(V.grid_bands(s, d), "where(A_2 > 0.2, sqrt(A), B + A_1)", {"A": ["b1", "b2", "b3"], "B": ["b4"]}).select("row", "col", *(F.round(f"r{i}", 6).alias(f"r{i}") for i in (1, 2, 3))), V.with_views("SELECT row, col, round(CASE WHEN b2 > 0.2::DOUBLE THEN sqrt(b1) ELSE b4 + b1 END, 6) AS r1, round(CASE WHEN b2 > 0.2::DOUBLE THEN sqrt(b2) ELSE b4 + b1 END, 6) AS r2, round(CASE WHEN b2 > 0.2::DOUBLE THEN sqrt(b3) ELSE b4 + b1 END, 6) AS r3 FROM grid_bands", "grid_bands"))
register("extract_bands", lambda s, d: S.long_bands(V.grid_bands(s, d), ["b3", "b1"]), V.with_views("SELECT row, col, 1 AS band, b3 AS value FROM grid_bands UNION ALL SELECT row, col, 2, b1 FROM grid_bands", "grid_bands"))
register("radiometric_calibration", lambda s, d: V.grid_bands(s, d).select("row", "col", F.round(A.calibrate(at.b1, F.lit(2.0), F.lit(-0.1), F.lit(45.0), True), 6).alias("value")), V.with_views(f"SELECT row, col, round({cl('(b1 * 2 - 0.1::DOUBLE) / sin(radians(45.0::DOUBLE))')}, 6) AS value FROM grid_bands", "grid_bands"))
register("reflectance_from_radiance", lambda s, d: V.grid_bands(s, d).select("row", "col", F.round(A.radiance_to_reflectance(at.b1, F.lit(1.01), F.lit(1.8), F.lit(50.0)), 6).alias("value")), V.with_views("SELECT row, col, round(pi() * b1 * 1.01::DOUBLE * 1.01::DOUBLE / (1.8::DOUBLE * sin(radians(50.0::DOUBLE))), 6) AS value FROM grid_bands", "grid_bands"))
register("atmospheric_correction_dos1", lambda s, d: A.dark_object(V.grid_bands(s, d).select("row", "col", "b1"), "b1", 0.05).select("row", "col", F.round("b1", 6).alias("value")), V.with_views("SELECT row, col, round(greatest(b1 - (SELECT greatest(quantile_cont(b1, 0.05), 0) FROM grid_bands), 0.0::DOUBLE), 6) AS value FROM grid_bands", "grid_bands"))
register("atmospheric_correction_quac", lambda s, d: A.quick_correction(V.grid_bands(s, d).select("row", "col", "b1"), "b1").select("row", "col", F.round("b1", 6).alias("value")), V.with_views(f", p AS (SELECT quantile_cont(b1, 0.01) AS lo, quantile_cont(b1, 0.99) AS hi FROM grid_bands) SELECT row, col, round({cl('(b1 - lo) / (hi - lo)')}, 6) AS value FROM grid_bands, p", "grid_bands"))
SIX = list(V.BANDS)
long_sql = " UNION ALL ".join(f"SELECT row, col, {i + 1} AS band, b{i + 1} AS value FROM grid_bands" for i in range(6))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """Dates and times as text: equal in every client."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if dict(df.dtypes)[c] == "timestamp" else F.col(c).cast("string") for c in columns})


register("raster_statistics", lambda s, d: rounded(S.raster_statistics(V.grid_bands(s, d), SIX, 128, V.height(s, d)), "low", "high", "mean", "std", "p2", "median", "p98"), V.with_views(f", l AS ({long_sql}) SELECT band, count(value) AS valid, 128 * (SELECT max(row) + 1 FROM dem) - count(value) AS missing, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.02), 6) AS p2, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.98), 6) AS p98 FROM l GROUP BY band", "grid_bands", "dem"))
register("band_statistics_fields", lambda s, d: S.band_summary(S.long_bands(V.grid_bands(s, d), SIX)).select("band", F.expr("stack(4, 'min', low, 'max', high, 'mean', mean, 'std', std) as (stat, value)")).select(F.concat(F.lit("band"), "band", F.lit("_"), "stat").alias("field"), F.round("value", 6).alias("value")), V.with_views(f", l AS ({long_sql}), t AS (SELECT band, min(value) a, max(value) b, avg(value) c, stddev_pop(value) e FROM l GROUP BY band) SELECT 'band' || band || '_min' AS field, round(a, 6) AS value FROM t UNION ALL SELECT 'band' || band || '_max', round(b, 6) FROM t UNION ALL SELECT 'band' || band || '_mean', round(c, 6) FROM t UNION ALL SELECT 'band' || band || '_std', round(e, 6) FROM t", "grid_bands"))
BIN = "CASE WHEN hi <= lo THEN 0 ELSE least(floor((b2 - lo) / (hi - lo) * {n}), {n} - 1) END"
for name, n in (("histogram", 32), ("context_statistics", 5)):
    register(name, lambda s, d, n=n: rounded(S.histogram(V.grid_bands(s, d), "b2", n), "percent"), V.with_views(f", e AS (SELECT min(b2) lo, max(b2) hi, count(b2) n FROM grid_bands), h AS (SELECT {BIN.format(n=n)} AS bin, count(*) c, any_value(n) n FROM grid_bands, e GROUP BY 1) SELECT i AS bin, coalesce(c, 0) AS count, round(coalesce(c * 100.0::DOUBLE / n, 0), 6) AS percent FROM range({n}) t(i) LEFT JOIN h ON h.bin = t.i", "grid_bands"))
register("class_histogram", lambda s, d: V.grid_bands(s, d).select(F.floor(at.b1 * 10).cast("int").alias("label")).filter("label > 0").groupBy("label").count(), V.with_views("SELECT floor(b1 * 10)::INTEGER AS label, count(*) AS count FROM grid_bands WHERE floor(b1 * 10) > 0 GROUP BY 1", "grid_bands"))
register("stretch_params", lambda s, d: rounded(S.stretch_params(V.grid_bands(s, d), SIX), "low", "high"), V.with_views(f", l AS ({long_sql}), q AS (SELECT band, quantile_cont(value, 0.02) a, quantile_cont(value, 0.98) b FROM l GROUP BY band) SELECT band, round(a, 6) AS low, round(CASE WHEN b <= a THEN a + 1 ELSE b END, 6) AS high FROM q", "grid_bands"))
register("percentile_normalize", lambda s, d: rounded(S.percentile_normalize(V.grid_bands(s, d), "b3"), "value"), V.with_views(f", p AS (SELECT quantile_cont(b3, 0.02) lo, quantile_cont(b3, 0.98) hi FROM grid_bands) SELECT row, col, round({cl('(b3 - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END')}, 6) AS value FROM grid_bands, p", "grid_bands"))
register("standardize", lambda s, d: rounded(S.standardize(V.grid_bands(s, d), ["b1", "b2"]), "b1", "b2"), V.with_views(", p AS (SELECT avg(b1) m1, avg(b2) m2, stddev_pop(b1) s1, stddev_pop(b2) s2 FROM grid_bands) SELECT row, col, round((b1 - m1) / s1, 6) AS b1, round((b2 - m2) / s2, 6) AS b2 FROM grid_bands, p", "grid_bands"))
register("normalize_uint8", lambda s, d: S.normalize_uint8(V.grid_bands(s, d), "b2"), V.with_views(", p AS (SELECT min(b2) lo, max(b2) hi FROM grid_bands) SELECT row, col, floor((b2 - lo) / (hi - lo) * 255)::INTEGER AS value FROM grid_bands, p", "grid_bands"))
register("auto_mndwi_threshold", lambda s, d: S.middle_threshold(V.grid_bands(s, d).select(A.ratio(at.b2, at.b5).alias("v")), "v", 0.5, 0.85).select(F.round("threshold", 6).alias("threshold")), V.with_views(f"SELECT round((quantile_cont({rt('b2', 'b5')}, 0.5) + quantile_cont({rt('b2', 'b5')}, 0.85)) / 2, 6) AS threshold FROM grid_bands", "grid_bands"))
OTSU = f"""{{head}}, x AS (SELECT row, col, {nd('b2', 'b5')} AS v FROM grid_bands), c AS (SELECT least(floor((v + 1) / 2 * 256), 255)::BIGINT AS bin, count(*) AS n FROM x GROUP BY 1),
 e AS (SELECT i AS bin, coalesce(n, 0) AS n, -1 + (i + 0.5::DOUBLE) / 128 AS x FROM range(256) t(i) LEFT JOIN c ON c.bin = t.i),
 w AS (SELECT bin, x, sum(n) OVER (ORDER BY bin) w1, sum(n * x) OVER (ORDER BY bin) m1, sum(n) OVER (ORDER BY bin DESC) w2, sum(n * x) OVER (ORDER BY bin DESC) m2 FROM e),
 l AS (SELECT bin, x, w1, m1, lead(w2) OVER (ORDER BY bin) w2, lead(m2) OVER (ORDER BY bin) m2 FROM w),
 o AS (SELECT x AS threshold FROM l WHERE w1 > 0 AND w2 > 0 ORDER BY w1 * w2 * (m1 / w1 - m2 / w2) * (m1 / w1 - m2 / w2) DESC, bin LIMIT 1)"""
otsu_head = V.with_views("", "grid_bands").rstrip()
register("otsu_threshold", lambda s, d: S.otsu(V.grid_bands(s, d).select(A.mndwi(at.b2, at.b5).alias("v")), "v").select(F.round("threshold", 6).alias("threshold")), OTSU.format(head=otsu_head) + " SELECT round(threshold, 6) AS threshold FROM o")


def water_otsu(spark, d):
    index = V.grid_bands(spark, d).select("row", "col", A.mndwi(at.b2, at.b5).alias("v"))
    return index.crossJoin(F.broadcast(S.otsu(index, "v"))).select("row", "col", (F.col("v") > F.col("threshold")).cast("int").alias("mask"))


register("extract_water_otsu", water_otsu, OTSU.format(head=otsu_head) + " SELECT row, col, (v > threshold)::INTEGER AS mask FROM x, o")

JOINED = "grid_t1 a JOIN grid_t2 b USING (row, col)"
register("change_band_diff", lambda s, d: rounded(change.band_diff(V.grid_t1(s, d), V.grid_t2(s, d), "b2", 0.2), "diff"), V.with_views(f"SELECT row, col, round(b.b2 - a.b2, 6) AS diff, (abs(b.b2 - a.b2) > 0.2::DOUBLE)::INTEGER AS mask FROM {JOINED}", "grid_t1", "grid_t2"))
register("change_band_ratio", lambda s, d: rounded(change.band_ratio(V.grid_t1(s, d), V.grid_t2(s, d), "b2", 0.5), "ratio"), V.with_views(f"SELECT row, col, round(b.b2 / (a.b2 + 1e-6::DOUBLE), 6) AS ratio, (abs(b.b2 / (a.b2 + 1e-6::DOUBLE) - 1) > 0.5::DOUBLE)::INTEGER AS mask FROM {JOINED}", "grid_t1", "grid_t2"))
register("change_index_diff", lambda s, d: rounded(change.index_diff(V.grid_t1(s, d), V.grid_t2(s, d), "b4", "b3", 0.3), "diff").withColumn("diff", F.col("diff") + 0.0), V.with_views(f", x AS (SELECT row, col, (b.b4 - b.b3) / (b.b4 + b.b3 + 1e-6::DOUBLE) - (a.b4 - a.b3) / (a.b4 + a.b3 + 1e-6::DOUBLE) AS v FROM {JOINED}) SELECT row, col, round(v, 6) + 0.0::DOUBLE AS diff, (abs(v) > 0.3::DOUBLE)::INTEGER AS mask FROM x", "grid_t1", "grid_t2"))
register("change_area_ratio", lambda s, d: change.area_ratio(change.band_diff(V.grid_t1(s, d), V.grid_t2(s, d), "b2", 0.2), 128, V.height(s, d)), V.with_views(f"SELECT round(sum((abs(b.b2 - a.b2) > 0.2::DOUBLE)::INTEGER) / (128.0::DOUBLE * (SELECT max(row) + 1 FROM dem)), 6) AS ratio FROM {JOINED}", "grid_t1", "grid_t2", "dem"))
register("join_bands_on_grid", lambda s, d: V.grid_t1(s, d).select("row", "col", F.col("b1").alias("first")).join(V.grid_t2(s, d).select("row", "col", F.col("b1").alias("second")), ["row", "col"]), V.with_views(f"SELECT row, col, a.b1 AS first, b.b1 AS second FROM {JOINED}", "grid_t1", "grid_t2"))
register("mask_or", lambda s, d: V.grid_t1(s, d).select("row", "col").union(V.grid_t2(s, d).select("row", "col")).distinct(), V.with_views("SELECT row, col FROM grid_t1 UNION SELECT row, col FROM grid_t2", "grid_t1", "grid_t2"))
register("mask_and", lambda s, d: V.grid_t1(s, d).select("row", "col").join(V.grid_t2(s, d), ["row", "col"], "left_semi"), V.with_views("SELECT row, col FROM grid_t1 SEMI JOIN grid_t2 USING (row, col)", "grid_t1", "grid_t2"))
register("merge_bands", lambda s, d: change.merge([(V.grid_t1(s, d).select("row", "col", F.lit(1).alias("band"), F.col("b1").alias("value")), 1), (V.grid_t2(s, d).select("row", "col", F.lit(1).alias("band"), F.col("b1").alias("value")), 1)]), V.with_views(f"SELECT row, col, 1 AS band, a.b1 AS value FROM {JOINED} UNION ALL SELECT row, col, 2, b.b1 FROM {JOINED}", "grid_t1", "grid_t2"))
register("zero_background_filter", lambda s, d: V.grid_bands(s, d).select("row", "col", F.when((at.b1 == 0) | F.isnan(at.b1), None).otherwise(at.b1).alias("value")), V.with_views("SELECT row, col, nullif(b1, 0) AS value FROM grid_bands", "grid_bands"))
register("pixel_validity_union", lambda s, d: S.long_bands(V.grid_bands(s, d), ["b1", "b3"]).groupBy("row", "col").agg(F.bool_or(F.col("value") != 0).alias("valid")), V.with_views("SELECT row, col, (b1 <> 0 OR b3 <> 0) AS valid FROM grid_bands", "grid_bands"))
register("write_pixels", lambda s, d: V.grid_bands(s, d).select("row", "col", F.coalesce(F.nullif(at.b1, F.lit(0.0)), F.lit(-9999.0)).cast("float").alias("value")), V.with_views("SELECT row, col, coalesce(nullif(b1, 0), -9999)::FLOAT AS value FROM grid_bands", "grid_bands"))
register("union_band_stack", lambda s, d: change.stack_bands([(V.grid_t1(s, d), ["b1", "b4"]), (V.grid_t2(s, d), ["b1", "b4", "b5"])]), V.with_views("SELECT row, col, 1 AS band, b1 AS value FROM grid_t1 UNION ALL SELECT row, col, 2, b4 FROM grid_t1 UNION ALL SELECT row, col, 3, b1 FROM grid_t2 UNION ALL SELECT row, col, 4, b4 FROM grid_t2 UNION ALL SELECT row, col, 5, b5 FROM grid_t2", "grid_t1", "grid_t2"))
