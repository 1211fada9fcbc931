"""Time series of pixels (row, col, day, value): composites, smoothing, trend, seasonality, phenology.

The axis is the order of observations of a pixel; a value that is NULL is a missing observation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

KEYS = ["row", "col"]


def pixel_window():
    return Window.partitionBy("row", "col").orderBy("day")


def calendar_composite(series: DataFrame, pattern: str) -> DataFrame:
    """Mean for each pixel and calendar label; undated observations take no part."""
    return series.filter("day is not null").groupBy(*KEYS, F.date_format("day", pattern).alias("label")).agg(F.avg("value").alias("value"))


def composite(series: DataFrame, statistic: str) -> DataFrame:
    value = F.max("value") if statistic == "max" else F.percentile("value", F.lit(0.5))
    return series.groupBy(*KEYS).agg(value.alias("value"))


def moving_window(series: DataFrame, size: int) -> DataFrame:
    """Centered mean of the valid neighbours; an even size is raised to the next odd one."""
    half = max(1, size + (size % 2 == 0)) // 2
    return series.select(*KEYS, "day", F.avg("value").over(pixel_window().rowsBetween(-half, half)).alias("value"))


def gap_fill(series: DataFrame) -> DataFrame:
    """Linear interpolation over the observation index; ends are held, a pixel without values stays missing."""
    s = series.withColumn("idx", F.row_number().over(pixel_window()) - 1)
    back = pixel_window().rowsBetween(Window.unboundedPreceding, 0)
    ahead = pixel_window().rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col("value").isNotNull(), F.col("idx"))
    s = s.withColumns({"v0": F.last("value", True).over(back), "i0": F.last(place, True).over(back), "v1": F.first("value", True).over(ahead), "i1": F.first(place, True).over(ahead)})
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("idx") - F.col("i0")) / (F.col("i1") - F.col("i0"))
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull(), F.col("v0")).otherwise(between)
    return s.select(*KEYS, "day", "idx", filled.alias("value"))


def savgol_weights(window: int, order: int) -> list[list[float]]:
    """For each place in a window, the weights of its values: a polynomial fitted to the window, read at that place."""
    hat = np.vander(np.arange(window) - window // 2, min(order, window - 1) + 1, increasing=True)
    return (hat @ np.linalg.pinv(hat)).tolist()


def savgol(series: DataFrame, window: int = 5, order: int = 2) -> DataFrame:
    """Savitzky-Golay smoothing after gap filling, for pixels with three observations or more.

    An even window is raised to the next odd one; a shorter series takes the largest odd window that it holds. Inner values are
    read at the middle of their own window, the ends from the fit of the first and the last one. All weights are constants of
    the plan: a window over each pixel's series, no join. A pixel without values stays missing.
    """
    full = window + (window % 2 == 0)
    line, whole = Window.partitionBy(*KEYS).orderBy("idx"), Window.partitionBy(*KEYS)
    sizes = range(3, full + 1, 2) if full >= 3 else [full]
    near = {k: f"v{k + full}" for k in range(1 - sizes[-1], sizes[-1])}
    n, idx = F.col("n"), F.col("idx")
    s = gap_fill(series).withColumns({"n": F.count("*").over(whole), **{name: F.lag("value", -k).over(line) for k, name in near.items()}}).filter("n >= 3")
    used = F.least(F.lit(sizes[-1]), n - F.when(n % 2 == 0, 1).otherwise(0))
    place = idx - F.least(F.greatest(idx - F.floor(F.col("used") / 2), F.lit(0)), n - F.col("used"))
    value = F.coalesce(*(
        F.when((F.col("used") == size) & (F.col("place") == p), sum(F.col(near[j - p]) * w for j, w in enumerate(weights)))
        for size in sizes for p, weights in enumerate(savgol_weights(size, order))
    ))
    return s.withColumn("used", used).withColumn("place", place).select(*KEYS, "day", value.alias("value"))


def trend(series: DataFrame) -> DataFrame:
    """Least-squares slope per day, intercept at the pixel's first day, and R squared (two dates at least)."""
    s = series.filter("value is not null").withColumn("x", F.datediff("day", F.min("day").over(Window.partitionBy(*KEYS))))
    t = s.groupBy(*KEYS).agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), F.regr_r2("value", "x").alias("r2"), F.count_distinct("x").alias("n"))
    return t.filter("n >= 2").select(*KEYS, "slope", "intercept", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "r2")).alias("r2"))


def seasonality(series: DataFrame) -> DataFrame:
    """Mean, amplitude, and day of year of the first peak and first trough."""
    order = F.datediff("day", F.lit("1970-01-01"))
    return series.filter("value is not null").groupBy(*KEYS).agg(
        F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("amplitude"),
        F.max_by(F.dayofyear("day"), F.struct("value", -order)).alias("peak"), F.min_by(F.dayofyear("day"), F.struct("value", order)).alias("trough"),
    )


def phenology(series: DataFrame, share: float = 0.5) -> DataFrame:
    """Start, end, peak, length and amplitude of the season above low + share * amplitude; a flat series gives none."""
    filled = gap_fill(series).filter("value is not null")
    whole = Window.partitionBy(*KEYS)
    s = filled.withColumn("low", F.min("value").over(whole)).withColumn("high", F.max("value").over(whole)).filter("high > low")
    inside = F.col("value") >= F.col("low") + share * (F.col("high") - F.col("low"))
    when = F.dayofyear("day")
    g = s.groupBy(*KEYS).agg(
        F.min(F.when(inside, F.struct("idx", when.alias("t"))))["t"].alias("start"), F.max(F.when(inside, F.struct("idx", when.alias("t"))))["t"].alias("end"),
        F.max_by(when, F.struct("value", -F.col("idx"))).alias("peak"), (F.max("high") - F.max("low")).alias("amplitude"),
    )
    return g.select(*KEYS, "start", "end", "peak", (F.col("end") - F.col("start")).alias("length"), "amplitude")


def ordered(scenes: DataFrame) -> DataFrame:
    """Observation order within a group: dated first by date, undated after, ties by input position."""
    w = Window.partitionBy("group").orderBy(F.col("acquired_on").asc_nulls_last(), "pos")
    return scenes.withColumn("obs", F.row_number().over(w) - 1)


def cadence(series: DataFrame) -> DataFrame:
    """Per pixel: gaps in days, whether they differ, and whether a date repeats."""
    gap = F.datediff("day", F.lag("day").over(pixel_window()))
    g = series.select(*KEYS, gap.alias("gap")).groupBy(*KEYS)
    return g.agg(F.min("gap").alias("least"), F.max("gap").alias("most"), (F.count_distinct("gap") > 1).alias("irregular"), F.coalesce(F.bool_or(F.col("gap") == 0), F.lit(False)).alias("repeated"))
