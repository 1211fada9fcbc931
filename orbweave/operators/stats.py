"""Band statistics: summaries, histograms, thresholds and stretches. One-row statistics are broadcast, data is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .graph import stored


def long_bands(df: DataFrame, bands: list[str]) -> DataFrame:
    """(row, col, band, value) of wide pixels."""
    pairs = ", ".join(f"{i + 1}, {b}" for i, b in enumerate(bands))
    return df.select("row", "col", F.expr(f"stack({len(bands)}, {pairs}) as (band, value)"))


def _with_quantiles(counted: DataFrame, pixels: DataFrame, shares: dict[str, float]) -> DataFrame:
    """counted, a row for each band with its _n, _lo and _hi, with columns for the named quantiles of pixels(band, value) in their place."""
    rows = counted.collect()  # a row for each band
    ends = [(r.band, r["_n"], r["_lo"], r["_hi"]) for r in rows if r["_n"]]
    found = band_quantiles(pixels, list(shares.values()), ends=ends)
    kept = [f for f in counted.schema.fields if f.name not in ("_n", "_lo", "_hi")]
    schema = StructType([*kept, *(StructField(name, DoubleType()) for name in shares)])
    return counted.sparkSession.createDataFrame([(*(r[f.name] for f in kept), *found.get(r.band, [None] * len(shares))) for r in rows], schema)


def _ends() -> list[Column]:
    """Count, least and largest of a band's values, NaN left out."""
    v = F.when(~F.isnan("value"), F.col("value").cast("double"))
    return [F.count(v).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi")]


def band_summary(pixels: DataFrame, *more: Column) -> DataFrame:
    """Per band of pixels(band, value): valid count, range, mean, population deviation, in one pass."""
    return pixels.groupBy("band").agg(F.count("value").alias("valid"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), *more)


def raster_statistics(df: DataFrame, bands: list[str], width: int, height: int) -> DataFrame:
    """band_summary with the count of missing pixels, p2, median and p98. The bands are stored once."""
    pixels = long_bands(stored(df.select("row", "col", *bands), "statistics"), bands)
    counted = band_summary(pixels, *_ends()).withColumn("missing", F.lit(width * height) - F.col("valid"))
    return _with_quantiles(counted, pixels, {"p2": 0.02, "median": 0.5, "p98": 0.98})


def bin_of(value, low, high, bins: int):
    """0-based equal-width bin; the last is closed."""
    return F.when(high <= low, 0).otherwise(F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, count, percent of all values, empty bins included."""
    edge = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))
    counts = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(bin_of(F.col(column), F.col("lo"), F.col("hi"), bins).alias("bin"), "n").count()
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce(F.col("count") * 100.0 / F.col("n"), F.lit(0.0)).alias("percent"))


def otsu(df: DataFrame, column: str, bins: int = 256, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """One row with the threshold: the center of the bin before the split of largest between-class variance."""
    width = (high - low) / bins
    inside = df.filter((F.col(column) >= low) & (F.col(column) <= high))
    counts = inside.groupBy(bin_of(F.col(column), F.lit(low), F.lit(high), bins).cast("long").alias("bin")).count()
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").fillna(0, ["count"])
    center = F.lit(low) + (F.col("bin") + 0.5) * width
    # At most `bins` rows from here on.
    up, down = Window.orderBy("bin"), Window.orderBy(F.desc("bin"))
    w = every.withColumn("x", center).withColumn("w1", F.sum("count").over(up)).withColumn("m1", F.sum(F.col("count") * F.col("x")).over(up)).withColumn("w2", F.sum("count").over(down)).withColumn("m2", F.sum(F.col("count") * F.col("x")).over(down))
    after = Window.orderBy("bin")
    w2, m2 = F.lead("w2").over(after), F.lead("m2").over(after)
    w = w.select("bin", "x", (F.col("w1") * w2 * F.pow(F.try_divide("m1", "w1") - F.try_divide(m2, w2), 2)).alias("between"))
    best = w.filter("between is not null").orderBy(F.desc("between"), "bin").limit(1)
    return best.select(F.col("x").alias("threshold"))


def percentile_normalize(df: DataFrame, band: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(x - low quantile) / spread, cut to 0..1; a spread that is not above 0 counts as 1. The band is stored once."""
    pixels = stored(df.select("row", "col", band), "normalize")
    a, b = exact_quantiles(pixels, band, [low, high])
    return pixels.select("row", "col", _cut(F.col(band), a, b).alias("value"))


def _cut(value: Column, a: float | None, b: float | None) -> Column:
    spread = b - a if a is not None and b > a else 1.0
    return F.greatest(F.least((value - F.lit(a).cast("double")) / spread, F.lit(1.0)), F.lit(0.0))


def normalize_bands(df: DataFrame, bands: list[str], low: float = 0.02, high: float = 0.98) -> tuple[DataFrame, float]:
    """percentile_normalize of all bands, in the same passes, and the mean over bands that a pixel of zeros would get.

    Pixels with a place and a finite value in every band are valid; others do not count and are left out. The valid ones are stored once.
    """
    wide = df.select("row", "col", *(F.col(b).cast("double").alias(b) for b in bands)).filter("row is not null and col is not null")
    pixels = stored(wide.filter(" and ".join(f"abs({b}) < double('infinity')" for b in bands)), "normalize")  # NaN is above infinity
    found = band_quantiles(long_bands(pixels, bands), [low, high])
    ends = [found.get(i + 1, [None, None]) for i in range(len(bands))]
    zero = sum(min(max(-a / (b - a if b > a else 1.0), 0.0), 1.0) for a, b in ends if a is not None) / len(bands)
    return pixels.select("row", "col", *(_cut(F.col(name), a, b).alias(name) for name, (a, b) in zip(bands, ends, strict=True))), zero


def standardize(df: DataFrame, bands: list[str]) -> DataFrame:
    """(x - mean) / deviation of each band; a zero deviation counts as 1."""
    stats = df.agg(*(F.avg(b).alias(f"m_{b}") for b in bands), *(F.stddev_pop(b).alias(f"s_{b}") for b in bands))
    one = lambda b: F.when(F.col(f"s_{b}") == 0, 1.0).otherwise(F.col(f"s_{b}"))
    return df.crossJoin(F.broadcast(stats)).select("row", "col", *(((F.col(b) - F.col(f"m_{b}")) / one(b)).alias(b) for b in bands))


def normalize_uint8(df: DataFrame, band: str) -> DataFrame:
    edge = df.agg(F.min(band).alias("lo"), F.max(band).alias("hi"))
    value = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(band) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(0)
    return df.crossJoin(F.broadcast(edge)).select("row", "col", value.cast("int").alias("value"))


def stretch_params(df: DataFrame, bands: list[str]) -> DataFrame:
    """Per band p2 and p98; under 10 values (0, 1), and a high not above the low is low + 1. The bands are stored once."""
    pixels = long_bands(stored(df.select("row", "col", *bands), "stretch"), bands)
    s = _with_quantiles(pixels.groupBy("band").agg(F.count("value").alias("n"), *_ends()), pixels, {"p": 0.02, "q": 0.98})
    low = F.when(F.col("n") < 10, 0.0).otherwise(F.col("p"))
    high = F.when(F.col("n") < 10, 1.0).otherwise(F.col("q"))
    return s.select("band", low.alias("low"), F.when(high <= low, low + 1).otherwise(high).alias("high"))


def band_quantiles(pixels: DataFrame, shares: list[float], bins: int = 4096, small: int = 1 << 14, ends: list[tuple] | None = None) -> dict[object, list[float]]:
    """Exact quantiles (linear between neighbours) of each band of pixels(band, value), all bands in the same passes.

    The interval that holds a rank is cut into bins until a bin holds one value, or few enough rows to sort: no task and no row
    ever holds a band's values. The ends of an interval are bins of their own, so every pass narrows it, infinite ends too.
    Passes read pixels again: store it first where it is dear. Nulls and NaN are left out; a band without values is not in the
    result. The driver gets at most `bins` counts for each interval and `small` values for each rank. ends: (band, count, least,
    largest) of these values, where they are known.
    """
    v = pixels.select("band", F.col("value").cast("double").alias("v")).filter("v is not null and not isnan(v)")
    sizes, found, todo = {}, {}, []  # todo: (band, least, largest, rows before, ranks inside)
    for band, n, lo, hi in ends if ends is not None else v.groupBy("band").agg(F.count("v"), F.min("v"), F.max("v")).collect():
        sizes[band] = n
        todo.append((band, lo, hi, 0, {int(k) for p in shares for k in (p * (n - 1) // 1, min(p * (n - 1) // 1 + 1, n - 1))}))

    def inside(intervals: list[tuple]) -> DataFrame:
        rows = [(i, t[0], t[1], t[2]) for i, t in enumerate(intervals)]  # a row for each band and rank, no more
        kind = v.schema["band"].dataType.simpleString()
        table = v.sparkSession.createDataFrame(rows, f"i int, band {kind}, a double, b double")
        return v.join(F.broadcast(table), "band").filter("v between a and b")

    while todo:
        onward, gather = [], []
        for band, a, b, _, ranks in todo:
            if a == b:
                found |= {(band, k): a for k in ranks}
        todo = [t for t in todo if t[1] != t[2]]
        if not todo:
            break
        width = F.col("b") / bins - F.col("a") / bins
        bin_ = F.when(F.col("v") == F.col("a"), -1).when(F.col("v") == F.col("b"), bins).when((width > 0) & (width < float("inf")), F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1))).otherwise(0)
        cells = inside(todo).groupBy("i", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        total = [t[3] for t in todo]
        for r in sorted(cells, key=lambda r: (r.i, r.bin)):
            before = total[r.i]
            own = {k for k in todo[r.i][4] if before <= k < before + r.n}
            total[r.i] += r.n
            if own:
                (gather if r.a < r.b and r.n <= small else onward).append((todo[r.i][0], r.a, r.b, before, own))
        if gather:
            lists: dict[int, list[float]] = {}
            for i, x in inside(gather).select("i", "v").collect():
                lists.setdefault(i, []).append(x)
            for i, (band, _, _, before, ranks) in enumerate(gather):
                values = sorted(lists[i])
                found |= {(band, k): values[k - before] for k in ranks}
        todo = onward
    out = {}
    for band, n in sizes.items():
        out[band] = []
        for p in shares:
            k = int(p * (n - 1) // 1)
            a, b = found[band, k], found[band, min(k + 1, n - 1)]
            out[band].append(a if a == b else a + (b - a) * (p * (n - 1) - k))
    return out


def exact_quantiles(df: DataFrame, column: str, shares: list[float], bins: int = 4096, small: int = 1 << 16) -> list[float | None]:
    """Exact quantiles of one column, see band_quantiles; without values every quantile is None."""
    one = df.select(F.lit(0).alias("band"), F.col(column).alias("value"))
    return band_quantiles(one, shares, bins, small).get(0, [None] * len(shares))


def middle_threshold(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row: the middle of two quantiles, null without values. The column is stored once."""
    a, b = exact_quantiles(stored(df.select(column), "threshold"), column, [low, high])
    return df.sparkSession.createDataFrame([((a + b) / 2 if a is not None else None,)], "threshold double")
