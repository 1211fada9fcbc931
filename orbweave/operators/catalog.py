"""Catalogue operators: acquisition metadata, time-series candidates, fields, names, jobs, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: File-name patterns (fixed formats): Sentinel-2, Landsat, any other date.
SENTINEL = r"(?i)(S2[AB])_MSI(L1C|L2A)_(\d{8}T\d{6})_.*_(T\d{2}[A-Z]{3})"
LANDSAT = r"(?i)(L[COTEM]\d{2})_(L\d[A-Z]{2})_(\d{6})_(\d{8})_"
GENERIC = r"(20\d{2}|19\d{2})[-_]?(0[1-9]|1[0-2])[-_]?(0[1-9]|[12]\d|3[01])"
#: Confidence of each source of a date (fixed values).
CONFIDENCE = {"stac": 1.0, "raster_tag": 0.92, "sentinel_filename": 0.9, "landsat_filename": 0.9, "filename": 0.55, "unknown": 0.0}
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM", "yyyy/MM", "yyyy")


def group(pattern: str, i: int, text: Column) -> Column:
    found = F.regexp_extract(text, pattern, i)
    return F.when(found != "", found)


def parse_date(text: Column) -> Column:
    """The first of the known formats that reads the whole text, else ISO; NULL when none does."""
    clean = F.trim(text)
    tries = [F.when(F.length(clean) == len(f), F.try_to_timestamp(clean, F.lit(f))) for f in DATE_FORMATS]
    return F.to_date(F.coalesce(*tries, F.try_to_timestamp(clean)))


MISSING_DATES = ("", "?", "none", "null", "unknown", "n/a")


def parse_date_list(text: Column) -> Column:
    """Dates of a text split at line ends, commas and semicolons; words for 'missing' and unreadable parts are NULL."""
    parts = F.split(text, r"[\n,;]")
    return F.transform(parts, lambda p: F.when(F.lower(F.trim(p)).isin(*MISSING_DATES), None).otherwise(parse_date(p)))


def metadata(scenes: DataFrame, *carried: str) -> DataFrame:
    """acquired_at, source, confidence, platform, level, tile_id of scenes(scene_id, file_name, tag_date, stac), and carried columns.

    Sidecar before tag before file name; the acquisition fields move together, the others each take the first value. Each
    pattern is matched once a row: the parts of a match are cut from its text. A null name, tag or sidecar gives nothing; a row
    that nothing dates comes back with source 'unknown'; repeated rows stay.
    """
    name = F.col("file_name")
    whole = lambda pattern: F.regexp_extract(name, pattern, 0)
    found = scenes.select("scene_id", *carried, "stac", "tag_date", whole(SENTINEL).alias("_s"), whole(LANDSAT).alias("_l"), F.translate(whole(GENERIC), "-_", "").alias("_g"))
    part = lambda c, i: F.when(F.col(c) != "", F.element_at(F.split(c, "_"), i))
    dated = lambda c, form: F.when(c != "", F.try_to_timestamp(c, F.lit(form)))
    dates = {
        "stac": F.try_to_timestamp(F.get_json_object("stac", "$.properties.datetime")), "raster_tag": F.try_to_timestamp("tag_date", F.lit("yyyy-MM-dd")),
        "sentinel_filename": dated(F.translate(part("_s", 3), "T", ""), "yyyyMMddHHmmss"), "landsat_filename": dated(part("_l", 4), "yyyyMMdd"), "filename": dated(F.col("_g"), "yyyyMMdd"),
    }
    options = F.array(*(F.struct(v.alias("at"), F.lit(k).alias("source"), F.lit(CONFIDENCE[k]).alias("confidence")) for k, v in dates.items()))
    first = F.get(F.filter(options, lambda o: o["at"].isNotNull()), F.lit(0))
    number = F.concat(F.lit("LANDSAT_"), F.regexp_extract("_l", r"L[A-Z]0?(\d+)_", 1))
    platform = F.coalesce(F.get_json_object("stac", "$.properties.platform"), part("_s", 1), F.when(F.col("_l") != "", number))
    level = F.coalesce(F.substring(part("_s", 2), 4, 3), part("_l", 2))
    found = found.select("scene_id", *carried, first.alias("_f"), platform.alias("platform"), level.alias("processing_level"), F.coalesce(part("_s", -1), part("_l", 3)).alias("tile_id"))
    best = F.col("_f")
    return found.select("scene_id", *carried, best["at"].alias("acquired_at"), F.coalesce(best["source"], F.lit("unknown")).alias("source"), F.coalesce(best["confidence"], F.lit(CONFIDENCE["unknown"])).alias("confidence"), "platform", "processing_level", "tile_id")


def candidates(scenes: DataFrame) -> DataFrame:
    """Groups of compatible scenes: product identity where there is one, else rounded place, and band count.

    In: scene_id, acquired_at, source, confidence, platform, processing_level, tile_id, bands, lon, lat.
    """
    has_product = F.col("platform").isNotNull()
    place = F.to_json(F.struct(F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat")))
    product = F.concat_ws("/", F.lower("platform"), F.lower(F.coalesce("processing_level", F.lit(""))), F.lower(F.coalesce("tile_id", F.lit(""))))
    key = F.concat_ws("|", F.when(has_product, product), F.when(~has_product | F.col("tile_id").isNull(), place), F.col("bands"))
    g = scenes.withColumn("candidate", key).groupBy("candidate").agg(
        F.count("*").alias("inputs"), F.count("acquired_at").alias("dated"), F.min("acquired_at").alias("first_at"), F.max("acquired_at").alias("last_at"),
        F.count_if(F.col("confidence") < 0.75).alias("low_confidence"), F.count_distinct(F.to_date("acquired_at")).alias("days"), F.min("scene_id").alias("first_scene"),
    )
    n = F.col("inputs")
    suggested = F.concat_ws(",", F.lit("max,median"), F.when(F.col("dated") > 0, "monthly,annual"), F.when(n >= 2, "moving_window,trend,seasonality,phenology"), F.when(n >= 3, "savitzky_golay"))
    return g.filter("inputs >= 2").select("*", (F.col("dated") / n).alias("coverage"), (F.col("dated") - F.col("days")).alias("duplicate_dates"), suggested.alias("suggested")).drop("days")


def compact(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def last_messages(turns: DataFrame, n: int = 6, limit: int = 280) -> DataFrame:
    """Of the last n messages of a conversation, those of user and assistant, compacted."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).filter(F.col("role").isin("user", "assistant"))
    return recent.select("conv_id", "turn", "role", compact(F.col("text"), limit).alias("snippet"))


def archive_messages(turns: DataFrame, most: int = 40, limit: int = 20_000) -> DataFrame:
    """The first messages of each conversation with a known role and some text, cut to the limit."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    kept = turns.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return kept.filter(F.col("role").isin("user", "assistant", "system", "tool") & (F.trim("text") != "")).select("conv_id", "turn", "role", F.substring("text", 1, limit).alias("content"))


def archive_summary(turns: DataFrame) -> DataFrame:
    """Title (the first user message, compacted, or a default) and number of messages of each conversation."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(F.coalesce(F.nullif(compact(first, 80), F.lit("")), F.lit("Untitled")).alias("title"), F.count("*").alias("messages"))


def safe_name(text: Column) -> Column:
    """Only letters, digits, dot, dash and underscore; others become one underscore."""
    return F.trim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get _2, _3, ... in order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n)))


def snowflake(ms: Column, machine: Column, sequence: Column) -> Column:
    """41 bits of milliseconds since the epoch below, 4 bits of machine, 6 bits of sequence."""
    return F.shiftleft(ms - F.lit(1770681600000), 10).bitwiseOR(F.shiftleft(machine, 6)).bitwiseOR(sequence)


def latest_status(events: DataFrame) -> DataFrame:
    """Current state of each task from its event log, with the number of retries."""
    return events.groupBy("task_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"), F.count_if(F.col("status") == "retrying").alias("retries"))


def apply_edits(table: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Partial update: a given (not NULL) value of an edit wins; rows without edits stay."""
    columns = [c for c in edits.columns if c != key]
    e = edits.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = table.join(e, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def new_fields(registered: DataFrame, found: DataFrame) -> DataFrame:
    """Fields of (owner, field_name, position) that are not registered yet, ordered after those that are."""
    fresh = found.join(registered, ["owner", "field_name"], "left_anti")
    last = registered.groupBy("owner").agg(F.max("position").alias("last"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy("position", "field_name"))
    return fresh.withColumn("rank", rank).join(last, "owner", "left").select("owner", "field_name", (F.coalesce("last", F.lit(0)) + F.col("rank")).alias("position"))


def spreadsheet_safe(text: Column) -> Column:
    """A quote before cells that a spreadsheet would run as a formula."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
