"""Attribute tables, exports, field rules and metadata files of the catalogue, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Field names of a vector export have so many characters, texts so many.
NAME_LENGTH, TEXT_LENGTH = 10, 254
#: Marks of sensors in paths and tags, the first group that occurs decides (fixed values).
SENSORS = {
    "landsat": ("landsat", "lc08", "lc09", "le07", "lt05", "sr_b"),
    "sentinel2": ("sentinel-2", "sentinel2", "s2a", "s2b", "msil2a", "sen2cor"),
    "modis": ("mod09", "myd09", "mcd43", "modis"),
    "gaofen": ("gaofen", "gf1", "gf2", "gf6", "flaash", "quac", "6s"),
}
#: Marks of surface reflectance for each sensor (fixed values).
SURFACE = {
    "landsat": ("lasrc", "ledaps", "level-2", "level2", "l2sp", "sr_b"),
    "sentinel2": ("l2a", "msil2a", "sen2cor", "scl"),
    "modis": ("mod09", "myd09", "mcd43", "surface reflectance"),
    "gaofen": ("flaash", "quac", "6s", "surface reflectance", "sr"),
}
#: Timestamp formats after ISO (fixed values).
STAMPS = ("yyyyMMdd'T'HHmmss", "yyyyMMddHHmmss", "yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy:MM:dd HH:mm:ss")


def scene_attributes(scenes: DataFrame, system: list[tuple[str, str, str, Column]], key: str = "scene_id") -> DataFrame:
    """Long attribute table: (key, field_name, field_alias, field_type, value, scope), empty values left out."""
    rows = F.array(*(F.struct(F.lit(n).alias("field_name"), F.lit(a).alias("field_alias"), F.lit(t).alias("field_type"), v.cast("string").alias("value")) for n, a, t, v in system))
    return scenes.select(key, F.explode(rows).alias("r")).select(key, "r.*", F.lit("system").alias("scope")).filter("value is not null and value <> ''")


def csv_cell(value: Column) -> Column:
    """A cell, quoted where it holds a comma, a quote or a line end."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *(csv_cell(v) for v in values))


def manifest(requested: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Each requested id once, in order of its first place, with a warning where the catalogue lacks it."""
    first = requested.groupBy(key).agg(F.min("place").alias("place"), F.count("*").alias("asked"))
    known = catalogue.select(key, F.lit(True).alias("known")).distinct()
    return first.join(known, key, "left").select(key, "place", "asked", F.when(F.col("known").isNull(), F.concat(F.lit("missing: "), F.col(key).cast("string"))).alias("warning"))


def short_names(names: list[str]) -> dict[str, str]:
    """Upper-case export names of at most NAME_LENGTH characters, numbered where they would meet."""
    out: dict[str, str] = {}
    for name in names:
        base = "".join(x if x.isascii() and x.isalnum() else "_" for x in name).upper().strip("_") or "FIELD"
        made, n = base[:NAME_LENGTH], 1
        while made in out.values():
            n += 1
            made = f"{base[: NAME_LENGTH - len(str(n))]}{n}"
        out[name] = made
    return out


def flat_table(features: DataFrame) -> DataFrame:
    """Features as an export table: short names, texts cut, booleans as 0 or 1, all else as it is."""
    kinds, names = dict(features.dtypes), short_names(features.columns)
    column = {"string": lambda c: F.substring(c, 1, TEXT_LENGTH), "boolean": lambda c: F.col(c).cast("int")}
    return features.select(*(column.get(kinds[c], F.col)(c).alias(n) for c, n in names.items()))


def fields_in_order(fields: DataFrame, owner: str) -> DataFrame:
    place = Window.partitionBy(owner).orderBy("field_order", "field_name")
    return fields.withColumn("place", F.row_number().over(place))


def accepted_fields(existing: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """New fields with a verdict: a name exists once per owner, the first of equal new ones counts."""
    first = F.row_number().over(Window.partitionBy(owner, "field_name").orderBy("place"))
    known = existing.select(owner, "field_name", F.lit(True).alias("known")).distinct()
    return new.withColumn("nth", first).join(known, [owner, "field_name"], "left").withColumn("accepted", F.col("known").isNull() & (F.col("nth") == 1)).drop("known", "nth")


def removable_fields(fields: DataFrame) -> DataFrame:
    """Fields with whether they may go: system fields stay."""
    return fields.withColumn("removable", ~F.coalesce(F.col("is_system"), F.lit(False)))


def infer_type(value: Column) -> Column:
    """Field type of a JSON value's text: boolean, number or string."""
    text = F.trim(value)
    return F.when(text.isNull(), None).when(text.isin("true", "false"), "boolean").when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").otherwise("string")


def merged_properties(old: Column, new: Column) -> Column:
    """JSON objects of text values merged key by key, the new value wins; keys in order of their names."""
    kind = "map<string,string>"
    had, now = (F.coalesce(F.from_json(x, kind), F.create_map().cast(kind)) for x in (old, new))
    both = F.map_concat(F.map_filter(had, lambda k, _: ~F.map_contains_key(now, k)), now)
    return F.map_from_entries(F.array_sort(F.map_entries(both)))


def timestamp_utc(text: Column) -> Column:
    """ISO or one of STAMPS, without a zone as UTC (the session's zone must be UTC); NULL where none reads the whole text."""
    clean = F.trim(text)
    return F.coalesce(*(F.try_to_timestamp(clean, F.lit(f)) for f in STAMPS), F.try_to_timestamp(clean))


def key_values(text: Column) -> Column:
    """Map of the KEY = VALUE lines of a text: keys without underscores, values without quotes; the last of equal keys counts."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*[A-Z0-9_]+\s*=\s*.*$"))
    entry = lambda x: F.struct(F.replace(F.regexp_extract(x, r"^\s*([A-Z0-9_]+)", 1), F.lit("_"), F.lit("")).alias("k"), F.regexp_replace(F.regexp_extract(x, r"=\s*(.*?)\s*$", 1), '^["\' ]+|["\' ]+$', "").alias("v"))
    merge = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"])))
    return F.aggregate(F.transform(lines, entry), F.create_map().cast("map<string,string>"), merge)


def landsat_metadata(text: Column) -> list[Column]:
    """acquired_at, platform, sensor, product_id, tile_id of a Landsat MTL text."""
    m = key_values(text)
    stamp = F.try_to_timestamp(F.concat_ws(" ", m["DATEACQUIRED"], F.substring(F.coalesce(m["SCENECENTERTIME"], F.lit("00:00:00")), 1, 8)))
    path_row = F.concat_ws("/", F.lpad(m["WRSPATH"], 3, "0"), F.lpad(m["WRSROW"], 3, "0"))
    return [stamp.alias("acquired_at"), m["SPACECRAFTID"].alias("platform"), m["SENSORID"].alias("sensor"), F.coalesce(m["LANDSATPRODUCTID"], m["LANDSATSCENEID"]).alias("product_id"), F.when(m["WRSPATH"].isNotNull() & m["WRSROW"].isNotNull(), path_row).alias("tile_id")]


def safe_metadata(text: Column) -> list[Column]:
    """acquired_at, platform, product_id, tile_id of a SAFE XML text; NULL for texts that declare a DTD or an entity."""
    safe = F.when(~F.upper(text).contains("<!DOCTYPE") & ~F.upper(text).contains("<!ENTITY"), text)

    def tag(*names: str) -> Column:
        found = (F.regexp_extract(safe, rf"(?i)<(?:[a-z0-9_.-]+:)?{n}(?:\s[^>]*)?>\s*([^<]+?)\s*</", 1) for n in names)
        return F.coalesce(*(F.nullif(x, F.lit("")) for x in found))

    stamp = timestamp_utc(tag("PRODUCT_START_TIME", "DATATAKE_SENSING_START", "SENSING_TIME"))
    return [stamp.alias("acquired_at"), tag("SPACECRAFT_NAME").alias("platform"), tag("PRODUCT_URI", "PRODUCT_URI_1C", "PRODUCT_URI_2A").alias("product_id"), tag("TILE_ID").alias("tile_id")]


def product(text: Column) -> tuple[Column, Column]:
    """(sensor, surface reflectance) by the marks in a path with its tags."""
    low = F.lower(text)
    holds = lambda marks: low.rlike("|".join(re.escape(m) for m in marks))
    found = F.coalesce(*(F.when(holds(marks), F.struct(F.lit(n).alias("n"), holds(SURFACE[n]).alias("surface"))) for n, marks in SENSORS.items()), F.struct(F.lit("generic").alias("n"), F.lit(False).alias("surface")))
    return found["n"], found["surface"] | F.coalesce(low.contains("reflectance"), F.lit(False))
