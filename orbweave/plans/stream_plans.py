"""Queries over streams: files that arrive in batches, with scenes that come again and observations that come late."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..operators.graph import shared_folder
from ..streaming import ingest as I
from . import views as V
from .catalog_plans import META
from .pixel_plans import texts
from .registry import register


def folder(spark, name):
    return f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"


def ingested(s, d):
    """All scenes arrive, every third again a day later under another name; the stream stops between and starts anew."""
    at, first = folder(s, "scenes"), V.scenes(s, d).select("scene_id", "uploaded_at", "file_name", "tag_date", "stac", "bands")
    again = first.filter("scene_id % 3 = 0").withColumns({"uploaded_at": F.expr("uploaded_at + interval 1 day"), "file_name": F.concat(F.lit("scene-"), F.date_format("uploaded_at", "yyyy-MM-dd"), F.lit("-again.tif"))})
    for arrived in (first, again):
        arrived.write.mode("append").parquet(f"{at}/incoming")
        I.stream_ingest_scenes(s, f"{at}/incoming", first.schema, f"{at}/log", f"{at}/checkpoint", 2).awaitTermination()
    return I.current(s, f"{at}/log", I.scene_rows(first).schema, I.SCENE_KEY, I.SCENE_ORDER)


NOW = """again AS (SELECT * REPLACE (uploaded_at + INTERVAL 1 DAY AS uploaded_at, 'scene-' || strftime(uploaded_at, '%Y-%m-%d') || '-again.tif' AS file_name) FROM scenes WHERE scene_id % 3 = 0),
 now AS (SELECT * FROM again UNION ALL SELECT * FROM scenes WHERE scene_id % 3 <> 0)"""
register("stream_ingest_scenes", lambda s, d: texts(ingested(s, d), "uploaded_at", "acquired_at"), V.with_views(f""", {NOW}, m AS ({META.replace('FROM scenes)', 'FROM now)')})
 SELECT scene_id, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at, file_name, now.bands, strftime(acquired_at, '%Y-%m-%d %H:%M:%S') AS acquired_at, source, confidence, platform, processing_level, tile_id FROM m JOIN now USING (scene_id)""", "scenes"))


def observed(s, d) -> DataFrame:
    e = V.read(s, d, "events").selectExpr("event_id", "user_id div 16 as row", "user_id % 16 as col", "cast(ts as timestamp) as ts", "round(value * 100) / 100 as value")
    return e.repartitionByRange(3, "event_id").drop("event_id")


def composites(s, d):
    """Events land in three files; all are within the watermark, so a period ends with every one of its observations."""
    at = folder(s, "events")
    rows = observed(s, d)
    rows.write.parquet(f"{at}/incoming")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/incoming")
    I.stream_composites(stream, f"{at}/log", f"{at}/checkpoint", "3650 days").awaitTermination()
    found = I.current(s, f"{at}/log", StructType.fromDDL(I.COMPOSITE), ["row", "col", "period"], ["seen"])
    return texts(found.select("row", "col", "period", "seen", F.round(F.col("total") / F.col("seen") + 3e-8, 6).alias("mean")), "period")


register("stream_monthly_composite", composites, "SELECT user_id // 16 AS row, user_id % 16 AS col, strftime(make_timestamp(floor(epoch(ts))::BIGINT // 2678400 * 2678400 * 1000000), '%Y-%m-%d %H:%M:%S') AS period, count(value) AS seen, round(sum(round(value * 100) / 100) / count(value) + 3e-8, 6) AS mean FROM events GROUP BY 1, 2, 3")
