"""Streaming arrival of scenes and observations, stored as keyed logs.

A keyed log is a folder with one part for each batch of a stream. A batch writes its own part, overwriting what an earlier
try of the same batch left, so it counts once however often it runs; a part holds the newest row of each key. Readers take the newest
row of a key over all parts: arrivals replace earlier ones without rewriting the table. `compacted` folds the parts into one.

Defined cases: rows without a key are left out; of rows of one key the largest order wins, a null order being the smallest;
equal orders go to the later batch, then to the larger row, column by column; an empty stream leaves no parts, and reading a log without parts
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.catalog import metadata


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the one with the largest order; summed up map-side."""
    rest = [c for c in rows.columns if c not in {*key, *order}]
    known = rows.filter(" and ".join(f"{k} is not null" for k in key))
    return known.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("best")).select(*key, *(F.col("best")[c].alias(c) for c in (*order, *rest))).select(*rows.columns)


def store_batch(rows: DataFrame, log: str, number: int, key: list[str], order: list[str]) -> None:
    """The part of one batch; running a batch again writes the same part."""
    newest(rows, key, order).write.mode("overwrite").parquet(f"{log}/batch={number}")


def current(spark: SparkSession, log: str, schema: StructType, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key of a log."""
    parts = StructType([*schema.fields, StructField("batch", LongType())])
    return newest(spark.read.option("ignoreMissingFiles", True).schema(parts).parquet(log), key, [*order, "batch"]).drop("batch")


def compacted(spark: SparkSession, log: str, schema: StructType, key: list[str], order: list[str], to: str) -> None:
    """The log's rows as one part of a new log; a stream that goes on there numbers its batches above 0."""
    store_batch(current(spark, log, schema, key, order), to, 0, key, order)


SCENE_KEY, SCENE_ORDER, CARRIED = ["scene_id"], ["uploaded_at"], ("uploaded_at", "file_name", "bands")


def scene_rows(arrived: DataFrame) -> DataFrame:
    return metadata(arrived, *CARRIED)


def stream_ingest_scenes(spark: SparkSession, incoming: str, schema: StructType | str, log: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Parquet files that land in a folder, with their metadata resolved, into a keyed log by scene."""
    arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(incoming)

    def store(batch: DataFrame, number: int) -> None:
        store_batch(scene_rows(batch), log, number, SCENE_KEY, SCENE_ORDER)

    return arrived.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PERIOD = "31 days"
COMPOSITE = "row long, col long, period timestamp, total double, seen long"


def composites(observed: DataFrame, lateness: str) -> DataFrame:
    """Sum and count of each pixel and period over a stream; what is later than the watermark allows is dropped."""
    marked = observed.withWatermark("ts", lateness)
    sums = marked.groupBy("row", "col", F.window("ts", PERIOD).alias("w")).agg(F.sum("value").alias("total"), F.count("value").alias("seen"))
    return sums.select("row", "col", F.col("w.start").alias("period"), "total", "seen")


def stream_composites(observed: DataFrame, log: str, checkpoint: str, lateness: str = "30 days") -> StreamingQuery:
    """Composites of a stream of (row, col, ts, value) into a keyed log: a period's row is replaced while observations still arrive."""

    def store(batch: DataFrame, number: int) -> None:
        store_batch(batch, log, number, ["row", "col", "period"], ["seen"])

    return composites(observed, lateness).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
