"""Streams: scenes that come again, batches that run again, observations that come late."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orbweave.streaming import ingest as I

SCHEMA = "scene_id long, uploaded_at timestamp, file_name string, tag_date string, stac string, bands int"
DAY = lambda n: dt.datetime(2024, 1, n)


def catalogue(spark, log):
    return {r.scene_id: r for r in I.current(spark, log, I.scene_rows(spark.createDataFrame([], SCHEMA)).schema, I.SCENE_KEY, I.SCENE_ORDER).collect()}


def test_scenes_that_come_again_count_once(spark, tmp_path):
    at = str(tmp_path)
    land = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/incoming")
    run = lambda: I.stream_ingest_scenes(spark, f"{at}/incoming", SCHEMA, f"{at}/log", f"{at}/checkpoint").awaitTermination()
    land([(1, DAY(1), "scene-2024-01-01.tif", None, None, 3), (1, DAY(3), "scene-2024-01-03.tif", None, None, 4), (2, DAY(2), "b.tif", "2024-02-02", None, 1), (None, DAY(2), "c.tif", None, None, 1), (3, None, "d.tif", None, None, 1)])
    run()
    got = catalogue(spark, f"{at}/log")
    assert got.keys() == {1, 2, 3} and (got[1].bands, got[1].file_name, str(got[1].acquired_at)) == (4, "scene-2024-01-03.tif", "2024-01-03 00:00:00")
    assert (got[2].source, got[3].source, got[3].acquired_at) == ("raster_tag", "unknown", None)
    run()  # nothing new
    land([(1, DAY(2), "late.tif", None, None, 9), (2, DAY(2), "same-time.tif", None, None, 8), (3, DAY(5), "e.tif", None, None, 7)])
    run()
    got = catalogue(spark, f"{at}/log")
    assert {i: r.bands for i, r in got.items()} == {1: 4, 2: 8, 3: 7}
    # A batch that runs again leaves the same part.
    again = spark.createDataFrame([(1, DAY(2), "late.tif", None, None, 9), (3, DAY(5), "e.tif", None, None, 7), (2, DAY(2), "same-time.tif", None, None, 8)], SCHEMA)
    I.store_batch(I.scene_rows(again), f"{at}/log", 1, I.SCENE_KEY, I.SCENE_ORDER)
    assert catalogue(spark, f"{at}/log") == got
    schema = I.scene_rows(again).schema
    I.compacted(spark, f"{at}/log", schema, I.SCENE_KEY, I.SCENE_ORDER, f"{at}/small")
    assert catalogue(spark, f"{at}/small") == got


def test_composites_of_late_rows(spark, tmp_path):
    at = str(tmp_path)
    schema = "row long, col long, ts timestamp, value double"
    base = dt.datetime(2024, 3, 1)
    land = lambda rows: spark.createDataFrame([(0, 0, base + dt.timedelta(days=d), v) for d, v in rows], schema).coalesce(1).write.mode("append").parquet(f"{at}/incoming")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/incoming")
        I.stream_composites(stream, f"{at}/log", f"{at}/checkpoint", "40 days").awaitTermination()

    land([(0, 1.0), (1, 3.0), (1, None)])
    run()
    land([(100, 5.0), (2, 7.0)])  # the second is late, and allowed: the watermark was at 1 - 40 days
    run()
    land([(101, 5.0), (3, 100.0)])  # the watermark is at 60 days now
    run()
    found = I.current(spark, f"{at}/log", StructType.fromDDL(I.COMPOSITE), ["row", "col", "period"], ["seen"])
    sums = sorted((r.seen, r.total) for r in found.collect())
    assert sums == [(2, 10.0), (3, 11.0)]
    assert found.filter(F.col("row").isNull()).count() == 0
