"""Graphs as tables of links: components by star rounds, order numbers without a global window, rings by pointer jumping.

Every round ends in files of the shared folder. Defined cases: links with a null end are left out; a link of a node with itself
makes the node known; repeated links count once; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without one, a folder of this process, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all hosts share")
    return (found or _own_folder()).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that all hosts share and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lowest_label(links: DataFrame) -> DataFrame:
    """(node, label) of every end of links(a, b): the smallest node of its component, by large-star and small-star rounds.

    In a round every node ties its larger neighbours, then its smaller ones, to the smallest it knows. Smallest neighbours
    come from partial aggregates that are joined back, so a node with very many links is never gathered.
    """
    links = links.filter("a is not null and b is not null")
    stars = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    while True:
        down = stars.groupBy("u").agg(F.count("*").alias("n"))
        # Done when every node that points down does so once, at a node that points nowhere.
        if stars.join(down, "u").join(stars.select(F.col("u").alias("v"), F.lit(True).alias("moves")).distinct(), "v", "left").filter("n > 1 or moves").isEmpty():
            break
        ends = stars.union(stars.select("v", "u")).toDF("u", "v")
        least = ends.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = ends.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    alone = links.select(F.explode(F.array("a", "b")).alias("u")).distinct().join(stars, "u", "left_anti")
    return stars.toDF("node", "label").union(alone.select("u", F.col("u").alias("label")))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with 1, 2, 3, ... in `name` by rising order (values differ): ranges are numbered by themselves, then moved by what is before."""
    dealt = stored(df.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").count()  # one row for each range
    before = sizes.select(F.col("range").alias("of"), (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return dealt.withColumn(name, inside).join(before, F.col("range") == F.col("of")).withColumn(name, (F.col(name) + F.col("before")).cast("long")).drop("range", "of", "before")


def rings(chains: DataFrame) -> DataFrame:
    """(id, ring, place) of every row of chains(id, next), which are rings: the ring's smallest id, and the place from it on.

    Both come from jumps of doubling length, so a ring of n chains takes log2(n) rounds.
    """
    state = stored(chains.select("id", F.col("next").alias("to"), F.col("id").alias("low")), "rings")
    while True:
        onward = state.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("low").alias("low_far"))
        state = stored(state.join(onward, "to").select("id", F.col("far").alias("to"), F.least("low", "low_far").alias("low"), (F.col("low_far") < F.col("low")).alias("moved")), "rings")
        if state.filter("moved").isEmpty():
            break
    low = state.select("id", "low")
    # Cut before the smallest id, and count the jumps to the cut.
    state = chains.join(low, "id").select("id", F.when(F.col("next") != F.col("low"), F.col("next")).alias("to"), F.when(F.col("next") != F.col("low"), 1).otherwise(0).cast("long").alias("left"))
    state = stored(state, "rings")
    while not state.filter("to is not null").isEmpty():
        onward = state.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
        state = stored(state.join(onward, "to", "left").select("id", F.col("far").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "rings")
    return state.join(low, "id").select("id", F.col("low").alias("ring"), (-F.col("left")).alias("place"))
