"""GeoJSON in and out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import shared_folder
from ..operators.vector import feature_geojson

GEOMETRIES = ("Point", "LineString", "Polygon", "MultiPolygon", "MultiLineString")


#: Feature ids of one collection.
COLLECTION_IDS = 10_000


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of collections or single features (one JSON document per line): feature_id, geometry (JSON), category, properties (JSON).

    Geometry types outside the allowed ones and features without geometry are dropped.
    """
    raw = spark.read.text(path)
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    single = F.when(F.get_json_object("value", "$.type") == "Feature", F.array("value"))
    rows = raw.select(F.explode(F.coalesce(features, single)).alias("f"))
    field = lambda p: F.get_json_object("f", p)
    out = rows.select(field("$.id").alias("feature_id"), field("$.geometry").alias("geometry"), F.coalesce(field("$.category"), field("$.properties.category"), F.lit("default")).alias("category"), field("$.properties").alias("properties"))
    return out.filter(F.get_json_object("geometry", "$.type").isin(*GEOMETRIES))


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name in the storage that all hosts share."""
    return f"{shared_folder(spark)}/geojson-{uuid.uuid4().hex[:12]}"


def write_geojson(features: DataFrame, column: str, path: str) -> None:
    """One Feature per line (GeoJSON text sequence without separators), written in parallel."""
    features.select(F.col(column).alias("value")).write.text(path)


def write_collections(features: DataFrame, layer: str, path: str) -> None:
    """One FeatureCollection for each layer and block of feature ids, with its metadata: features in order of their ids.

    A layer of any size is many collections, so none is gathered whole.
    """
    block = F.floor(F.col("feature_id") / COLLECTION_IDS)
    made = features.groupBy(layer, block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("feature_id", feature_geojson().alias("json")))).alias("f"))
    body = F.concat(F.lit('{"type":"FeatureCollection","metadata":{"layer_id":'), F.col(layer).cast("string"), F.lit(',"feature_count":'), F.size("f").cast("string"), F.lit('},"features":['), F.array_join(F.transform("f", lambda x: x["json"]), ","), F.lit("]}"))
    made.select(body.alias("value")).write.text(path)
