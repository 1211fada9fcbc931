"""Earth-observation inputs derived from the given tables, by the same integer arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Columns of the arithmetic grid.
GRID = 128
BANDS = ("b1", "b2", "b3", "b4", "b5", "b6")  # blue, green, red, nir, swir1, swir2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bands(items: DataFrame) -> DataFrame:
    sums = items.groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("s1"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long") % 10000).alias("s2"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("s3"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("s4"),
        F.count("*").alias("s5"),
        F.sum(F.col("l_linenumber").cast("long")).alias("s6"),
    )
    return sums.selectExpr(
        f"l_orderkey div {GRID} as row", f"l_orderkey % {GRID} as col",
        "(s1 * 37 % 997) / 1000D as b1", "(s2 % 1000) / 1000D as b2", "(s3 * 97 % 991) / 1000D as b3", "(s4 * 89 % 983) / 1000D as b4",
        "((s5 * 211 + s6 * 17) % 977) / 1000D as b5", "(s6 * 131 % 971) / 1000D as b6",
    )


def grid_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six reflectance bands of one scene, a pixel for each order; orders without items are invalid pixels."""
    return _bands(read(spark, sf_dir, "lineitem"))


def grid_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(read(spark, sf_dir, "lineitem").filter("l_linenumber <= 3"))


def grid_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(read(spark, sf_dir, "lineitem").filter("l_linenumber > 3"))


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation z of a grid with a pixel for each order."""
    return read(spark, sf_dir, "orders").selectExpr(f"o_orderkey div {GRID} as row", f"o_orderkey % {GRID} as col", "cast(round(o_totalprice) as long) % 1000 / 1D as z")


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the order grid."""
    return (dem(spark, sf_dir).agg(F.max("row")).first()[0] or 0) + 1


def scene_height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the grid that holds all orders and the orders of all items."""
    return max(height(spark, sf_dir), (read(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0) // GRID + 1)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean value of each pixel: a pixel for each user, an observation for each day."""
    e = read(spark, sf_dir, "events").selectExpr("user_id div 16 as row", "user_id % 16 as col", "to_date(ts) as day", "cast(round(value * 100) as long) as v")
    return e.groupBy("row", "col", "day").agg((F.sum("v") / F.count("*") / 100).alias("value"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point features of customers: layer, category, properties, lon, lat by modular arithmetic."""
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey as feature_id", "cast(c_nationkey as long) as layer_id", "c_mktsegment as category",
        "(c_custkey * 7919 % 36000) / 100D - 180 as lon", "(c_custkey * 104729 % 16000) / 100D - 80 as lat", "cast(round(c_acctbal) as long) as balance", "c_name as name",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box zones of suppliers on the pixel grid."""
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey as zone_id", "s_suppkey * 31 % 100 as r0", "s_suppkey * 17 % 112 as c0", "s_suppkey % 9 + 2 as h", "s_suppkey % 7 + 3 as w")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue: file names in four styles, tags, sidecar texts and footprints."""
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey as scene_id", "o_orderdate as t", "o_custkey % 50 as tile", "o_orderkey % 4 as style", "o_custkey")
    return o.selectExpr(
        "scene_id", "t as uploaded_at", "tile",
        "case style when 0 then concat('S2A_MSIL2A_', date_format(t, 'yyyyMMdd'), 'T', date_format(t, 'HHmmss'), '_N0510_R018_T', lpad(tile, 2, '0'), 'QGE_x.tif')"
        " when 1 then concat('LC09_L2SP_', lpad(tile, 3, '0'), '040_', date_format(t, 'yyyyMMdd'), '_20240101_02_T1.tif')"
        " when 2 then concat('scene-', date_format(t, 'yyyy-MM-dd'), '.tif') else concat('arbitrary-', scene_id, '.tif') end as file_name",
        "case when scene_id % 8 = 3 then date_format(t, 'yyyy-MM-dd') end as tag_date", "case when scene_id % 16 = 7 then concat('{\"properties\":{\"datetime\":\"', date_format(t, 'yyyy-MM-dd'), 'T10:11:12Z\",\"platform\":\"S2B\"}}') end as stac",
        "(o_custkey * 13 % 300) / 10D as lon", "(o_custkey * 29 % 200) / 10D as lat", "cast(scene_id % 5 + 1 as int) as bands", "concat('bundle-', o_custkey % 97) as bundle_id",
    )


_BAND_SQL = """SELECT l_orderkey // 128 AS row, l_orderkey % 128 AS col,
 (s1 * 37 % 997) / 1000.0::DOUBLE AS b1, (s2 % 1000) / 1000.0::DOUBLE AS b2, (s3 * 97 % 991) / 1000.0::DOUBLE AS b3, (s4 * 89 % 983) / 1000.0::DOUBLE AS b4,
 ((s5 * 211 + s6 * 17) % 977) / 1000.0::DOUBLE AS b5, (s6 * 131 % 971) / 1000.0::DOUBLE AS b6
 FROM (SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS s1, sum(round(l_extendedprice * 100)::BIGINT % 10000)::BIGINT AS s2, sum(round(l_discount * 100)::BIGINT)::BIGINT AS s3,
 sum(round(l_tax * 100)::BIGINT)::BIGINT AS s4, count(*) AS s5, sum(l_linenumber)::BIGINT AS s6 FROM lineitem {where} GROUP BY l_orderkey)"""

VIEW_SQL = {
    "grid_bands": _BAND_SQL.format(where=""),
    "grid_t1": _BAND_SQL.format(where="WHERE l_linenumber <= 3"),
    "grid_t2": _BAND_SQL.format(where="WHERE l_linenumber > 3"),
    "dem": "SELECT o_orderkey // 128 AS row, o_orderkey % 128 AS col, (round(o_totalprice)::BIGINT % 1000)::DOUBLE AS z FROM orders",
    "series": "SELECT row, col, day, sum(v)::DOUBLE / count(*) / 100 AS value FROM (SELECT user_id // 16 AS row, user_id % 16 AS col, ts::DATE AS day, round(value * 100)::BIGINT AS v FROM events) GROUP BY row, col, day",
    "features": "SELECT c_custkey AS feature_id, c_nationkey::BIGINT AS layer_id, c_mktsegment AS category, (c_custkey * 7919 % 36000) / 100.0::DOUBLE - 180 AS lon, (c_custkey * 104729 % 16000) / 100.0::DOUBLE - 80 AS lat, round(c_acctbal)::BIGINT AS balance, c_name AS name FROM customer",
    "boxes": "SELECT s_suppkey AS zone_id, s_suppkey * 31 % 100 AS r0, s_suppkey * 17 % 112 AS c0, s_suppkey % 9 + 2 AS h, s_suppkey % 7 + 3 AS w FROM supplier",
    "scenes": """SELECT scene_id, t AS uploaded_at, tile,
 CASE style WHEN 0 THEN 'S2A_MSIL2A_' || strftime(t, '%Y%m%d') || 'T' || strftime(t, '%H%M%S') || '_N0510_R018_T' || lpad(tile::VARCHAR, 2, '0') || 'QGE_x.tif'
 WHEN 1 THEN 'LC09_L2SP_' || lpad(tile::VARCHAR, 3, '0') || '040_' || strftime(t, '%Y%m%d') || '_20240101_02_T1.tif'
 WHEN 2 THEN 'scene-' || strftime(t, '%Y-%m-%d') || '.tif' ELSE 'arbitrary-' || scene_id || '.tif' END AS file_name,
 CASE WHEN scene_id % 8 = 3 THEN strftime(t, '%Y-%m-%d') END AS tag_date, CASE WHEN scene_id % 16 = 7 THEN '{"properties":{"datetime":"' || strftime(t, '%Y-%m-%d') || 'T10:11:12Z","platform":"S2B"}}' END AS stac,
 (o_custkey * 13 % 300) / 10.0::DOUBLE AS lon, (o_custkey * 29 % 200) / 10.0::DOUBLE AS lat, (scene_id % 5 + 1)::INTEGER AS bands, 'bundle-' || (o_custkey % 97) AS bundle_id
 FROM (SELECT o_orderkey AS scene_id, o_orderdate AS t, o_custkey % 50 AS tile, o_orderkey % 4 AS style, o_custkey FROM orders)""",
}


def with_views(body: str, *names: str) -> str:
    """The SQL over these views, as common table expressions."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names) + " " + body
