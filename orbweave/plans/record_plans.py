"""Queries over attribute tables, exports, metadata files, field rules, validity and product rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra as A, records as K, timeseries as TS
from ..operators.graph import stored
from ..sources import geojson
from . import views as V
from .pixel_plans import at
from .registry import register

over = V.with_views

SYSTEM = (("index_id", "Index ID", "number", "scene_id"), ("file_name", "File name", "string", "file_name"), ("bands", "Bands", "number", "bands"), ("tag_date", "Tag date", "string", "tag_date"), ("bundle_id", "Bundle ID", "string", "bundle_id"))


def attributes(s, d):
    scenes = V.scenes(s, d)
    own = K.scene_attributes(scenes, [(n, a, t, F.col(c)) for n, a, t, c in SYSTEM])
    custom = scenes.filter("tile % 5 = 0").select("scene_id", F.lit("note").alias("field_name"), F.lit("note").alias("field_alias"), F.lit("string").alias("field_type"), F.concat(F.lit("tile "), F.col("tile").cast("string")).alias("value"), F.lit("custom").alias("scope"))
    return own.unionByName(custom)


register("export_scene_attributes", attributes, over(" UNION ALL ".join(f"SELECT scene_id, '{n}' AS field_name, '{a}' AS field_alias, '{t}' AS field_type, {c}::VARCHAR AS value, 'system' AS scope FROM scenes WHERE {c} IS NOT NULL" for n, a, t, c in SYSTEM) + " UNION ALL SELECT scene_id, 'note', 'note', 'string', 'tile ' || tile, 'custom' FROM scenes WHERE tile % 5 = 0", "scenes"))
quoted = lambda s, d: V.features(s, d).select("feature_id", F.concat(F.col("name"), F.lit(', "'), F.col("category"), F.lit('"')).alias("title"), F.array("category", F.col("balance").cast("string")).alias("tags"), F.when(F.col("balance") > 0, F.col("balance")).alias("paid"))
register("export_attribute_csv", lambda s, d: quoted(s, d).select("feature_id", K.csv_line(F.col("feature_id"), F.col("title"), F.array_join("tags", "; "), F.col("paid")).alias("line")), over("SELECT feature_id, feature_id || ',' || chr(34) || name || ', ' || repeat(chr(34), 2) || category || repeat(chr(34), 3) || ',' || category || '; ' || balance || ',' || CASE WHEN balance > 0 THEN balance::VARCHAR ELSE '' END AS line FROM features", "features"))


def manifest(s, d):
    asked = V.read(s, d, "lineitem").select(F.col("l_partkey").alias("scene_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return K.manifest(asked, V.scenes(s, d).filter("bands > 1"), "scene_id")


register("export_manifest", manifest, over(", a AS (SELECT l_partkey AS scene_id, min(l_orderkey * 10 + l_linenumber) AS place, count(*) AS asked FROM lineitem GROUP BY 1) SELECT a.scene_id, place, asked, CASE WHEN s.scene_id IS NULL THEN 'missing: ' || a.scene_id END AS warning FROM a LEFT JOIN (SELECT DISTINCT scene_id FROM scenes WHERE bands > 1) s ON s.scene_id = a.scene_id", "scenes"))
register("export_vector_table", lambda s, d: K.flat_table(V.features(s, d).select("feature_id", F.col("category").alias("category name"), F.upper("category").alias("category name upper"), (F.col("balance") > 0).alias("in_credit"), F.repeat("name", F.lit(20)).alias("name"))), over("SELECT feature_id AS FEATURE_ID, category AS CATEGORY_N, upper(category) AS CATEGORY_2, (balance > 0)::INTEGER AS IN_CREDIT, substr(repeat(name, 20), 1, 254) AS NAME FROM features", "features"))


def geojson_round_trip(s, d):
    """Layer export and import: one collection for each layer, features in order of their ids."""
    path = geojson.fresh_folder(s)
    geojson.write_collections(V.features(s, d), "layer_id", path)
    read = geojson.read_geojson(s, path)
    return read.select(F.col("feature_id").cast("long").alias("feature_id"), "category", F.round(F.get_json_object("geometry", "$.coordinates[0]").cast("double"), 6).alias("lon"), F.get_json_object("properties", "$.name").alias("name"))


register("write_read_geojson", geojson_round_trip, over("SELECT feature_id, category, round(lon, 6) AS lon, name FROM features", "features"))
register("bulk_import_features", lambda s, d: V.features(s, d).withColumn("given", F.when(F.col("feature_id") % 3 == 0, F.lit("given"))).filter((F.abs("lon") <= 170) & (F.abs("lat") <= 75)).select("feature_id", F.coalesce("given", F.when(F.col("balance") > 0, F.col("category")), F.lit("default")).alias("category")), over("SELECT feature_id, CASE WHEN feature_id % 3 = 0 THEN 'given' WHEN balance > 0 THEN category ELSE 'default' END AS category FROM features WHERE abs(lon) <= 170 AND abs(lat) <= 75", "features"))


def vector_import(s, d):
    """A table from elsewhere: allowed types with a geometry, other attributes as text, category with a default."""
    t = V.features(s, d).withColumns({"kind": F.expr("case feature_id % 5 when 0 then 'Point' when 1 then 'Circle' when 2 then 'Polygon' when 3 then null else 'LineString' end"), "tags": F.array("layer_id", "balance")})
    return t.filter(F.col("kind").isin(*geojson.GEOMETRIES)).select("feature_id", "kind", F.when(F.col("balance") > 0, F.col("category")).otherwise("default").alias("category"), F.to_json("tags").alias("tags"))


register("import_vector_table", vector_import, over("SELECT feature_id, CASE feature_id % 5 WHEN 0 THEN 'Point' WHEN 2 THEN 'Polygon' ELSE 'LineString' END AS kind, CASE WHEN balance > 0 THEN category ELSE 'default' END AS category, '[' || layer_id || ',' || balance || ']' AS tags FROM features WHERE feature_id % 5 IN (0, 2, 4)", "features"))
VALID = "CASE WHEN b3 < 0.1 OR {0} = 0 OR {0} = 0.5 THEN NULL ELSE {0} END"


def scanned(s, d):
    """Bands under an explicit mask (red of 0.1 and more), a nodata value (0.5) and zero as missing."""
    return A.valid_bands(V.grid_bands(s, d), ["b1", "b2", "b4"], at.b3 >= 0.1, 0.5, True)


register("scan_pixels", lambda s, d: scanned(s, d).select("row", "col", "b1", "b2", "b4"), over("SELECT row, col, " + ", ".join(f"{VALID.format(b)} AS {b}" for b in ("b1", "b2", "b4")) + " FROM grid_bands", "grid_bands"))


def chunked(s, d):
    """Pixels as chunks of 64 x 64 cells and back."""
    cell = F.struct((F.col("row") % 64).alias("r"), (F.col("col") % 64).alias("c"), "z")
    chunks = stored(V.dem(s, d).groupBy(F.expr("row div 64").alias("br"), F.expr("col div 64").alias("bc")).agg(F.array_sort(F.collect_list(cell)).alias("cells")), "chunks")
    return chunks.select("br", "bc", F.explode("cells").alias("x")).select((F.col("br") * 64 + F.col("x.r")).alias("row"), (F.col("bc") * 64 + F.col("x.c")).alias("col"), F.col("x.z").alias("z"))


register("pixels_to_chunks_and_back", chunked, over("SELECT row, col, z FROM dem", "dem"))
register("projects_list", lambda s, d: V.read(s, d, "region").select(F.col("r_regionkey").cast("long").alias("project_id"), F.col("r_name").alias("name")), "SELECT r_regionkey::BIGINT AS project_id, r_name AS name FROM region")


def observation_order(s, d):
    scenes = V.scenes(s, d).select("scene_id", F.col("bundle_id").alias("group"), F.to_date("tag_date").alias("acquired_on"), F.col("scene_id").alias("pos"))
    return TS.ordered(scenes).select("scene_id", "group", F.col("obs").cast("int").alias("obs"))


register("ts_order", observation_order, over('SELECT scene_id, bundle_id AS "group", (row_number() OVER (PARTITION BY bundle_id ORDER BY tag_date::DATE NULLS LAST, scene_id) - 1)::INTEGER AS obs FROM scenes', "scenes"))
register("candidate_order", lambda s, d: V.scenes(s, d).groupBy("bundle_id").agg(F.count("*").alias("inputs"), F.count("tag_date").alias("dated")).orderBy(F.desc("inputs"), F.desc("dated"), "bundle_id"), over("SELECT bundle_id, count(*) AS inputs, count(tag_date) AS dated FROM scenes GROUP BY 1", "scenes"))
register("export_limit", lambda s, d: V.features(s, d).filter("layer_id = 3").orderBy("feature_id").limit(25).select("feature_id", "category"), over("SELECT feature_id, category FROM features WHERE layer_id = 3 ORDER BY feature_id LIMIT 25", "features"))
register("max_features_guard", lambda s, d: V.features(s, d).groupBy("layer_id").agg(F.count("*").alias("features")).withColumn("allowed", F.col("features") <= 60), over("SELECT layer_id, count(*) AS features, count(*) <= 60 AS allowed FROM features GROUP BY 1", "features"))
fields = lambda s, d: V.read(s, d, "part").selectExpr("p_size as owner", "p_name as field_name", "p_partkey % 7 as field_order", "p_partkey as place", "p_partkey % 5 = 0 as is_system")
FIELDS = "SELECT p_size AS owner, p_name AS field_name, p_partkey % 7 AS field_order, p_partkey AS place, p_partkey % 5 = 0 AS is_system FROM part"
register("fields_in_order", lambda s, d: K.fields_in_order(fields(s, d).dropDuplicates(["owner", "field_name"]).select("owner", "field_name").withColumn("field_order", F.length("field_name")), "owner").select("owner", "field_name", "place"), f"WITH f AS ({FIELDS}), u AS (SELECT DISTINCT owner, field_name FROM f) SELECT owner, field_name, row_number() OVER (PARTITION BY owner ORDER BY length(field_name), field_name)::INTEGER AS place FROM u")
register("field_create_guard", lambda s, d: K.accepted_fields(fields(s, d).filter("place % 4 = 0"), fields(s, d).filter("place % 4 <> 0").select("owner", "field_name", "place"), "owner").select("place", "accepted"), f"WITH f AS ({FIELDS}), n AS (SELECT *, row_number() OVER (PARTITION BY owner, field_name ORDER BY place) AS nth FROM f WHERE place % 4 <> 0) SELECT place, nth = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.place % 4 = 0 AND f.owner = n.owner AND f.field_name = n.field_name) AS accepted FROM n")
register("field_delete_guard", lambda s, d: K.removable_fields(fields(s, d)).select("place", "removable"), f"SELECT place, NOT is_system AS removable FROM ({FIELDS})")
register("sample_rows", lambda s, d: V.read(s, d, "embeddings").orderBy(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(":42")).cast("binary")), "vec_id").limit(200).select("vec_id", "label"), "SELECT vec_id, label FROM embeddings ORDER BY md5(vec_id || ':42'), vec_id LIMIT 200")
STAMP = "case scene_id % 5 when 0 then date_format(uploaded_at, 'yyyyMMdd') || 'T101112' when 1 then date_format(uploaded_at, 'yyyy-MM-dd') || 'T10:11:12Z' when 2 then date_format(uploaded_at, 'yyyy/MM/dd') when 3 then date_format(uploaded_at, 'yyyy:MM:dd') || ' 10:11:12' else 'soon' end"
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
register("parse_timestamp_utc", lambda s, d: V.scenes(s, d).select("scene_id", stamp(K.timestamp_utc(F.expr(STAMP))).alias("at")), over("SELECT scene_id, CASE WHEN scene_id % 5 = 4 THEN NULL ELSE strftime(uploaded_at, '%Y-%m-%d') || CASE WHEN scene_id % 5 = 2 THEN ' 00:00:00' ELSE ' 10:11:12' END END AS at FROM scenes", "scenes"))
MTL = "concat('GROUP = L1\\n  SPACECRAFT_ID = \"LANDSAT_', scene_id % 2 + 8, '\"\\n SENSOR_ID = \"OLI_TIRS\"\\n WRS_PATH = ', tile, '\\n WRS_ROW = 33\\n DATE_ACQUIRED = ', date_format(uploaded_at, 'yyyy-MM-dd'), '\\n SCENE_CENTER_TIME = \"10:11:12.1234560Z\"\\n LANDSAT_PRODUCT_ID = \"P', scene_id, '\"\\nno value\\nEND')"


def mtl(s, d):
    found = V.scenes(s, d).select("scene_id", *K.landsat_metadata(F.expr(MTL)))
    return found.withColumn("acquired_at", stamp("acquired_at"))


register("meta_from_mtl", mtl, over("SELECT scene_id, strftime(uploaded_at, '%Y-%m-%d') || ' 10:11:12' AS acquired_at, 'LANDSAT_' || (scene_id % 2 + 8) AS platform, 'OLI_TIRS' AS sensor, 'P' || scene_id AS product_id, lpad(tile::VARCHAR, 3, '0') || '/033' AS tile_id FROM scenes", "scenes"))
XML = "concat(if(scene_id % 10 = 3, '<!DOCTYPE x>', ''), '<n1:Root><PRODUCT_START_TIME>', date_format(uploaded_at, 'yyyy-MM-dd'), 'T10:11:12Z</PRODUCT_START_TIME><n1:Spacecraft_Name unit=\"x\"> Sentinel-2A </n1:Spacecraft_Name>', if(scene_id % 2 = 0, '<PRODUCT_URI_2A>', '<PRODUCT_URI>'), 'P', scene_id, if(scene_id % 2 = 0, '</PRODUCT_URI_2A>', '</PRODUCT_URI>'), '</n1:Root>')"


def safe(s, d):
    found = V.scenes(s, d).select("scene_id", *K.safe_metadata(F.expr(XML)))
    return found.withColumn("acquired_at", stamp("acquired_at"))


register("meta_from_safe_xml", safe, over("SELECT scene_id, CASE WHEN scene_id % 10 <> 3 THEN strftime(uploaded_at, '%Y-%m-%d') || ' 10:11:12' END AS acquired_at, CASE WHEN scene_id % 10 <> 3 THEN 'Sentinel-2A' END AS platform, CASE WHEN scene_id % 10 <> 3 THEN 'P' || scene_id END AS product_id, NULL::VARCHAR AS tile_id FROM scenes", "scenes"))
register("normalize_reflectance", lambda s, d: A.reflectance(V.read(s, d, "orders").selectExpr(f"o_orderkey div {V.GRID} as row", f"o_orderkey % {V.GRID} as col", "cast(round(o_totalprice) as long) % 9000 as dn"), "dn").select("row", "col", F.round("dn", 6).alias("dn")), "WITH x AS (SELECT o_orderkey // 128 AS row, o_orderkey % 128 AS col, round(o_totalprice)::BIGINT % 9000 AS dn FROM orders), m AS (SELECT max(dn) AS top FROM x) SELECT row, col, round(greatest(least(dn / CASE WHEN top <= 1 THEN 1.0::DOUBLE WHEN top <= 255 THEN 255.0::DOUBLE WHEN top <= 12000 THEN 10000.0::DOUBLE ELSE 65535.0::DOUBLE END, 1), 0), 6) AS dn FROM x, m")
TYPED = "case scene_id % 5 when 0 then 'true' when 1 then cast(scene_id as string) when 2 then concat('-', scene_id, '.5e3') when 3 then file_name end"
register("infer_field_type", lambda s, d: V.scenes(s, d).select("scene_id", K.infer_type(F.expr(TYPED)).alias("kind")), over("SELECT scene_id, CASE scene_id % 5 WHEN 0 THEN 'boolean' WHEN 1 THEN 'number' WHEN 2 THEN 'number' WHEN 3 THEN 'string' END AS kind FROM scenes", "scenes"))


def merged(s, d):
    old = F.to_json(F.create_map(F.lit("a"), F.col("category"), F.lit("b"), F.col("name")))
    new = F.to_json(F.create_map(F.lit("b"), F.col("balance").cast("string"), F.lit("c"), F.col("category")))
    m = K.merged_properties(old, F.when(F.col("feature_id") % 2 == 0, new))
    return V.features(s, d).select("feature_id", m.alias("m")).select("feature_id", F.array_join(F.map_keys("m"), ",").alias("keys"), F.array_join(F.map_values("m"), "|").alias("values"))


register("json_property_merge", merged, over("SELECT feature_id, CASE WHEN feature_id % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS keys, CASE WHEN feature_id % 2 = 0 THEN category || '|' || balance || '|' || category ELSE category || '|' || name END AS values FROM features", "features"))


def products(s, d):
    sensor, surface = K.product(F.concat_ws(" ", "file_name", "stac"))
    return V.scenes(s, d).select("scene_id", sensor.alias("sensor"), surface.alias("surface"))


register("detect_product", products, over("SELECT scene_id, CASE scene_id % 4 WHEN 0 THEN 'sentinel2' WHEN 1 THEN 'landsat' WHEN 2 THEN 'generic' ELSE CASE WHEN stac IS NOT NULL THEN 'sentinel2' WHEN file_name LIKE '%6s%' THEN 'gaofen' ELSE 'generic' END END AS sensor, scene_id % 4 IN (0, 1) AS surface FROM scenes", "scenes"))
register("year_label", lambda s, d: V.series(s, d).select("row", "col", "day", F.date_format("day", "yyyy").alias("label")), over("SELECT row, col, day, strftime(day, '%Y') AS label FROM series", "series"))


def enriched(s, d):
    """Scenes without a date get the one in their sidecar text, with its source."""
    known, side = F.to_date("tag_date"), F.to_date(F.substring(F.get_json_object("stac", "$.properties.datetime"), 1, 10))
    return V.scenes(s, d).select("scene_id", F.coalesce(known, side).alias("acquired_on"), F.when(known.isNotNull(), "record").when(side.isNotNull(), "sidecar").alias("source"))


register("ts_enrich_dates", enriched, over("SELECT scene_id, CASE WHEN scene_id % 8 = 3 OR scene_id % 16 = 7 THEN uploaded_at::DATE END AS acquired_on, CASE WHEN scene_id % 8 = 3 THEN 'record' WHEN scene_id % 16 = 7 THEN 'sidecar' END AS source FROM scenes", "scenes"))
LOW = "((b2 - b5) / nullif(b2 + b5, 0) > {t} AND (b4 - b3) / nullif(b4 + b3, 0) < {v} AND b4 < {n} AND b2 > b3 AND b1 < b2) OR ((b2 - b5) / nullif(b2 + b5, 0) > -0.1 AND b4 < 0.05 AND b5 < 0.05)"
for mode, (most_ndvi, most_nir) in A.WATER_MODES.items():
    register(f"extract_water_jrc_{mode}", lambda s, d, m=mode: V.grid_bands(s, d).select("row", "col", A.water_rules(at.b1, at.b2, at.b3, at.b4, at.b5, 0.0, m).alias("mask")), over(f"SELECT row, col, coalesce(({LOW.format(t=0.0, v=most_ndvi, n=most_nir)})::INTEGER, 0) AS mask FROM grid_bands", "grid_bands"))
