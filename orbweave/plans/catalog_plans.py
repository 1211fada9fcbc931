"""Queries over the catalogue, jobs and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from . import views as V
from .pixel_plans import texts
from .registry import register

scenes = V.scenes


def over(body: str) -> str:
    return V.with_views(body, "scenes")


register("scan_scenes", lambda s, d: texts(scenes(s, d).select("scene_id", "file_name", "uploaded_at", "bands"), "uploaded_at"), over("SELECT scene_id, file_name, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at, bands FROM scenes"))
register("scene_by_id", lambda s, d: scenes(s, d).filter("scene_id = 42").select("scene_id", "file_name"), over("SELECT scene_id, file_name FROM scenes WHERE scene_id = 42"))
register("scenes_by_bundle", lambda s, d: scenes(s, d).filter("bundle_id = 'bundle-5'").select("scene_id", "bundle_id"), over("SELECT scene_id, bundle_id FROM scenes WHERE bundle_id = 'bundle-5'"))
register("newest_scenes", lambda s, d: texts(scenes(s, d).orderBy(F.desc("uploaded_at"), "scene_id").limit(25).select("scene_id", "uploaded_at"), "uploaded_at"), over("SELECT scene_id, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at FROM scenes ORDER BY scenes.uploaded_at DESC, scene_id LIMIT 25"))
META = r"""SELECT scene_id, bands, lon, lat, coalesce(st, tg, se, la, ge) AS acquired_at,
 CASE WHEN st IS NOT NULL THEN 'stac' WHEN tg IS NOT NULL THEN 'raster_tag' WHEN se IS NOT NULL THEN 'sentinel_filename' WHEN la IS NOT NULL THEN 'landsat_filename' WHEN ge IS NOT NULL THEN 'filename' ELSE 'unknown' END AS source,
 CASE WHEN st IS NOT NULL THEN 1.0 WHEN tg IS NOT NULL THEN 0.92 WHEN se IS NOT NULL OR la IS NOT NULL THEN 0.9 WHEN ge IS NOT NULL THEN 0.55 ELSE 0.0 END::DOUBLE AS confidence,
 CASE WHEN st IS NOT NULL THEN 'S2B' WHEN se IS NOT NULL THEN 'S2A' WHEN la IS NOT NULL THEN 'LANDSAT_9' END AS platform,
 CASE WHEN se IS NOT NULL THEN 'L2A' WHEN la IS NOT NULL THEN 'L2SP' END AS processing_level,
 CASE WHEN se IS NOT NULL THEN 'T' || lpad(tile::VARCHAR, 2, '0') || 'QGE' WHEN la IS NOT NULL THEN lpad(tile::VARCHAR, 3, '0') || '040' END AS tile_id
 FROM (SELECT *, try_strptime(substr(stac, position('datetime' IN stac) + 11, 19), '%Y-%m-%dT%H:%M:%S') AS st, try_strptime(tag_date, '%Y-%m-%d') AS tg,
  CASE WHEN file_name LIKE 'S2A%' THEN strptime(substr(file_name, 12, 15), '%Y%m%dT%H%M%S') END AS se, CASE WHEN file_name LIKE 'LC09%' THEN strptime(substr(file_name, 18, 8), '%Y%m%d') END AS la,
  CASE WHEN file_name LIKE 'scene-%' THEN strptime(substr(file_name, 7, 10), '%Y-%m-%d') END AS ge FROM scenes)"""
register("temporal_metadata_resolve", lambda s, d: texts(C.metadata(scenes(s, d)), "acquired_at"), over(f", m AS ({META}) SELECT scene_id, strftime(acquired_at, '%Y-%m-%d %H:%M:%S') AS acquired_at, source, confidence, platform, processing_level, tile_id FROM m"))
register("meta_from_filename", lambda s, d: C.metadata(scenes(s, d).withColumns({"stac": F.lit(None).cast("string"), "tag_date": F.lit(None).cast("string")})).select("scene_id", "source", F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss").alias("acquired_at")), over(f", m AS ({META.replace('FROM scenes)', 'FROM (SELECT * REPLACE (NULL::VARCHAR AS stac, NULL::VARCHAR AS tag_date) FROM scenes))')}) SELECT scene_id, source, strftime(acquired_at, '%Y-%m-%d %H:%M:%S') AS acquired_at FROM m"))
register("meta_from_stac", lambda s, d: scenes(s, d).select("scene_id", F.get_json_object("stac", "$.properties.platform").alias("platform")), over("SELECT scene_id, json_extract_string(stac, '$.properties.platform') AS platform FROM scenes"))
register("meta_from_tags", lambda s, d: scenes(s, d).select("scene_id", C.parse_date(F.col("tag_date")).cast("string").alias("acquired_on")), over("SELECT scene_id, tag_date::DATE::VARCHAR AS acquired_on FROM scenes"))


def candidates(spark, d):
    return C.candidates(C.metadata(scenes(spark, d), "bands", "lon", "lat"))


CAND = f""", m AS ({META}), k AS (SELECT *, concat_ws('|', CASE WHEN platform IS NOT NULL THEN concat_ws('/', lower(platform), lower(coalesce(processing_level, '')), lower(coalesce(tile_id, ''))) END,
 CASE WHEN platform IS NULL OR tile_id IS NULL THEN '{{"lon":' || round(lon, 3) || ',"lat":' || round(lat, 3) || '}}' END, bands) AS candidate FROM m),
 g AS (SELECT candidate, count(*) AS inputs, count(acquired_at) AS dated, min(acquired_at) AS first_at, max(acquired_at) AS last_at, count_if(confidence < 0.75) AS low_confidence, count(DISTINCT acquired_at::DATE) AS days, min(scene_id) AS first_scene FROM k GROUP BY candidate HAVING count(*) >= 2),
 c AS (SELECT inputs, dated, first_at, last_at, low_confidence::BIGINT AS low_confidence, first_scene, round(dated::DOUBLE / inputs, 6) AS coverage, dated - days AS duplicate_dates,
  concat_ws(',', 'max,median', CASE WHEN dated > 0 THEN 'monthly,annual' END, CASE WHEN inputs >= 2 THEN 'moving_window,trend,seasonality,phenology' END, CASE WHEN inputs >= 3 THEN 'savitzky_golay' END) AS suggested FROM g)"""
register("ts_candidates", lambda s, d: texts(candidates(s, d).drop("candidate").withColumn("coverage", F.round("coverage", 6)), "first_at", "last_at"), over(CAND + " SELECT * REPLACE (strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at) FROM c"))
register("candidate_pick", lambda s, d: candidates(s, d).orderBy(F.desc("inputs"), F.desc("dated"), "first_scene").limit(1).select("inputs", "dated", "first_scene"), over(CAND + " SELECT inputs, dated, first_scene FROM c ORDER BY inputs DESC, dated DESC, first_scene LIMIT 1"))
register("temporal_metadata_update", lambda s, d: C.apply_edits(scenes(s, d).select("scene_id", "file_name", "bands"), scenes(s, d).filter("scene_id % 10 = 0").select("scene_id", F.lit(9).alias("bands")), "scene_id"), over("SELECT scene_id, file_name, CASE WHEN scene_id % 10 = 0 THEN 9 ELSE bands END::INTEGER AS bands FROM scenes"))
register("scene_delete", lambda s, d: scenes(s, d).select("scene_id", "bundle_id").join(scenes(s, d).filter("bundle_id = 'bundle-7'").select("scene_id"), "scene_id", "left_anti"), over("SELECT scene_id, bundle_id FROM scenes WHERE bundle_id <> 'bundle-7'"))
register("lookup_scenes_in_order", lambda s, d: scenes(s, d).selectExpr("explode(array(scene_id, scene_id)) as wanted", "scene_id * 7 % 1000 as pos").join(scenes(s, d).select("scene_id", "file_name"), F.col("wanted") == F.col("scene_id"), "left").select("pos", "wanted", "file_name"), over(", r AS (SELECT scene_id AS wanted, scene_id * 7 % 1000 AS pos FROM scenes UNION ALL SELECT scene_id, scene_id * 7 % 1000 FROM scenes) SELECT pos, wanted, file_name FROM r LEFT JOIN scenes ON wanted = scene_id"))
register("parse_date_multi", lambda s, d: scenes(s, d).selectExpr("scene_id", "case scene_id % 5 when 0 then date_format(uploaded_at, 'yyyy/MM/dd') when 1 then date_format(uploaded_at, 'yyyyMMdd') when 2 then date_format(uploaded_at, 'yyyy-MM') when 3 then 'n/a' else date_format(uploaded_at, 'yyyy') end as t").select("scene_id", C.parse_date(F.col("t")).cast("string").alias("acquired_on")), over("SELECT scene_id, CASE scene_id % 5 WHEN 0 THEN uploaded_at::DATE WHEN 1 THEN uploaded_at::DATE WHEN 2 THEN date_trunc('month', uploaded_at)::DATE WHEN 3 THEN NULL ELSE date_trunc('year', uploaded_at)::DATE END::VARCHAR AS acquired_on FROM scenes"))
register("parse_date_list", lambda s, d: scenes(s, d).selectExpr("scene_id", "concat(date_format(uploaded_at, 'yyyy-MM-dd'), '; none, ', date_format(uploaded_at, 'yyyyMMdd')) as t").select("scene_id", F.posexplode(C.parse_date_list(F.col("t"))).alias("pos", "on")).select("scene_id", "pos", F.col("on").cast("string").alias("acquired_on")), over("SELECT scene_id, p::INTEGER AS pos, CASE WHEN p = 1 THEN NULL ELSE uploaded_at::DATE END::VARCHAR AS acquired_on FROM scenes, range(3) t(p)"))
register("snowflake_id", lambda s, d: scenes(s, d).select("scene_id", C.snowflake(F.lit(1770681600000) + F.col("scene_id") * 1000, F.col("scene_id") % 16, F.col("scene_id") % 64).alias("id")), over("SELECT scene_id, (((scene_id * 1000) << 10) | ((scene_id % 16) << 6) | (scene_id % 64))::BIGINT AS id FROM scenes"))
register("safe_name", lambda s, d: V.features(s, d).select("feature_id", C.safe_name(F.concat("name", F.lit(" / "), "category", F.lit("?"))).alias("name")), V.with_views("SELECT feature_id, trim(regexp_replace(name || ' / ' || category || '?', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS name FROM features", "features"))
register("unique_names", lambda s, d: C.unique_names(scenes(s, d).select("scene_id", F.col("bundle_id").alias("name")), "name", "scene_id"), over(", r AS (SELECT scene_id, bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY scene_id) n FROM scenes) SELECT scene_id, CASE WHEN n = 1 THEN bundle_id ELSE bundle_id || '_' || n END AS name FROM r"))
register("dedupe_first", lambda s, d: scenes(s, d).groupBy("bundle_id").agg(F.min("scene_id").alias("pos")), over("SELECT bundle_id, min(scene_id) AS pos FROM scenes GROUP BY 1"))
register("dedupe_bands", lambda s, d: scenes(s, d).selectExpr("scene_id", "concat_ws(',', bands, scene_id % 3, 'x', bands, 7) as t").select("scene_id", F.array_join(F.slice(F.array_distinct(F.filter(F.transform(F.split("t", ","), lambda x: x.try_cast("int")), lambda x: x > 0)), 1, 3), ",").alias("bands")), over("SELECT scene_id, array_to_string((list_distinct_ordered)[1:3], ',') AS bands FROM (SELECT scene_id, CASE WHEN scene_id % 3 = 0 OR scene_id % 3 = bands THEN [bands, 7] ELSE [bands, (scene_id % 3)::INTEGER, 7] END AS list_distinct_ordered FROM scenes)"))
register("schema_ingest", lambda s, d: C.new_fields(scenes(s, d).selectExpr("tile as owner", "concat('f', bands) as field_name", "1 as position").filter("owner < 25").distinct(), scenes(s, d).selectExpr("tile as owner", "concat('f', bands) as field_name", "bands as position").distinct()), over(", f AS (SELECT DISTINCT tile AS owner, 'f' || bands AS field_name, bands AS position FROM scenes), r AS (SELECT DISTINCT owner, field_name, 1 AS position FROM f WHERE owner < 25), n AS (SELECT * FROM f ANTI JOIN r USING (owner, field_name)) SELECT n.owner, field_name, (coalesce(last, 0) + row_number() OVER (PARTITION BY n.owner ORDER BY position, field_name))::INTEGER AS position FROM n LEFT JOIN (SELECT owner, max(position) last FROM r GROUP BY 1) l USING (owner)"))
STATUS = "case event_type when 'click' then 'queued' when 'view' then 'running' when 'purchase' then 'succeeded' when 'error' then 'failed' else 'retrying' end"


def job_events(spark, d):
    return V.read(spark, d, "events").selectExpr("event_id", "ts", "user_id as task_id", f"{STATUS} as status")


JOBS = f"jobs AS (SELECT event_id, ts, user_id AS task_id, {STATUS} AS status FROM events)"
register("job_log", lambda s, d: C.latest_status(job_events(s, d)), f"WITH {JOBS} SELECT task_id, arg_max(status, (ts, event_id)) AS status, count(*) AS events, count_if(status = 'retrying')::BIGINT AS retries FROM jobs GROUP BY task_id")
register("latest_job_status", lambda s, d: C.latest_status(job_events(s, d)).select("task_id", "status"), f"WITH {JOBS} SELECT task_id, arg_max(status, (ts, event_id)) AS status FROM jobs GROUP BY task_id")
register("job_counts", lambda s, d: job_events(s, d).groupBy("status").count(), f"WITH {JOBS} SELECT status, count(*) AS count FROM jobs GROUP BY 1")
conv = lambda s, d: V.read(s, d, "conversations")
COMPACT = "substr(trim(regexp_replace({}, '\\s+', ' ', 'g')), 1, {})"
register("memory_snippets", lambda s, d: C.last_messages(conv(s, d)), f"SELECT conv_id, turn, role, {COMPACT.format('text', 280)} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) r FROM conversations) WHERE r <= 6 AND role IN ('user', 'assistant')")
register("archive_messages", lambda s, d: C.archive_messages(conv(s, d)), "SELECT conv_id, turn, role, substr(text, 1, 20000) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) r FROM conversations) WHERE r <= 40 AND role IN ('user', 'assistant', 'system', 'tool') AND trim(text) <> ''")
register("archive_summary", lambda s, d: C.archive_summary(conv(s, d)), f"SELECT conv_id, coalesce(nullif({COMPACT.format("(arg_min(text, turn) FILTER (WHERE role = 'user'))", 80)}, ''), 'Untitled') AS title, count(*) AS messages FROM conversations GROUP BY conv_id")
register("archive_list", lambda s, d: C.archive_summary(conv(s, d)).orderBy(F.desc("messages"), "conv_id").limit(20).select("conv_id", "messages"), "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
register("workspace_inventory", lambda s, d: V.read(s, d, "region").join(V.read(s, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").join(V.features(s, d).groupBy("layer_id").count(), F.col("n_nationkey") == F.col("layer_id"), "left").groupBy(F.col("r_name").alias("project")).agg(F.count("n_nationkey").alias("layers"), F.coalesce(F.sum("count"), F.lit(0)).alias("features")), "SELECT r_name AS project, count(n_nationkey) AS layers, coalesce(sum(n), 0)::BIGINT AS features FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) ON k = n_nationkey GROUP BY 1")
register("layers_by_project", lambda s, d: V.read(s, d, "nation").groupBy(F.col("n_regionkey").alias("project_id")).agg(F.count("*").alias("layers")), "SELECT n_regionkey AS project_id, count(*) AS layers FROM nation GROUP BY 1")
register("layer_cascade_delete", lambda s, d: V.features(s, d).join(V.read(s, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("layer_id")), "layer_id", "left_anti").groupBy("layer_id").count(), "SELECT c_nationkey::BIGINT AS layer_id, count(*) AS count FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
register("write_table_safe", lambda s, d: V.features(s, d).select("feature_id", C.spreadsheet_safe(F.when(F.col("feature_id") % 2 == 0, F.concat(F.lit("="), "name")).otherwise(F.col("name"))).alias("cell")), V.with_views("SELECT feature_id, CASE WHEN feature_id % 2 = 0 THEN '''=' || name ELSE name END AS cell FROM features", "features"))

#: Edits of scenes, layers and fields: a given value wins, a missing one leaves the row's own.
scene_edits = lambda s, d: scenes(s, d).filter("scene_id % 10 in (0, 1)").selectExpr("scene_id", "if(scene_id % 10 = 0, 'moved', null) as bundle_id", "concat('renamed-', scene_id, '.tif') as file_name")
register("scene_update", lambda s, d: C.apply_edits(scenes(s, d).select("scene_id", "file_name", "bundle_id", "bands"), scene_edits(s, d), "scene_id"), over("SELECT scene_id, CASE WHEN scene_id % 10 IN (0, 1) THEN 'renamed-' || scene_id || '.tif' ELSE file_name END AS file_name, CASE WHEN scene_id % 10 = 0 THEN 'moved' ELSE bundle_id END AS bundle_id, bands FROM scenes"))
layers = lambda s, d: V.read(s, d, "nation").selectExpr("cast(n_nationkey as long) as layer_id", "n_name as name", "cast(n_regionkey as long) as project_id")
register("layer_update", lambda s, d: C.apply_edits(layers(s, d), layers(s, d).filter("layer_id % 4 = 0").selectExpr("layer_id", "concat(lower(name), ' layer') as name", "if(layer_id % 8 = 0, 0L, null) as project_id"), "layer_id"), "SELECT n_nationkey::BIGINT AS layer_id, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) || ' layer' ELSE n_name END AS name, CASE WHEN n_nationkey % 8 = 0 THEN 0 ELSE n_regionkey END::BIGINT AS project_id FROM nation")
fields = lambda s, d: V.read(s, d, "part").selectExpr("p_partkey as field_id", "p_name as name", "p_brand as alias", "p_size as position")
register("field_update", lambda s, d: C.apply_edits(fields(s, d), fields(s, d).filter("position > 40").selectExpr("field_id", "upper(alias) as alias", "if(position > 45, 0, null) as position"), "field_id"), "SELECT p_partkey AS field_id, p_name AS name, CASE WHEN p_size > 40 THEN upper(p_brand) ELSE p_brand END AS alias, CASE WHEN p_size > 45 THEN 0 ELSE p_size END AS position FROM part")
