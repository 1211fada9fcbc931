"""Queries op1 to op13 and the pipeline over whole tables, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    read = read_warc(spark, write_warc(table(spark, sf_dir, "pages")), payloads=False).filter("status = 'record'")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate_perspectives

    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprint_pairs

    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), 1024, 2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunked_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompress import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents"), 50, texts_too=False)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cells import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair_conversations

    return repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_warc": op1_warc, "op2_minhash": op2_minhash, "op3_chat": op3_chat, "op4_merkle": op4_merkle, "op5_packing": op5_packing, "op6_toxicity": op6_toxicity, "op7_topk": op7_topk, "op8_bpe": op8_bpe, "op9_lm": op9_lm, "op10_substring_dedup": op10_substring_dedup, "op11_ranked_search": op11_ranked_search, "op12_embedding_dedup": op12_embedding_dedup, "op13_repair": op13_repair}
ORACLES: dict[str, str] = {}
ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest FROM d),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM b GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM b JOIN f USING (payload_digest)
"""
ORACLES["op3_chat"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, p.perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS rendered_role
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || CASE WHEN rendered_role = 'user' THEN 'user name=' || speaker ELSE rendered_role END || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, length(segment)::BIGINT AS length, (coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective
      ORDER BY turn NULLS LAST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM s)
SELECT conv_id, perspective, turn, speaker, rendered_role, segment, start, length,
  CASE WHEN speaker = perspective THEN start + length(head) END AS mask_start,
  CASE WHEN speaker = perspective THEN length(text) + 10 ELSE 0 END::BIGINT AS mask_length FROM o
"""
ORACLES["op7_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
ORACLES["op11_ranked_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
l AS (SELECT rid, doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS total FROM l),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM l) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), g),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // total)))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN l USING (rid), g GROUP BY ALL),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
ORACLES["op12_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
c(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.a, p.b FROM c JOIN p ON p.a = c.b),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept FROM embeddings e JOIN m ON m.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
ORACLES["op13_repair"] = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS key FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, key), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, t),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha1(text)) AS i FROM d),
f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault FROM n),
step(s, nxt, line) AS (VALUES (0, 2, chr(10) || 'user:'), (1, 2, chr(10) || 'user:'), (2, 3, chr(10) || 'assistant:'), (3, 2, chr(10) || 'user:')),
ins(s, n, t, lines) AS (SELECT s, 0, s, '' FROM step UNION ALL SELECT ins.s, n + 1, nxt, lines || line FROM ins JOIN step ON step.s = ins.t WHERE n < 3),
b AS (SELECT conv_id, max(i) + 1 AS i, s, {'cost': 5 * n, 'audit': repeat('I', n), 'said': lines} AS best FROM f,
    (VALUES (0, 0, ''), (1, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 1, chr(10) || 'assistant:'), (3, 0, '')) AS e(s, n, lines) GROUP BY conv_id, s, n, lines
  UNION ALL
  SELECT conv_id, i, s, min(best) FROM (
    SELECT f.conv_id, f.i, ins.s, {'cost': 5 * ins.n + o.cost + b.best.cost, 'audit': repeat('I', ins.n) || o.letter || b.best.audit, 'said': ins.lines || o.line || b.best.said} AS best
    FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1 CROSS JOIN ins JOIN step ON step.s = ins.t,
    LATERAL (SELECT 'D' AS letter, ins.t AS nxt, 2 AS cost, '' AS line
      UNION ALL SELECT 'R', step.nxt, 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, step.line || text WHERE fault IN ('fine', 'truncated')
      UNION ALL SELECT 'K', CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE ins.t END, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, chr(10) || role || ':' || text
        WHERE fault IN ('fine', 'truncated') AND (r = '' OR r = 's' AND ins.t = 0 OR r = 'u' AND ins.t <> 2 OR r = 'a' AND ins.t = 2)) o
    WHERE b.s = o.nxt) GROUP BY conv_id, i, s),
c AS (SELECT conv_id, (coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0))::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (earlier || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.best.cost, 0)::BIGINT AS cost, coalesce(b.best.audit, '') AS audit, sha256(coalesce(b.best.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1 AND b.s = 0
"""
