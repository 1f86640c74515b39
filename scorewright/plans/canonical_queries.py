"""Queries of the canonical-object operators over tables derived from the driver's data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import canonical
from scorewright.plans.traces import TRACE_SQL, trace


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def object_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("document_id"), F.col("p_partkey").alias("object_id"), F.when(F.col("p_partkey") >= 50, F.col("p_partkey") % 50).alias("parent_id"), F.col("p_size").alias("document_order"))
    return canonical.relations(p)


def row_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return canonical.row_segments(t.lines.select(F.floor(F.col("case_id") / 8).alias("table_id"), (F.col("case_id") % 8).alias("row"), F.col("ln").alias("column"), F.col("r").cast("string").alias("value")))


def gold_on_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    leaves = e.filter("event_id % 4 <> 1").select(F.col("user_id").alias("document_id"), (F.col("event_id") % 3).alias("object_id"), F.col("event_id").alias("leaf_id"), (F.col("event_id") % 500).alias("start"), (F.col("event_id") % 500 + 40).alias("end"))
    g = e.filter("event_id % 7 = 0")
    gold = g.select(F.col("event_id").alias("case_id"), F.lit(1).alias("evidence_id"), F.col("user_id").alias("document_id"), (F.col("event_id") % 5).alias("object_id"),
                    F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 500).alias("start"), (F.col("event_id") % 500 + 9).alias("end"))
    return canonical.gold_on_leaves(gold, leaves)


def stage_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    chunk = F.col("case_id") * 10 + F.col("evidence_id")
    items = t.items.select("case_id", "stage", chunk.alias("chunk_id"))
    edges = t.lines.select((F.col("case_id") * 10 + F.col("ln")).alias("chunk_id"), F.col("ln").alias("evidence_id"), F.when(F.col("r") % 3 == 0, "full").when(F.col("r") % 3 == 1, "partial").alias("coverage"))
    return canonical.stage_decisions(t.lines.select("case_id", F.col("ln").alias("evidence_id")), items, edges).groupBy("stage", "decision").agg(F.count(F.lit(1)).alias("n"))


def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), F.col("text").alias("content"))
    return canonical.running_offsets(d).select("document_id", "ordinal", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("scope_end").cast("bigint").alias("scope_end"))


def grid_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.array("p_name", "p_type"), F.array("p_brand", (F.col("p_size") % 5).cast("string"))).alias("grid"))
    return canonical.grid_matches(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"))


def question_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("object_id"), "text").withColumnRenamed("text", "content")
    cells = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("object_id"), F.col("n_name").alias("column_header"), F.lit("").alias("row_header"), F.when(F.col("n_regionkey") == 1, "").otherwise("v").alias("value"))
    return canonical.targets(blocks, cells).select("kind", "object_id")


def answer_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    v = lambda x: F.element_at(F.array(F.lit("PASS"), F.lit("FAIL"), F.lit("NEEDS_REVIEW")), (x % 3 + 1).cast("int"))
    o = _t(spark, sf_dir, "orders").select(n.alias("case_id"), F.when(n % 4 > 0, v(n)).alias("metric_verdict"), F.when(n % 5 == 0, v(n + 1)).alias("rescored"), F.when(n % 6 < 2, "complete").when(n % 6 == 2, "retrieval_missing").when(n % 6 == 3, "partial_coverage").alias("context_outcome"), (n % 13 != 0).alias("observable"))
    return canonical.judgments(o, o.filter("case_id % 11 = 0").select("case_id", F.lit("correct").alias("verdict"))).groupBy("answer", "evidence").agg(F.count(F.lit(1)).alias("n"))


def negative_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    scopes = t.lines.select("case_id").distinct().withColumn("object_id", F.explode(F.array(F.lit(1), F.lit(9))))
    return canonical.negative_scope(t.lines.select("case_id", F.col("ln").alias("object_id")), scopes)


def ingest_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("content"))
    got = p.filter("chunk_id % 9 <> 0").select(F.when(F.col("chunk_id") % 70 == 1, -F.col("chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(F.col("chunk_id") % 8 == 0, "other").otherwise(F.col("content")).alias("content"))
    return canonical.acceptance(p.select("chunk_id", F.sha2("content", 256).alias("content_sha256")), got)


QUERIES = {f.__name__: f for f in (object_relations, row_segments, gold_on_leaves, stage_decisions, block_offsets, grid_matches, question_targets, answer_judgments, negative_scope, ingest_acceptance)}

ORACLES = {
    "object_relations": """WITH o AS (SELECT p_size % 10 AS d, p_partkey AS id, CASE WHEN p_partkey >= 50 THEN p_partkey % 50 END AS parent, p_size AS ord FROM part)
SELECT parent AS source_id, 'contains' AS kind, id AS target_id FROM o WHERE parent IS NOT NULL UNION ALL
SELECT * FROM (SELECT id, 'precedes', lead(id) OVER (PARTITION BY d, parent ORDER BY ord, id) AS n FROM o) WHERE n IS NOT NULL""",
    "row_segments": f"""{TRACE_SQL}, c AS (SELECT case_id // 8 AS t, case_id % 8 AS r0, ln, r::varchar AS v, first_value(r::varchar) OVER (PARTITION BY case_id // 8, ln ORDER BY case_id % 8) AS h, min(case_id % 8) OVER (PARTITION BY case_id // 8) AS top FROM li)
SELECT t AS table_id, r0 AS "row", string_agg(h || ': ' || v, ' | ' ORDER BY ln) AS content FROM c WHERE r0 > top GROUP BY ALL""",
    "gold_on_leaves": """WITH l AS (SELECT user_id AS d, event_id % 3 AS o, event_id AS id, event_id % 500 AS s, event_id % 500 + 40 AS e FROM events WHERE event_id % 4 <> 1),
g AS (SELECT event_id AS c, user_id AS d, event_id % 5 AS o, CASE WHEN event_id % 2 = 0 THEN event_id % 500 END AS s, event_id % 500 + 9 AS e FROM events WHERE event_id % 7 = 0)
SELECT c AS case_id, 1 AS evidence_id, l.id AS leaf_id, CASE WHEN l.id IS NULL THEN 'not_segmentable' END AS fault FROM g LEFT JOIN l ON l.d = g.d AND l.o = g.o AND (g.s IS NULL OR (l.s < g.e AND l.e > g.s))""",
    "stage_decisions": f"""{TRACE_SQL}, d AS (SELECT s.stage, CASE WHEN i.ln IS NULL THEN 'missed' WHEN li.r % 3 = 0 THEN 'full' WHEN li.r % 3 = 1 THEN 'partial' ELSE 'unknown' END AS decision FROM stages s JOIN li ON li.case_id = s.case_id LEFT JOIN items i ON i.case_id = s.case_id AND i.stage = s.stage AND i.ln = li.ln)
SELECT stage, decision, count(*) AS n FROM d GROUP BY ALL""",
    "block_offsets": """WITH b AS (SELECT conv_id, turn, length(text) AS n, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS e FROM conversations)
SELECT conv_id AS document_id, turn AS ordinal, (e - n)::bigint AS start, e::bigint AS "end", coalesce(lead(e - n) OVER (PARTITION BY conv_id ORDER BY turn) - 1, e)::bigint AS scope_end FROM b""",
    "grid_matches": """WITH k AS (SELECT p_partkey AS id, p_name || '|' || p_type || '|' || p_brand || '|' || p_size % 5 AS g FROM part), a AS (SELECT g, min(id) AS id FROM k WHERE id % 2 = 0 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT g, min(id) AS id FROM k WHERE id % 2 = 1 GROUP BY 1 HAVING count(*) = 1)
SELECT a.id AS known_id, b.id AS found_id FROM a JOIN b USING (g)""",
    "question_targets": r"""SELECT 'block' AS kind, item_id AS object_id FROM benchmark WHERE length(text) BETWEEN 20 AND 600 UNION ALL SELECT 'cell', n_nationkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'version', item_id FROM benchmark WHERE regexp_matches(text, '\bversion\b|\bv\d|\bauthor|版本|批准|发布', 'i')""",
    "answer_judgments": """WITH x AS (SELECT o_orderkey AS n FROM orders), y AS (SELECT n, CASE WHEN n % 11 = 0 THEN 'correct' ELSE coalesce(['correct', 'incorrect', 'needs_review'][CASE WHEN n % 5 = 0 THEN (n + 1) % 3 + 1 WHEN n % 4 > 0 THEN n % 3 + 1 END], 'unavailable') END AS answer FROM x)
SELECT answer, CASE WHEN n % 13 = 0 THEN 'unverifiable' WHEN n % 6 < 2 THEN CASE WHEN answer = 'correct' THEN 'grounded' ELSE 'needs_review' END WHEN n % 6 = 2 THEN 'missing' WHEN n % 6 = 3 THEN 'ungrounded' ELSE 'unavailable' END AS evidence, count(*) AS n FROM y GROUP BY 1, 2""",
    "negative_scope": f"""{TRACE_SQL} SELECT case_id, ln AS object_id, 'required' AS role FROM li UNION ALL SELECT c.case_id, o, 'negative_scope' FROM (SELECT DISTINCT case_id FROM li) c, (VALUES (1), (9)) t(o) WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.case_id = c.case_id AND li.ln = o)""",
    "ingest_acceptance": """SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 70 = 1 THEN 'not_ingested' ELSE 'content_differs' END AS fault FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 70 = 1 OR p_partkey % 8 = 0
UNION ALL SELECT -p_partkey, 'not_expected' FROM part WHERE p_partkey % 70 = 1 AND p_partkey % 9 <> 0""",
}
