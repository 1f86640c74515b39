"""A deterministic evaluation trace derived from the driver's orders: tables for the retrieval, answer and evidence operators.

A case is an order, its gold evidence its lines. raw holds the lines of rank up to 15, ranked those up to 11 numbered
anew, context the first three of these. Every thirteenth order has no observable raw stage. One path needs the lines up to
number 3, each as a clause; another any one line from number 3 on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Trace:
    lines: DataFrame
    items: DataFrame
    gold: DataFrame
    stages: DataFrame


def trace(spark: SparkSession, sf_dir: str) -> Trace:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    lines = li.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("ln")).agg(F.min(1 + (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 20).alias("r"))
    raw = lines.filter("r <= 15").select("case_id", F.col("ln").alias("evidence_id"), F.col("r").alias("rank"))
    order = Window.partitionBy("case_id").orderBy("rank", "evidence_id")
    ranked = raw.filter("rank <= 11").withColumn("rank", F.row_number().over(order).cast("bigint"))
    stage = lambda df, name: df.select("case_id", F.lit(name).alias("stage"), "evidence_id", "rank")
    items = stage(raw.filter("case_id % 13 <> 0"), "raw").union(stage(ranked, "ranked")).union(stage(ranked.filter("rank <= 3"), "context"))
    one = lines.filter("ln <= 3").select("case_id", F.lit(0).alias("path"), F.col("ln").alias("clause"), F.col("ln").alias("evidence_id"))
    two = lines.filter("ln >= 3").select("case_id", F.lit(1).alias("path"), F.lit(0).alias("clause"), F.col("ln").alias("evidence_id"))
    stages = lines.select("case_id").distinct().select("case_id", F.explode(F.array(*map(F.lit, ("raw", "ranked", "context")))).alias("stage"))
    stages = stages.withColumn("observable", ~((F.col("stage") == "raw") & (F.col("case_id") % 13 == 0)))
    return Trace(lines, items, one.union(two), stages)


TRACE_SQL = """
WITH li AS (SELECT l_orderkey AS case_id, l_linenumber AS ln, min(1 + (l_partkey * 7 + l_suppkey) % 20) AS r FROM lineitem GROUP BY 1, 2),
raw AS (SELECT case_id, ln, r AS rank FROM li WHERE r <= 15),
ranked AS (SELECT case_id, ln, row_number() OVER (PARTITION BY case_id ORDER BY rank, ln) AS rank FROM raw WHERE rank <= 11),
items AS (SELECT 'raw' AS stage, case_id, ln, rank FROM raw WHERE case_id % 13 <> 0 UNION ALL SELECT 'ranked', case_id, ln, rank FROM ranked UNION ALL SELECT 'context', case_id, ln, rank FROM ranked WHERE rank <= 3),
gold AS (SELECT case_id, 0 AS path, ln AS clause, ln FROM li WHERE ln <= 3 UNION ALL SELECT case_id, 1, 0, ln FROM li WHERE ln >= 3),
stages AS (SELECT case_id, stage, NOT (stage = 'raw' AND case_id % 13 = 0) AS observable FROM (SELECT DISTINCT case_id FROM li), (VALUES ('raw'), ('ranked'), ('context')) t(stage)),
grid AS (SELECT * FROM stages, (VALUES (1), (3), (5), (10), (NULL)) v(k)),
cl AS (SELECT grid.case_id, grid.stage, grid.k, gold.path, gold.clause, min(CASE WHEN items.rank <= coalesce(grid.k, 1000000) THEN items.rank END) AS rank
 FROM grid JOIN gold ON gold.case_id = grid.case_id LEFT JOIN items ON items.case_id = grid.case_id AND items.stage = grid.stage AND items.ln = gold.ln GROUP BY ALL),
paths AS (SELECT case_id, stage, k, path, count(rank) AS hits, count(*) AS clauses, max(rank) AS last_rank, count(rank) = count(*) AS complete FROM cl GROUP BY ALL),
best AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY case_id, stage, k ORDER BY complete DESC, hits / clauses DESC, coalesce(last_rank, 1000000000000), clauses, path) = 1),
sbest AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY case_id, stage, k ORDER BY complete DESC, hits / clauses DESC, CASE WHEN complete THEN last_rank ELSE 1000000000000 END, clauses, path) = 1),
rec AS (SELECT b.case_id, b.stage, b.k, s.observable, CASE WHEN s.observable THEN hits / clauses END AS value, b.path, b.complete FROM best b JOIN stages s USING (case_id, stage) WHERE k IN (1, 3, 5)),
mrr AS (SELECT s.case_id, s.stage, s.observable, CASE WHEN s.observable THEN coalesce(1 / min(CASE WHEN complete THEN last_rank END), 0) END AS value
 FROM stages s JOIN paths p ON p.case_id = s.case_id AND p.stage = s.stage AND p.k IS NULL WHERE s.stage <> 'context' GROUP BY s.case_id, s.stage, s.observable),
wide AS (SELECT case_id, k, max(CASE WHEN stage = 'raw' THEN value END) AS raw, max(CASE WHEN stage = 'ranked' THEN value END) AS ranked, max(CASE WHEN stage = 'context' THEN value END) AS context FROM rec GROUP BY ALL)
"""
