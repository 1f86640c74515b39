"""Queries of the retrieval metrics and their aggregation over the derived trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import aggregate, answers, mses, retrieval
from scorewright.plans.traces import TRACE_SQL, trace


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return retrieval.recall(t.gold, t.items, t.stages).select("case_id", "metric_id", "status", "value", "path", "complete")


def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return retrieval.reciprocal_rank(t.gold, t.items, t.stages).select("case_id", "metric_id", "status", "value")


def stage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return retrieval.stage_changes(retrieval.recall(t.gold, t.items, t.stages)).select("case_id", "metric_id", "status", "value")


def segment_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return retrieval.stage_changes(retrieval.recall(t.gold, t.items, t.stages), clipped=True).select("case_id", "metric_id", "status", "value")


def segment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return retrieval.segment_coverage(t.gold, t.items, t.stages)


def path_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return retrieval.progress(t.gold, t.items, t.stages)


def localization_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    whole = t.stages.filter("observable").select("case_id", "stage")
    best = mses.best_at(mses.paths_at(t.gold, t.items, whole, (None,)), whole, (None,)).filter("path IS NOT NULL").select("case_id", "stage", "path")
    hit = t.items.select("case_id", "stage", "evidence_id", F.lit(True).alias("hit")).distinct()
    found = whole.join(t.gold, "case_id").join(hit, ["case_id", "stage", "evidence_id"], "left")
    status = F.when(F.col("hit"), "matched").when(F.col("evidence_id") % 3 == 0, "partial").when(F.col("evidence_id") % 3 == 1, "retrieval_missed").otherwise("provenance_missing")
    return retrieval.localization_counts(found.select("case_id", "stage", "path", "clause", status.alias("status")), best)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return retrieval.recall_and_rank(t.gold, t.items, t.stages)


def metric_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("reason", F.when(F.col("status") == "unavailable", "stage is not observable"))
    out = aggregate.aggregate_metrics(m, expected=100_000)
    return out.withColumns({c: F.round(c, 9) for c in ("value", "numerator", "coverage", "scoreable_coverage")})


def repetition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("repetition", F.col("case_id") % 3 + 1)
    out = aggregate.repetition_stats(m)
    values = F.transform("repetition_values", lambda x: F.round(x, 9).cast("string"))
    return out.select("metric_id", "repetitions", F.round("mean_of_means", 9).alias("mean_of_means"), F.round("deviation", 9).alias("deviation"), F.size(values).cast("bigint").alias("n_values"))


def execution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias("status"))
    return aggregate.execution_counts(cases, 10_000_000)


def micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.micro_macro(localization_counts(spark, sf_dir), ["metric_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("micro", "macro")})


def failure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    rec = retrieval.recall(t.gold, t.items, t.stages, (5,))
    wide = rec.groupBy("case_id").pivot("stage", ["raw", "ranked", "context"]).agg(F.first(F.when(F.col("status") == "observed", F.col("complete"))))
    n = F.col("case_id")
    cases = wide.select(
        "case_id", *[F.col(x).alias(f"{x}_complete") for x in ("raw", "ranked", "context")],
        (n % 23 == 0).alias("raw_unknown"), (n % 19 == 0).alias("ranked_unknown"), (n % 17 == 0).alias("context_unknown"), (n % 7 == 0).alias("context_empty"), (n % 2).cast("double").alias("groundedness"),
        F.element_at(F.array(F.lit("PASS"), F.lit("FAIL"), F.lit("NEEDS_REVIEW")), (n % 3 + 1).cast("int")).alias("verdict"),
        F.when(n % 29 == 0, "timeout").when(n % 31 == 0, "system_error").when(n % 37 == 0, "cancelled").otherwise("completed").alias("status"),
    )
    return answers.failure_labels(cases).select("case_id", F.array_join("labels", ",").alias("labels"))


def trace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    n, c = F.col("case_id"), F.col("case_id") % 17
    rows = t.stages.select(
        "case_id", "stage", F.when(n % 19 == 0, "abstain").otherwise("text").alias("answer_kind"),
        F.when(~F.col("observable"), "unsupported_stage").when(c == 1, "runtime_error").when(c == 2, "mapping_corrupted").otherwise("observed").alias("trace"),
        (c == 3).alias("receipts_differ"), (c == 4).alias("unknown_segments"), (c == 5).alias("duplicate_chunks"), (c == 6).alias("manifest_differs"), (n % 5).alias("widest_chunk"),
    )
    return retrieval.trace_status(rows).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


def _traced(spark: SparkSession, sf_dir: str):
    t = trace(spark, sf_dir)
    n = F.col("case_id")
    status = F.when(n % 19 == 0, "not_applicable").when(~F.col("observable"), "error").otherwise("observed")
    return t, t.stages.select("case_id", "stage", status.alias("status"))


def segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, stages = _traced(spark, sf_dir)
    return retrieval.segment_metrics(t.gold, t.items, stages).select("case_id", "metric_id", "status", "value")


def clause_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    out = retrieval.clause_matrix(t.gold, t.items, t.stages.filter("observable"))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("alternatives", "matched")})


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return retrieval.stage_outcomes(retrieval.clause_matrix(t.gold, t.items, t.stages.filter("observable")))


def stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).withColumn("complete_paths", F.array_join(F.col("complete_paths").cast("array<string>"), ","))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with what the segment and the private labels are derived from."""
    wide = _outcomes(spark, sf_dir).groupBy("case_id").pivot("stage", ["raw", "ranked", "context"]).agg(F.first(F.struct("outcome", F.size("complete_paths").alias("paths"))))
    n = F.col("case_id")
    of = lambda m, s: F.element_at(F.array(*map(F.lit, s)), (n % m + 1).cast("int"))
    return wide.select(
        "case_id", F.coalesce(F.when(n % 43 == 0, "runtime_error"), F.col("raw.outcome"), F.lit("unsupported_stage")).alias("raw_outcome"), F.col("ranked.outcome").alias("ranked_outcome"),
        F.when(n % 47 == 0, "mapping_corrupted").otherwise(F.col("context.outcome")).alias("context_outcome"), *[F.coalesce(F.col(f"{s}.paths"), F.lit(0)).alias(f"{s}_paths") for s in ("raw", "ranked", "context")],
        of(3, ("observed", "needs_review", "observed")).alias("accuracy_status"), (n % 2).cast("double").alias("accuracy"), of(5, ("observed", "observed", "needs_review", "observed", "not_applicable")).alias("groundedness_status"),
        of(7, ("observed", "needs_review", "observed", "observed", "observed", "observed", "observed")).alias("hallucination_status"), (n % 4 == 3).cast("double").alias("hallucination"),
        F.when(n % 19 == 0, "abstain").otherwise("text").alias("answer_kind"), (n % 6).alias("unmapped"), F.when(n % 29 == 0, "failed").otherwise("completed").alias("status"),
    )


def segment_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answers.segment_failure_labels(_labelled(spark, sf_dir))
    return out.select("case_id", F.array_join("labels", ",").alias("labels"), "certainty")


def private_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answers.private_failure_labels(_labelled(spark, sf_dir))
    return out.select("case_id", F.array_join("labels", ",").alias("labels"), "certainty")


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, stages = _traced(spark, sf_dir)
    cases = answers.private_failure_labels(_labelled(spark, sf_dir)).select("case_id", "status", "labels")
    items = t.items.select("case_id", (F.col("evidence_id") % 3 != 0).alias("mapped"))
    out = aggregate.evaluation_summary(cases, retrieval.segment_metrics(t.gold, t.items, stages), items)
    return out.withColumn("value", F.round("value", 9))


def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return aggregate.mapping_coverage(t.items.withColumn("mapped", F.when(F.col("evidence_id") == 2, None).otherwise(F.col("evidence_id") % 3 != 0)), ["case_id", "stage"])


QUERIES = {f.__name__: f for f in (recall_at_k, reciprocal_rank, stage_delta, segment_loss, segment_coverage, path_progress, localization_counts, metric_aggregate, repetition_stats, execution_counts, micro_macro, failure_labels, trace_status, segment_metrics, clause_matrix, stage_outcomes, segment_failures, private_failures, evaluation_summary, mapping_coverage)}

_REC = "stage || '_recall@' || k::varchar AS metric_id, CASE WHEN observable THEN 'observed' ELSE 'unavailable' END AS status, value"
_MRR = "stage || '_mrr' AS metric_id, CASE WHEN observable THEN 'observed' ELSE 'unavailable' END AS status, value"
_CHANGE = "SELECT case_id, '{0}@' || k::varchar AS metric_id, CASE WHEN {1} IS NOT NULL AND {2} IS NOT NULL THEN 'observed' ELSE 'unavailable' END AS status, CASE WHEN {1} IS NOT NULL AND {2} IS NOT NULL THEN {3} END AS value FROM wide"
_ALL = f"m AS (SELECT case_id, {_REC} FROM rec UNION ALL SELECT case_id, {_MRR} FROM mrr)"
_LOC = """loc AS (SELECT b.case_id, b.stage, g.clause, min(CASE WHEN i.ln IS NOT NULL THEN 1 WHEN g.ln % 3 = 0 THEN 2 WHEN g.ln % 3 = 1 THEN 4 ELSE 3 END) AS code
 FROM best b JOIN stages s USING (case_id, stage) JOIN gold g ON g.case_id = b.case_id AND g.path = b.path
 LEFT JOIN items i ON i.case_id = b.case_id AND i.stage = b.stage AND i.ln = g.ln WHERE b.k IS NULL AND s.observable GROUP BY ALL),
lc AS (SELECT case_id, stage, count(*) AS denominator, count(*) FILTER (code = 1) AS matched, count(*) FILTER (code = 2) AS partial, count(*) FILTER (code = 3) AS provenance_missing, count(*) FILTER (code = 4) AS retrieval_missed FROM loc GROUP BY ALL),
ll AS (SELECT case_id, stage || '_localization_' || st AS metric_id, v AS value, denominator FROM lc, LATERAL (VALUES ('matched', matched), ('partial', partial), ('provenance_missing', provenance_missing), ('retrieval_missed', retrieval_missed)) t(st, v))"""

_SEG = """sm AS (SELECT s.case_id, s.stage, v.m AS metric_id, CASE WHEN s.case_id % 19 = 0 THEN 'not_applicable' WHEN NOT observable THEN 'error' ELSE 'observed' END AS status, v.x AS x
 FROM stages s JOIN sbest b ON b.case_id = s.case_id AND b.stage = s.stage, LATERAL (VALUES ('segment_' || s.stage || '_recall@' || k, hits / clauses, 1), ('segment_' || s.stage || '_gold_evidence_coverage@' || k, hits / clauses, 1),
 ('segment_' || s.stage || '_complete_evidence_coverage@' || k, complete::int::double, 1), ('segment_' || s.stage || '_mrr', CASE WHEN complete THEN 1 / last_rank ELSE 0 END, 2)) v(m, x, kind)
 WHERE CASE WHEN k IS NULL THEN kind = 2 AND s.stage <> 'context' ELSE kind = 1 END), sv AS (SELECT case_id, metric_id, status, CASE WHEN status = 'observed' THEN x END AS value FROM sm)"""
_MATRIX = """mx AS (SELECT s.case_id, s.stage, g.path, g.clause, list_sort(list(DISTINCT g.ln)) AS al, list_sort(list(DISTINCT g.ln) FILTER (i.ln IS NOT NULL)) AS ma, min(i.rank) AS earliest_rank FROM stages s JOIN gold g ON g.case_id = s.case_id
 LEFT JOIN items i ON i.case_id = s.case_id AND i.stage = s.stage AND i.ln = g.ln WHERE s.observable GROUP BY ALL),
mp AS (SELECT case_id, stage, path, count(earliest_rank) AS h, count(*) AS n FROM mx GROUP BY ALL),
oc AS (SELECT case_id, stage, coalesce(list_sort(list(path) FILTER (h = n)), []) AS cp, CASE WHEN count(*) FILTER (h = n) > 0 THEN 'complete' WHEN sum(h) > 0 THEN 'partial_coverage' ELSE 'retrieval_missing' END AS outcome FROM mp GROUP BY ALL),
ow AS (SELECT case_id, CASE WHEN case_id % 43 = 0 THEN 'runtime_error' ELSE coalesce(max(outcome) FILTER (stage = 'raw'), 'unsupported_stage') END AS a, max(outcome) FILTER (stage = 'ranked') AS b, CASE WHEN case_id % 47 = 0 THEN 'mapping_corrupted' ELSE max(outcome) FILTER (stage = 'context') END AS c,
 coalesce(max(len(cp)) FILTER (stage = 'raw'), 0) AS na, max(len(cp)) FILTER (stage = 'ranked') AS nb, max(len(cp)) FILTER (stage = 'context') AS nc FROM oc GROUP BY 1),
pf AS (SELECT case_id, list_sort(list_filter(CASE WHEN case_id % 19 = 0 THEN [CASE WHEN case_id % 3 <> 1 AND case_id % 2 = 0 THEN 'unsupported_answer' END, 'needs_review'] ELSE
 [CASE WHEN na = 0 THEN 'retrieval_missing' WHEN nb = 0 THEN 'ranking_failure' WHEN nc = 0 THEN 'context_selection_loss' END, CASE WHEN case_id % 3 <> 1 AND case_id % 2 = 0 THEN 'generation_failure' END, CASE WHEN case_id % 3 = 1 OR case_id % 6 > 0 THEN 'needs_review' END] END, lambda x: x IS NOT NULL)) AS l FROM ow)"""

ORACLES = {
    "segment_metrics": f"{TRACE_SQL}, {_SEG} SELECT * FROM sv",
    "clause_matrix": f"{TRACE_SQL}, {_MATRIX} SELECT case_id, stage, path, clause, array_to_string(al, ',') AS alternatives, coalesce(array_to_string(ma, ','), '') AS matched, earliest_rank FROM mx",
    "stage_outcomes": f"{TRACE_SQL}, {_MATRIX} SELECT case_id, stage, array_to_string(cp, ',') AS complete_paths, outcome FROM oc",
    "segment_failures": f"""{TRACE_SQL}, {_MATRIX}, q AS (SELECT *, case_id % 3 = 1 OR case_id % 5 = 2 OR case_id % 7 = 1 AS r FROM ow),
z AS (SELECT case_id, r, list_filter([nullif(a, 'complete'), nullif(b, 'complete'), nullif(c, 'complete'), CASE WHEN a = 'complete' AND b <> 'complete' THEN 'ranking_failure' END, CASE WHEN b = 'complete' AND c <> 'complete' THEN 'context_selection_loss' END,
 CASE WHEN c = 'complete' AND case_id % 3 <> 1 AND case_id % 2 = 0 THEN 'generation_failure' END, CASE WHEN case_id % 7 <> 1 AND case_id % 4 = 3 THEN 'unsupported_answer' END, CASE WHEN r THEN 'needs_review' END], lambda x: x IS NOT NULL) AS l FROM q)
SELECT case_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS labels, CASE WHEN r THEN 'unknown' ELSE 'deterministic' END AS certainty FROM z""",
    "private_failures": f"{TRACE_SQL}, {_MATRIX} SELECT case_id, array_to_string(l, ',') AS labels, CASE WHEN list_contains(l, 'needs_review') THEN 'unknown' ELSE 'deterministic' END AS certainty FROM pf",
    "evaluation_summary": f"""{TRACE_SQL}, {_SEG}, {_MATRIX}, d AS (SELECT case_id FROM pf WHERE case_id % 29 <> 0)
SELECT 'cases' AS section, v.a AS name, v.n AS n, NULL::double AS value FROM (SELECT count(*) AS a, count(*) FILTER (case_id % 29 <> 0) AS c FROM pf), LATERAL (VALUES ('all', a), ('completed', c), ('execution_error', a - c)) v(a, n)
UNION ALL SELECT 'metric_status', status, count(*), NULL FROM sv SEMI JOIN d USING (case_id) GROUP BY 2 UNION ALL SELECT 'metric', metric_id, count(*), round(avg(value), 9) FROM sv SEMI JOIN d USING (case_id) WHERE value IS NOT NULL GROUP BY 2
UNION ALL SELECT 'failure_label', x, count(*), NULL FROM (SELECT unnest(l) AS x FROM pf SEMI JOIN d USING (case_id)) GROUP BY 2 UNION ALL SELECT 'mapping', 'mapped_items', count(*) FILTER (ln % 3 <> 0), round(count(*) FILTER (ln % 3 <> 0) / count(*), 9) FROM items SEMI JOIN d USING (case_id)""",
    "mapping_coverage": f"{TRACE_SQL} SELECT case_id, stage, count(*) FILTER (ln <> 2 AND ln % 3 <> 0) AS mapped_items, count(*) AS total_items, count(*) FILTER (ln = 2 OR ln % 3 = 0) AS unmapped_items, count(*) FILTER (ln <> 2 AND ln % 3 <> 0) / count(*) AS coverage FROM items GROUP BY ALL",
    "recall_at_k": f"{TRACE_SQL} SELECT case_id, {_REC}, path, complete FROM rec",
    "reciprocal_rank": f"{TRACE_SQL} SELECT case_id, {_MRR} FROM mrr",
    "stage_delta": f"{TRACE_SQL} {_CHANGE.format('retrieval_stage_delta', 'ranked', 'raw', 'ranked - raw')} UNION ALL {_CHANGE.format('context_selection_loss', 'ranked', 'context', 'ranked - context')}",
    "segment_loss": f"{TRACE_SQL} {_CHANGE.format('segment_raw_to_ranked_evidence_loss', 'ranked', 'raw', 'greatest(raw - ranked, 0)')} UNION ALL {_CHANGE.format('segment_ranked_to_context_evidence_loss', 'ranked', 'context', 'greatest(ranked - context, 0)')}",
    "segment_coverage": f"""{TRACE_SQL} SELECT b.case_id, b.stage, b.k, CASE WHEN observable THEN hits / clauses END AS coverage, CASE WHEN observable THEN complete::int::double END AS complete_coverage,
 CASE WHEN NOT observable THEN NULL WHEN complete THEN 'complete' WHEN hits > 0 THEN 'partial_coverage' ELSE 'retrieval_missing' END AS outcome, path
 FROM sbest b JOIN stages USING (case_id, stage) WHERE k IS NOT NULL""",
    "path_progress": f"""{TRACE_SQL} SELECT case_id, stage, k, max(hits / clauses) AS clause_recall, max(complete::int)::double AS path_success,
 CASE WHEN k IS NULL THEN coalesce(1 / min(CASE WHEN complete THEN last_rank END), 0) END AS path_mrr FROM paths GROUP BY case_id, stage, k""",
    "localization_counts": f"{TRACE_SQL}, {_LOC} SELECT case_id, split_part(metric_id, '_localization_', 1) AS stage, metric_id, value, denominator FROM ll",
    "metric_aggregate": f"""{TRACE_SQL}, {_ALL}, g AS (SELECT metric_id, count(*) AS n, sum(value) AS numerator, count(value) AS d FROM m GROUP BY 1)
 SELECT metric_id, CASE WHEN d > 0 THEN 'observed' ELSE 'unavailable' END AS status, round(numerator / d, 9) AS value, round(numerator, 9) AS numerator, d AS denominator, round(d / 100000, 9) AS coverage,
 n AS scoreable_cases, round(d / n, 9) AS scoreable_coverage, CASE WHEN d = 0 THEN 'stage is not observable' END AS reason, d AS n_observed, n - d AS n_unavailable, 0::bigint AS n_not_applicable, 0::bigint AS n_error, 0::bigint AS n_needs_review FROM g""",
    "repetition_stats": f"""{TRACE_SQL}, {_ALL}, r AS (SELECT metric_id, case_id % 3 + 1 AS rep, avg(value) AS mean FROM m WHERE status = 'observed' GROUP BY ALL)
 SELECT metric_id, count(*) AS repetitions, round(avg(mean), 9) AS mean_of_means, round(stddev_pop(mean), 9) AS deviation, count(*) AS n_values FROM r GROUP BY 1""",
    "execution_counts": """SELECT 10000000::bigint AS expected, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed,
 greatest(0, 10000000 - count(*))::bigint AS not_run, (10000000 - count(*) FILTER (o_orderstatus = 'F')) / 10000000 AS failure_rate FROM orders""",
    "micro_macro": f"""{TRACE_SQL}, {_LOC} SELECT metric_id, sum(value)::bigint AS numerator, sum(denominator)::bigint AS denominator, count(*) AS cases, round(sum(value) / sum(denominator), 9) AS micro, round(avg(value / denominator), 9) AS macro FROM ll GROUP BY 1""",
    "failure_labels": f"""{TRACE_SQL}, z AS (SELECT case_id, max(CASE WHEN stage = 'raw' AND observable THEN complete::int END) AS a, max(CASE WHEN stage = 'ranked' THEN complete::int END) AS b, max(CASE WHEN stage = 'context' THEN complete::int END) AS c FROM rec WHERE k = 5 GROUP BY 1),
y AS (SELECT *, a IS NOT NULL AND case_id % 23 = 0 AS ua, a IS NOT NULL AND case_id % 19 = 0 AS ub, case_id % 17 = 0 AS uc FROM z)
SELECT case_id, CASE WHEN case_id % 29 = 0 THEN 'timeout' WHEN case_id % 31 = 0 THEN 'adapter_error' WHEN case_id % 37 = 0 THEN 'needs_review' ELSE
 array_to_string(list_filter([CASE WHEN ua OR ub OR uc THEN 'provenance_unavailable' END, CASE WHEN NOT ua AND a = 0 THEN 'retrieval_missing' END, CASE WHEN NOT ub AND a = 1 AND b = 0 THEN 'ranking_failure' END,
 CASE WHEN NOT uc AND b = 1 AND c = 0 THEN 'context_selection_loss' END, CASE WHEN c = 1 AND case_id % 3 = 1 THEN 'generation_failure' END, CASE WHEN case_id % 7 = 0 AND case_id % 2 = 0 THEN 'unsupported_answer' END,
 CASE WHEN a IS NULL OR ua OR ub OR uc OR case_id % 3 = 2 THEN 'needs_review' END], lambda x: x IS NOT NULL), ',') END AS labels FROM y""",
    "trace_status": f"""{TRACE_SQL} SELECT stage, CASE WHEN case_id % 19 = 0 THEN 'not_applicable' WHEN NOT observable THEN 'not_applicable' WHEN case_id % 17 IN (1, 2, 3, 4, 5, 6) THEN 'error' WHEN case_id % 5 > 1 THEN 'not_applicable' ELSE 'observed' END AS status, count(*) AS n FROM stages GROUP BY ALL""",
}
