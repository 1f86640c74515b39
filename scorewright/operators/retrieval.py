"""Retrieval metrics in long form: (case_id, stage, k, metric_id, status, value). Null is never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators.mses import best_at, clause_ranks, path_coverage, paths_at, ranked_gold

#: Cutoffs of the locator and of the segment metrics.
CUTOFFS, SEGMENT_CUTOFFS = (1, 3, 5), (1, 3, 5, 10)


def grid(stages: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """(case_id, stage, k) for all stages, with a null k for rank metrics."""
    ks = F.array(*[F.lit(k) for k in cutoffs], F.lit(None).cast("int"))
    return stages.select("case_id", "stage", F.explode(ks).alias("k"))


def recall(gold: DataFrame, items: DataFrame, stages: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """{stage}_recall@k: the part of the best path's clauses that items of rank <= k hit.

    stages (case_id, stage, observable) lists all that should be there; unobservable ones are unavailable, not zero.
    """
    out = best_at(paths_at(gold, items, stages, cutoffs), stages, cutoffs).filter("path IS NOT NULL")
    value = F.when(F.col("observable"), F.col("hits") / F.col("clauses"))
    name = F.concat("stage", F.lit("_recall@"), F.col("k").cast("string"))
    status = F.when(F.col("observable"), "observed").otherwise("unavailable")
    return out.select("case_id", "stage", "k", name.alias("metric_id"), status.alias("status"), value.alias("value"), "path", "complete")


def reciprocal_rank(gold: DataFrame, items: DataFrame, stages: DataFrame, of: tuple[str, ...] = ("raw", "ranked")) -> DataFrame:
    """{stage}_mrr: 1 / the least rank at which some path is complete, 0 if none ever is. The context has none."""
    asked = stages.filter(F.col("stage").isin(*of))
    whole = asked.select("case_id", "stage", F.lit(None).cast("int").alias("k"))
    paths = path_coverage(clause_ranks(gold, items, whole))
    first = paths.groupBy("case_id", "stage").agg(F.min(F.when(F.col("complete"), F.col("last_rank"))).alias("rank"))
    out = asked.join(first, ["case_id", "stage"], "left")
    value = F.when(F.col("observable"), F.coalesce(1 / F.col("rank"), F.lit(0.0)))
    status = F.when(F.col("observable"), "observed").otherwise("unavailable")
    return out.select("case_id", "stage", F.concat("stage", F.lit("_mrr")).alias("metric_id"), status.alias("status"), value.alias("value"))


def recall_and_rank(gold: DataFrame, items: DataFrame, stages: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, of: tuple[str, ...] = ("raw", "ranked")) -> DataFrame:
    """(case_id, metric_id, status, value): the rows of recall and reciprocal_rank together, from one pass.

    Every cutoff is a pair of columns of a path, so that no row is multiplied by the cutoffs, and the best path of each is a
    minimum: four aggregations in all, each grouped finer than the one after it.
    """
    asked = stages.join(gold, "case_id")
    best = items.groupBy("case_id", "stage", "evidence_id").agg(F.min("rank").alias("rank"))
    keys = ["case_id", "stage", "observable"]
    least = asked.join(best, ["case_id", "stage", "evidence_id"], "left").groupBy(*keys, "path", "clause").agg(F.min("rank").alias("rank"))
    inside = lambda k: F.when(F.col("rank") <= k, F.col("rank"))
    paths = least.groupBy(*keys, "path").agg(
        F.count(F.lit(1)).alias("clauses"), F.count("rank").alias("all"), F.max("rank").alias("last"),
        *[F.count(inside(k)).alias(f"hits_{k}") for k in cutoffs], *[F.max(inside(k)).alias(f"last_{k}") for k in cutoffs],
    )
    part = lambda k: F.col(f"hits_{k}") / F.col("clauses")
    order = lambda k: F.struct(F.col(f"hits_{k}") < F.col("clauses"), -part(k), F.coalesce(f"last_{k}", F.lit(10**12)), "clauses", "path", part(k).alias("part"))
    per = paths.groupBy(*keys).agg(F.min(F.when(F.col("all") == F.col("clauses"), F.col("last"))).alias("first"), *[F.min(order(k)).alias(f"best_{k}") for k in cutoffs])
    row = lambda name, value: F.struct(F.concat("stage", F.lit(name)).alias("metric_id"), value.alias("value"))
    ranks = F.when(F.col("stage").isin(*of), F.array(row("_mrr", F.coalesce(1 / F.col("first"), F.lit(0.0))))).otherwise(F.array().cast("array<struct<metric_id:string,value:double>>"))
    rows = F.concat(F.array(*[row(f"_recall@{k}", F.col(f"best_{k}.part")) for k in cutoffs]), ranks)
    out = per.select("case_id", "observable", F.inline(rows))
    return out.select("case_id", "metric_id", F.when(F.col("observable"), "observed").otherwise("unavailable").alias("status"), F.when(F.col("observable"), F.col("value")).alias("value"))


def stage_changes(recalls: DataFrame, clipped: bool = False) -> DataFrame:
    """Differences between stages at the same k: ranked - raw and ranked - context, signed.

    clipped: instead what is lost from raw to ranked and from ranked to context, at least 0.
    """
    wide = recalls.groupBy("case_id", "k").pivot("stage", ["raw", "ranked", "context"]).agg(F.first("value"))
    k = F.col("k").cast("string")
    if clipped:
        pairs = (("segment_raw_to_ranked_evidence_loss@", F.greatest(F.col("raw") - F.col("ranked"), F.lit(0.0)), "raw", "ranked"),
                 ("segment_ranked_to_context_evidence_loss@", F.greatest(F.col("ranked") - F.col("context"), F.lit(0.0)), "ranked", "context"))
    else:
        pairs = (("retrieval_stage_delta@", F.col("ranked") - F.col("raw"), "raw", "ranked"),
                 ("context_selection_loss@", F.col("ranked") - F.col("context"), "ranked", "context"))
    out = None
    for name, value, a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        one = wide.select("case_id", "k", F.concat(F.lit(name), k).alias("metric_id"), F.when(both, "observed").otherwise("unavailable").alias("status"), F.when(both, value).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def segment_coverage(gold: DataFrame, items: DataFrame, stages: DataFrame, cutoffs: tuple[int, ...] = SEGMENT_CUTOFFS) -> DataFrame:
    """Segment metrics: gold evidence coverage, whether complete, and the outcome of each (case, stage, k)."""
    out = best_at(paths_at(gold, items, stages, cutoffs), stages, cutoffs, ranks_of_incomplete=False).filter("path IS NOT NULL")
    part = F.when(F.col("observable"), F.col("hits") / F.col("clauses"))
    outcome = F.when(~F.col("observable"), None).when(F.col("complete"), "complete").when(F.col("hits") > 0, "partial_coverage").otherwise("retrieval_missing")
    return out.select("case_id", "stage", "k", part.alias("coverage"), F.when(F.col("observable"), F.col("complete").cast("double")).alias("complete_coverage"), outcome.alias("outcome"), "path")


def segment_metrics(gold: DataFrame, items: DataFrame, stages: DataFrame, cutoffs: tuple[int, ...] = SEGMENT_CUTOFFS) -> DataFrame:
    """All segment metrics of each stage in long form: recall, gold and complete evidence coverage at each cutoff, and the
    reciprocal rank of raw and ranked; (case_id, stage, metric_id, status, value).

    stages: (case_id, stage, status) with the status that trace_status gives; only observed ones have values. One join and
    aggregation serve all cutoffs and the rank.
    """
    s = stages.select("case_id", "stage", "status")
    j = best_at(paths_at(gold, items, s, (*cutoffs, None)), s, (*cutoffs, None), ranks_of_incomplete=False)
    part = F.coalesce(F.col("hits") / F.col("clauses"), F.lit(0.0))
    whole = F.coalesce(F.col("complete"), F.lit(False))
    at = lambda name, value: F.struct(F.concat(F.lit("segment_"), "stage", F.lit(f"_{name}@"), F.col("k").cast("string")).alias("metric_id"), value.alias("value"))
    ranked = F.struct(F.concat(F.lit("segment_"), "stage", F.lit("_mrr")).alias("metric_id"), F.when(whole, 1 / F.col("last_rank")).otherwise(0.0).alias("value"))
    none = F.array().cast("array<struct<metric_id:string,value:double>>")
    metrics = F.when(F.col("k").isNotNull(), F.array(at("recall", part), at("gold_evidence_coverage", part), at("complete_evidence_coverage", whole.cast("double")))).when(F.col("stage").isin("raw", "ranked"), F.array(ranked)).otherwise(none)
    long = j.select("case_id", "stage", "status", F.inline(metrics))
    return long.select("case_id", "stage", "metric_id", "status", F.when(F.col("status") == "observed", F.col("value")).alias("value"))


def clause_matrix(gold: DataFrame, items: DataFrame, stages: DataFrame) -> DataFrame:
    """(case_id, stage, path, clause, alternatives, matched, earliest_rank): every clause at every stage (case_id, stage)."""
    j = ranked_gold(gold, items, stages.select("case_id", "stage"))
    return j.groupBy("case_id", "stage", "path", "clause").agg(
        F.array_sort(F.collect_set("evidence_id")).alias("alternatives"),
        F.array_sort(F.collect_set(F.when(F.col("rank").isNotNull(), F.col("evidence_id")))).alias("matched"),
        F.min("rank").alias("earliest_rank"),
    )


def stage_outcomes(matrix: DataFrame) -> DataFrame:
    """(case_id, stage, complete_paths, outcome) from clause_matrix: the paths of which every clause is matched, and whether
    the stage is complete, covers a part, or misses all."""
    per = matrix.groupBy("case_id", "stage", "path").agg(F.bool_and(F.col("earliest_rank").isNotNull()).alias("whole"), F.count("earliest_rank").alias("hits"))
    out = per.groupBy("case_id", "stage").agg(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("path")))).alias("complete_paths"), F.sum("hits").alias("hits"))
    outcome = F.when(F.size("complete_paths") > 0, "complete").when(F.col("hits") > 0, "partial_coverage").otherwise("retrieval_missing")
    return out.select("case_id", "stage", "complete_paths", outcome.alias("outcome"))


def progress(gold: DataFrame, items: DataFrame, stages: DataFrame, cutoffs: tuple[int, ...] = SEGMENT_CUTOFFS) -> DataFrame:
    """mses_clause_recall@k, mses_path_success@k and mses_path_mrr: the best over paths, without a chosen path."""
    asked, ks = stages.select("case_id", "stage"), (*cutoffs, None)
    paths = paths_at(gold, items, asked, ks).filter("path IS NOT NULL")
    whole = [F.col(f"hits_{i}") == F.col("clauses") for i in range(len(ks))]
    wide = paths.groupBy("case_id", "stage").agg(
        *[F.max(F.col(f"hits_{i}") / F.col("clauses")).alias(f"recall_{i}") for i in range(len(ks))],
        *[F.bool_or(x).cast("double").alias(f"success_{i}") for i, x in enumerate(whole)],
        *[F.min(F.when(x, F.col(f"last_{i}"))).alias(f"rank_{i}") for i, x in enumerate(whole)],
    )
    row = lambda i, k: F.struct(F.lit(k).cast("int").alias("k"), F.col(f"recall_{i}").alias("clause_recall"), F.col(f"success_{i}").alias("path_success"), F.col(f"rank_{i}").alias("rank"))
    per = wide.select("case_id", "stage", F.inline(F.array(*[row(i, k) for i, k in enumerate(ks)])))
    return per.withColumn("path_mrr", F.when(F.col("k").isNull(), F.coalesce(1 / F.col("rank"), F.lit(0.0)))).drop("rank")


#: Localization statuses from best to worst.
LOCALIZED = ("matched", "partial", "provenance_missing", "retrieval_missed")


def localization_counts(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """{stage}_localization_{status} on the chosen path (case_id, stage, path): each clause once, with its best status.

    found: (case_id, stage, path, clause, status) per alternative.
    """
    order = F.array_position(F.array(*map(F.lit, LOCALIZED)), F.col("status"))
    best = found.join(chosen, ["case_id", "stage", "path"]).groupBy("case_id", "stage", "clause").agg(F.min_by("status", order).alias("status"))
    counts = best.groupBy("case_id", "stage").agg(F.count(F.lit(1)).alias("denominator"), *[F.count_if(F.col("status") == s).alias(s) for s in LOCALIZED])
    long = counts.unpivot(["case_id", "stage", "denominator"], list(LOCALIZED), "status", "value")
    name = F.concat("stage", F.lit("_localization_"), F.col("status"))
    return long.select("case_id", "stage", name.alias("metric_id"), F.col("value").cast("bigint").alias("value"), "denominator")


def trace_status(stages: DataFrame) -> DataFrame:
    """What a segment trace counts as, by the first rule that holds.

    stages: (case_id, stage, answer_kind, trace, receipts_differ, unknown_segments, duplicate_chunks, manifest_differs,
    widest_chunk). Null counts and flags are taken as none.
    """
    bad = lambda c: F.coalesce(F.col(c), F.lit(False))
    return stages.withColumn(
        "status",
        F.when(F.col("answer_kind") == "abstain", "not_applicable")
        .when(F.col("trace") == "unsupported_stage", "not_applicable")
        .when(F.col("trace").isin("runtime_error", "mapping_corrupted"), "error")
        .when(bad("receipts_differ") | bad("unknown_segments") | bad("duplicate_chunks") | bad("manifest_differs"), "error")
        .when(F.coalesce(F.col("widest_chunk"), F.lit(0)) > 1, "not_applicable")
        .otherwise("observed"),
    )
