"""Aggregation of metrics whose status stays distinct from zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.sources.scratch import written

#: Statuses of a metric, and their precedence where none is observed.
STATUSES = ("observed", "unavailable", "not_applicable", "error", "needs_review")
PRECEDENCE = ("needs_review", "not_applicable", "error", "unavailable")


def aggregate_metrics(metrics: DataFrame, expected: int | None = None, by: tuple[str, ...] = ("metric_id",)) -> DataFrame:
    """Per metric: mean of observed values, counts of statuses, coverage of what was expected, scoreable cases.

    metrics: (metric_id, status, value, reason?). Without `expected` the coverage is 0.
    """
    n = F.count(F.lit(1))
    observed = F.count_if(F.col("status") == "observed")
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    reason = F.col("reason") if "reason" in metrics.columns else F.lit(None).cast("string")
    per = metrics.groupBy(*by).agg(
        n.alias("n"),
        F.sum(F.when(F.col("status") == "observed", F.col("value"))).alias("numerator"),
        observed.alias("denominator"),
        *counts,
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") != "observed", reason))), " \u00b7 ").alias("reasons"),
    )
    status = F.when(F.col("denominator") > 0, "observed")
    for s in PRECEDENCE:
        status = status.when(F.col(f"n_{s}") > 0, s)
    scoreable = F.col("n") - F.col("n_not_applicable")
    whole = F.lit(expected).cast("bigint")
    return per.select(
        *by,
        status.alias("status"),
        F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")).alias("value"),
        "numerator",
        "denominator",
        F.coalesce(F.col("denominator") / whole, F.lit(0.0)).alias("coverage"),
        scoreable.alias("scoreable_cases"),
        F.when(scoreable > 0, F.col("denominator") / scoreable).otherwise(0.0).alias("scoreable_coverage"),
        F.when(F.col("denominator") > 0, None).otherwise(F.nullif("reasons", F.lit(""))).alias("reason"),
        *[f"n_{s}" for s in STATUSES],
    )


def repetition_stats(metrics: DataFrame) -> DataFrame:
    """Per metric: the means of its repetitions and their population deviation, 0 for a single one."""
    per = metrics.filter("status = 'observed'").groupBy("metric_id", "repetition").agg(F.avg("value").alias("mean"))
    return per.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("repetitions"),
        F.avg("mean").alias("mean_of_means"),
        F.coalesce(F.stddev_pop("mean"), F.lit(0.0)).alias("deviation"),
        F.transform(F.array_sort(F.collect_list(F.struct("repetition", "mean"))), lambda x: x["mean"]).alias("repetition_values"),
    )


def execution_counts(cases: DataFrame, expected: int) -> DataFrame:
    """How many case runs completed and failed, how many of the expected never ran, and the failure rate."""
    counts = cases.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    want = F.lit(expected).cast("bigint")
    return counts.select(
        want.alias("expected"), "total", "completed", "failed",
        F.greatest(F.lit(0).cast("bigint"), want - F.col("total")).alias("not_run"),
        F.when(want > 0, (want - F.col("completed")) / want).otherwise(0.0).alias("failure_rate"),
    )


def micro_macro(counts: DataFrame, by: list[str]) -> DataFrame:
    """Micro (sum of parts over sum of wholes) and macro (mean of the cases' parts) of (value, denominator) rows."""
    return counts.groupBy(*by).agg(
        F.sum("value").alias("numerator"), F.sum("denominator").alias("denominator"), F.count(F.lit(1)).alias("cases"),
        (F.sum("value") / F.sum("denominator")).alias("micro"), F.avg(F.col("value") / F.col("denominator")).alias("macro"),
    )


def histogram(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """One row: how often each of the values occurs."""
    return rows.agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def coverage(slots: DataFrame, axes: list[str], state: str = "state") -> DataFrame:
    """Per axis and category: planned, completed, blocked and missing slots. An axis that is an array counts each entry."""
    out = None
    for axis in axes:
        many = dict(slots.dtypes)[axis].startswith("array")
        one = slots.select(F.lit(axis).alias("axis"), (F.explode(axis) if many else F.col(axis)).alias("category"), F.col(state).alias("state"))
        one = one.withColumn("category", F.col("category").cast("string"))
        out = one if out is None else out.unionByName(one)
    done = F.count_if(F.col("state").isin("approved", "frozen"))
    per = out.groupBy("axis", "category").agg(F.count(F.lit(1)).alias("planned"), done.alias("completed"), F.count_if(F.col("state") == "blocked").alias("blocked"))
    return per.withColumn("missing", F.col("planned") - F.col("completed") - F.col("blocked"))


def coverage_report(slots: DataFrame, axes: list[str], pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """(axis, value, planned, completed, blocked, missing, overrepresented, deficit): what is there of each value of each axis.

    slots: (state, completed) and the axes, an array counts for each different entry; a pair of axes is an axis of its own, its
    values joined by |. missing is what is planned and not completed, blocked or not; overrepresented what is completed beyond the
    plan, where slots are unplanned (planned false). deficit: something is missing or blocked. Null values are left out. One
    scan and one aggregation for all axes: each slot becomes a row for every cell that it counts in.
    """
    kinds = dict(slots.dtypes)
    listed = lambda a: F.col(a).cast("array<string>") if kinds[a].startswith("array") else F.array(F.col(a).cast("string"))
    many = lambda a: F.array_distinct(F.coalesce(listed(a), F.array().cast("array<string>")))
    values = [(a, many(a)) for a in axes]
    crossed = lambda a, b: F.flatten(F.transform(many(a), lambda x: F.transform(many(b), lambda y: F.concat(x, F.lit("|"), y))))
    values += [(f"{a}|{b}", crossed(a, b)) for a, b in pairs]
    tagged = lambda axis, v: F.transform(v, lambda x: F.struct(F.lit(axis).alias("axis"), x.alias("value")))
    cells = F.flatten(F.array(*[tagged(a, v) for a, v in values]))
    planned = F.coalesce("planned", F.lit(True)) if "planned" in kinds else F.lit(True)
    rows = slots.select(F.explode(cells).alias("cell"), "state", F.coalesce("completed", F.lit(False)).alias("completed"), planned.alias("planned")).filter("cell.value IS NOT NULL")
    per = rows.groupBy("cell.axis", "cell.value").agg(F.count_if("planned").alias("planned"), F.count_if("completed").alias("completed"), F.count_if(F.col("state") == "blocked").alias("blocked"))
    short = F.col("planned") - F.col("completed")
    per = per.withColumn("missing", F.greatest(short, F.lit(0).cast("long"))).withColumn("overrepresented", F.greatest(-short, F.lit(0).cast("long")))
    return per.withColumn("deficit", (F.col("missing") > 0) | (F.col("blocked") > 0))


def roll_up(rows: DataFrame) -> DataFrame:
    """Representability per case: full if any in a group is, the worst group, the worst profile. code: 2 full, 1 partial, 0 none."""
    groups = rows.groupBy("case_id", "profile", "evidence_group").agg(F.max("code").alias("code"))
    worst = groups.groupBy("case_id").agg(F.min("code").alias("code"))
    return worst.withColumn("status", F.element_at(F.array(F.lit("UNOBSERVABLE"), F.lit("PARTIAL"), F.lit("FULL")), F.col("code") + 1))


def mapping_coverage(items: DataFrame, by: list[str]) -> DataFrame:
    """by, mapped_items, total_items, unmapped_items, coverage of items with a flag `mapped`."""
    mapped = F.count_if(F.coalesce("mapped", F.lit(False)))
    per = items.groupBy(*by).agg(mapped.alias("mapped_items"), F.count(F.lit(1)).alias("total_items"))
    return per.withColumn("unmapped_items", F.col("total_items") - F.col("mapped_items")).withColumn("coverage", F.coalesce(F.try_divide("mapped_items", "total_items"), F.lit(0.0)))


def evaluation_summary(cases: DataFrame, metrics: DataFrame, items: DataFrame) -> DataFrame:
    """(section, name, n, value): a whole evaluation as rows.

    cases: (case_id, status, labels array); metrics: (case_id, metric_id, status, value); items: (case_id, mapped). Sections:
    cases (all, completed, execution_error), metric_status (counts), metric (observed values and their mean), failure_label
    (counts) and mapping (mapped items, coverage). Only completed cases count beyond the first section. The cases and the counts of
    metrics by status are made once and kept, so that no section repeats the plan of another.
    """
    cases = written(cases.select("case_id", "status", "labels"))
    null = F.lit(None).cast("double")
    done = cases.filter("status = 'completed'").select("case_id")
    m = metrics.join(done, "case_id", "left_semi")
    section = lambda df, name, of, n, value=null: df.select(F.lit(name).alias("section"), of.alias("name"), n.cast("bigint").alias("n"), value.cast("double").alias("value"))
    count = cases.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("status") == "completed").alias("completed"))
    count = count.withColumn("execution_error", F.col("all") - F.col("completed")).unpivot([], ["all", "completed", "execution_error"], "name", "n")
    counted = written(m.groupBy("metric_id", "status").agg(F.count(F.lit(1)).alias("count"), F.count("value").alias("n"), F.avg("value").alias("mean")))
    per_metric = counted.filter("status = 'observed' AND n > 0")
    labels = cases.filter("status = 'completed'").select(F.explode("labels").alias("label")).groupBy("label").count()
    whole = mapping_coverage(items.join(done, "case_id", "left_semi"), [])
    return (
        section(count, "cases", F.col("name"), F.col("n"))
        .unionByName(section(counted.groupBy("status").agg(F.sum("count").alias("count")), "metric_status", F.col("status"), F.col("count")))
        .unionByName(section(per_metric, "metric", F.col("metric_id"), F.col("n"), F.col("mean")))
        .unionByName(section(labels, "failure_label", F.col("label"), F.col("count")))
        .unionByName(section(whole, "mapping", F.lit("mapped_items"), F.col("mapped_items"), F.col("coverage")))
    )
