"""Comparing runs: paired bootstrap, drift, replay, differences, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: The most cases that are broadcast.
BROADCAST_CASES = 2_000_000


def paired_deltas(scores: DataFrame, base: str, treatment: str) -> DataFrame:
    """(case_id, delta): the mean over matched seeds of treatment - base. scores: (case_id, seed, system, value).

    A case or seed that one system lacks, or has twice, is an error.
    """
    wide = scores.groupBy("case_id", "seed").agg(
        *[F.count_if(F.col("system") == s).alias(f"n_{name}") for s, name in ((base, "base"), (treatment, "treatment"))],
        *[F.max(F.when(F.col("system") == s, F.col("value"))).alias(name) for s, name in ((base, "base"), (treatment, "treatment"))],
    )
    fine = (F.col("n_base") == 1) & (F.col("n_treatment") == 1)
    delta = F.when(fine, F.col("treatment") - F.col("base")).otherwise(F.raise_error(F.lit("cases and seeds of the two systems do not match")).cast("double"))
    per = wide.select("case_id", "seed", delta.alias("delta")).groupBy("case_id")
    return per.agg(F.avg("delta").alias("delta"), F.count(F.lit(1)).alias("seeds"))


def clustered_bootstrap(deltas: DataFrame, iterations: int = 10000, seed: int = 1) -> DataFrame:
    """stratified_bootstrap with all cases in one stratum, named all. deltas: (case_id, delta)."""
    return stratified_bootstrap(deltas.withColumn("stratum", F.lit("all")), iterations, seed)


def stratified_bootstrap(deltas: DataFrame, iterations: int = 10000, seed: int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: n_cases, estimate, low, high (2.5 and 97.5 per cent) of the weighted mean delta, resampling cases within strata.

    deltas: (case_id, stratum, delta). The weight of a stratum is its part of the cases, or weights by stratum, which must
    name all of them. Draw `slot` of an iteration takes, of the stratum's cases by their order, the one whose number is 60
    bits of the MD5 of seed:iteration:stratum:slot modulo their count: any case, however many, and the same in any engine.
    Up to BROADCAST_CASES cases are sent to the tasks, which draw whole iterations and shuffle only sums; beyond, draws are shuffled.
    """
    rows = deltas.select("case_id", F.col("stratum").cast("string").alias("stratum"), "delta").checkpoint()  # read several times
    cases = rows.count()
    # a given number of partitions, which adaptive execution leaves as it is in every branch that reads them
    parts = int(deltas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "stratum", "case_id").sortWithinPartitions("stratum", "case_id").withColumn("part", F.spark_partition_id()).checkpoint()
    local = ordered.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("stratum", "case_id")) - 1)
    parts = local.groupBy("part", "stratum").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("first"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("stratum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", "stratum", (before - F.col("first")).alias("shift"))
    numbered = local.join(offsets, ["part", "stratum"]).select("stratum", (F.col("k") + F.col("shift")).alias("case_no"), "delta")
    strata = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"))
    if weights is None:
        share = F.col("n") / cases
    else:
        names = {x.stratum for x in strata.select("stratum").collect()}  # few: the caller lists them
        if names != set(weights) or sum(weights.values()) <= 0:
            raise ValueError("weights must name all strata and have a positive sum")
        given = F.create_map(*[F.lit(v) for k, w in weights.items() for v in (k, float(w))])
        share = F.element_at(given, F.col("stratum")) / sum(weights.values())
    strata = strata.withColumn("weight", share)
    slots = numbered.select("stratum", F.col("case_no").alias("slot")).join(F.broadcast(strata.select("stratum", "n")), "stratum")
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "iteration", "stratum", "slot").cast("binary")), 1, 15), 16, 10).cast("bigint")
    number = F.pmod(bits, F.col("n"))
    if cases <= BROADCAST_CASES:  # iterations are dealt out, and each meets all cases where it is
        tasks = max(1, min(iterations, deltas.sparkSession.sparkContext.defaultParallelism * 8))
        draws = deltas.sparkSession.range(0, iterations, 1, tasks).withColumnRenamed("id", "iteration").crossJoin(F.broadcast(slots))
        drawn = draws.select("stratum", "iteration", number.alias("case_no")).join(F.broadcast(numbered), ["stratum", "case_no"])
        means = drawn.groupBy("iteration", "stratum").agg(F.sum("delta").alias("total"))
    else:
        draws = slots.crossJoin(F.broadcast(deltas.sparkSession.range(iterations).withColumnRenamed("id", "iteration")))
        drawn = draws.select("stratum", "iteration", number.alias("case_no")).groupBy("stratum", "case_no", "iteration").agg(F.count(F.lit(1)).alias("times"))
        means = drawn.join(numbered, ["stratum", "case_no"]).groupBy("iteration", "stratum").agg(F.sum(F.col("times") * F.col("delta")).alias("total"))
    means = means.join(strata, "stratum").groupBy("iteration").agg(F.sum(F.col("weight") * F.col("total") / F.col("n")).alias("mean"))
    ends = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return strata.agg(F.sum("n").alias("n_cases"), F.sum(F.col("weight") * F.col("mean")).alias("estimate")).crossJoin(ends)


def table_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, change (added, removed, changed) and the names of the differing fields."""
    a = old.select(*keys, F.struct(*values).alias("old"), F.lit(True).alias("in_old"))
    b = new.select(*keys, F.struct(*values).alias("new"), F.lit(True).alias("in_new"))
    j = a.join(b, keys, "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"old.{v}").eqNullSafe(F.col(f"new.{v}")), F.lit(v)) for v in values]))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.size(fields) > 0, "changed")
    return j.select(*keys, change.alias("change"), F.when(change == "changed", fields).otherwise(F.array().cast("array<string>")).alias("fields")).filter("change IS NOT NULL")


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Paths (path, sha256) that are missing, unexpected or mismatched."""
    j = expected.select("path", F.col("sha256").alias("want")).join(actual.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    fault = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "mismatched")
    return j.select("path", fault.alias("fault")).filter("fault IS NOT NULL")


def config_drift(a: DataFrame, b: DataFrame, treatment_prefixes: list[str]) -> DataFrame:
    """Paths (path, value) on which two flat configurations differ, but for those under a treatment factor."""
    j = a.select("path", F.col("value").alias("a")).join(b.select("path", F.col("value").alias("b")), "path", "full_outer")
    allowed = F.lit(False)
    for p in treatment_prefixes:
        allowed = allowed | (F.col("path") == p) | F.startswith("path", F.lit(f"{p}."))
    return j.filter(~F.col("a").eqNullSafe(F.col("b")) & ~allowed)


def incompatible_fields(runs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_values) of the fields on which runs that should agree do not."""
    wide = runs.agg(*[F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))).alias(f) for f in fields])
    return wide.unpivot([], fields, "field", "n_values").filter("n_values > 1")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["object_id", "chunk_id", "coverage", "start", "end"])


def first_wins(primary: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """Rows of both tables, one per key, whatever their types: a primary one if there is one."""
    both = primary.withColumn("is_primary", F.lit(1)).unionByName(archive.withColumn("is_primary", F.lit(0)))
    rest = [c for c in both.columns if c not in (key, "is_primary")]
    picked = both.groupBy(key).agg(F.max_by(F.struct(*rest), "is_primary").alias("row"))
    return picked.select(key, *[F.col(f"row.{c}").alias(c) for c in rest])
