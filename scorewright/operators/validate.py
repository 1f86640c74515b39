"""Rules as queries: each gives its violations as (rule_id, severity, affected_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.text import squeeze


def _as(df: DataFrame, rule: str, severity: str, key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(key).cast("string").alias("affected_id"))


def unique_key(df: DataFrame, key: str, rule: str = "unique_key", severity: str = "error") -> DataFrame:
    return _as(df.groupBy(key).count().filter("count > 1"), rule, severity, key)


def known_reference(df: DataFrame, column: str, key: str, known: DataFrame, known_key: str, rule: str, severity: str = "error") -> DataFrame:
    """Rows of df whose reference is not null and not in known."""
    ids = known.select(F.col(known_key).alias(column)).distinct()
    return _as(df.filter(F.col(column).isNotNull()).join(ids, column, "left_anti"), rule, severity, key)


def predicate(df: DataFrame, holds: Column, key: str, rule: str, severity: str = "error") -> DataFrame:
    """Rows for which a condition does not hold (null is not)."""
    return _as(df.filter(~F.coalesce(holds, F.lit(False))), rule, severity, key)


def answer_leakage(questions: DataFrame, key: str = "case_id", least: int = 3) -> DataFrame:
    """Questions whose answer, without white space and case, is part of them."""
    q, a = squeeze(F.col("question")), squeeze(F.col("answer"))
    return _as(questions.filter((F.char_length(a) >= least) & F.contains(q, a)), "answer_leakage", "error", key)


def parity(a: DataFrame, b: DataFrame, key: str, columns: list[str], rule: str) -> DataFrame:
    """Keys on which two views of a table differ."""
    from scorewright.operators.compare import table_diff

    return _as(table_diff(a, b, [key], columns), rule, "error", key)


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes of edges (source, target) that lie on or lead to a cycle: what is left when nodes without an edge are removed, round
    after round, until nothing changes. Each round is a semi-join; the state is written to the shared folder."""
    left = edges.select("source", "target").distinct().checkpoint()
    n = left.count()
    while n:
        left = left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target").checkpoint()
        before, n = n, left.count()
        if n == before:
            break
    return left.select(F.col("source").alias("node")).distinct()


def endpoint_types(relations: DataFrame, objects: DataFrame, allowed: list[tuple[str, str, str]]) -> DataFrame:
    """Relations (relation_id, kind, source_id, target_id) whose kind does not allow the types of its ends."""
    o = objects.select("object_id", "object_type")
    j = relations.join(o.toDF("source_id", "source_type"), "source_id", "left").join(o.toDF("target_id", "target_type"), "target_id", "left")
    rules = F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("source_type"), F.lit(c).alias("target_type")) for a, b, c in allowed])
    return _as(j.filter(~F.coalesce(F.array_contains(rules, F.struct("kind", "source_type", "target_type")), F.lit(False))), "endpoint_types", "error", "relation_id")


def packed_once(segments: DataFrame, batches: DataFrame) -> DataFrame:
    """Segments (segment_id, document_id) that are not in exactly one batch (batch_id, segment_ids), and batches over several documents."""
    rows = batches.select("batch_id", F.explode("segment_ids").alias("segment_id"))
    n = segments.join(rows.groupBy("segment_id").count(), "segment_id", "left").filter("coalesce(count, 0) <> 1")
    docs = rows.join(segments, "segment_id").groupBy("batch_id").agg(F.count_distinct("document_id").alias("n")).filter("n > 1")
    return _as(n, "packed_once", "error", "segment_id").union(_as(docs, "batch_of_one_document", "error", "batch_id"))


def gates(findings: list[DataFrame]) -> DataFrame:
    """All findings together."""
    return reduce(DataFrame.unionByName, findings)


def lossiness(bundles: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """bundles with the reasons for which a form of less content loses something, and whether there are any."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for name, when in rules.items()]))
    return bundles.withColumn("reasons", reasons).withColumn("lossy", F.size("reasons") > 0)


def clause_necessity(required: DataFrame, used: DataFrame) -> DataFrame:
    """Cases whose required evidence ids and those in their clauses (case_id, evidence_id) are not the same set."""
    a = required.select("case_id", "evidence_id").distinct().withColumn("r", F.lit(1))
    b = used.select("case_id", "evidence_id").distinct().withColumn("u", F.lit(1))
    odd = a.join(b, ["case_id", "evidence_id"], "full_outer").filter("r IS NULL OR u IS NULL").select("case_id").distinct()
    return _as(odd, "clause_necessity", "error", "case_id")
