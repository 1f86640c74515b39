"""The named rules of a dataset release: violations as rows, and a report with one row per rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.text import squeeze, squeezed_values, word_set
from scorewright.operators.dedup import similar_sets
from scorewright.operators.validate import cycles

#: The rules in the order of the report.
RULES = (
    "canonical.schema_relation_integrity", "case_gold.revision_integrity", "canonical.object_span_provenance", "document.revision_digest_consistency",
    "cross_reference.integrity", "gold.evidence_reachability", "integrity.checksums", "case_gold.release_lifecycle", "gold.mses_completeness",
    "gold.answer_evidence_consistency", "gold.negative_unanswerable_scope", "gold.multi_hop_dependency", "case.duplicate_near_miss", "case.answer_leakage",
    "gold.ambiguity", "ledger.review_approval_integrity", "bundle_v2.projection_lossiness",
)
#: The rules that need the canonical document.
OF_CANONICAL = RULES[2:7]
#: Lifecycle states that cannot be released, and digests that must agree between revision and manifest.
UNRELEASED = ("draft", "proposed", "rejected", "invalidated", "superseded")
DIGESTS = ("source_digest", "canonical_digest", "configuration_digest", "parser_identity", "canonicalizer_identity")
#: Roles of evidence that the older bundle cannot hold.
NOT_IN_BUNDLE = ("supporting", "conflicting", "near_miss")
#: Similarity of the word sets of two questions from which they are near misses.
NEAR = 0.90


def _rows(df: DataFrame, rule: str, key: str, when: Column | None = None, severity: str = "error") -> DataFrame:
    kept = df if when is None else df.filter(F.coalesce(when, F.lit(False)))
    return kept.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(key).cast("string").alias("affected_id"))


def violations(
    objects: DataFrame, relations: DataFrame, documents: DataFrame, cases: DataFrame, gold: DataFrame, evidence: DataFrame, dependencies: DataFrame, reviews: DataFrame, approvals: DataFrame, expected: str | None = None
) -> DataFrame:
    """(rule_id, severity, affected_id), each once: what breaks a rule.

    objects: (object_id, representation, n_spans, source_sha256, eligible); relations: (relation_id, source_id, target_id);
    documents: (document_id, revision_* and manifest_* of DIGESTS, dataset_source, file_sha256); cases: (case_id,
    case_revision_id, question, object_ids array, lifecycle, actor); gold: (gold_id, case_id, case_revision_id, answer_kind,
    answers and accepted array, paths array of arrays of arrays, negative_scope array, negative_rationale, lifecycle, actor);
    evidence: (gold_id, evidence_id, object_id, role, rationale); dependencies: (gold_id, dependency_id, depends_on);
    reviews and approvals: (record_id, identity), record_id being a case or gold id that any revision of its lineage has.
    """
    known = objects.select("object_id", "eligible")
    ids = known.select("object_id").distinct()
    abstains = F.col("answer_kind") == "abstain"
    same = lambda f: F.col(f"revision_{f}").eqNullSafe(F.col(f"manifest_{f}"))
    consistent = reduce(lambda a, b: a & b, [same(f) for f in DIGESTS]) & F.col("dataset_source").eqNullSafe(F.col("manifest_source_digest"))
    ends = relations.select("relation_id", F.explode(F.array("source_id", "target_id")).alias("object_id"))
    records = cases.select(F.col("case_id").alias("record_id"), "lifecycle", "actor").unionByName(gold.select(F.col("gold_id").alias("record_id"), "lifecycle", "actor"))
    used = cases.select(F.explode("object_ids").alias("object_id"))
    lineage = gold.select("gold_id", "case_id", "case_revision_id").join(cases.select("case_id", F.col("case_revision_id").alias("selected")), "case_id", "full_outer")
    unreachable = evidence.join(known, "object_id", "left").filter(~F.coalesce("eligible", F.lit(False)))

    # alternatives against the required evidence of their gold, cited negative evidence against the scope
    per_gold = evidence.groupBy("gold_id").agg(
        F.collect_set(F.when(F.col("role") == "required", F.col("evidence_id"))).alias("required"),
        F.collect_set(F.when(F.col("role") == "negative_scope", F.col("object_id"))).alias("negative"),
        F.bool_or((F.col("role") == "conflicting") & (F.coalesce("rationale", F.lit("")) == "")).alias("unresolved"),
        F.bool_or(F.col("role").isin(*NOT_IN_BUNDLE)).alias("other_roles"),
    )
    linked = dependencies.select("gold_id", F.lit(True).alias("linked")).distinct()
    full = gold.join(per_gold, "gold_id", "left").join(linked, "gold_id", "left")
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    none = F.array().cast("array<string>")
    alternatives = F.flatten(F.flatten(F.coalesce("paths", F.array().cast("array<array<array<string>>>"))))
    disagree = F.size(F.array_except(alternatives, F.coalesce("required", none))) > 0
    scope = F.coalesce("negative_scope", none)
    incomplete = (size(scope) == 0) | (F.coalesce("negative_rationale", F.lit("")) == "") | (F.size(F.array_except(scope, F.coalesce("negative", none))) > 0)
    lossy = (
        (size("paths") > 1) | F.exists("paths", lambda p: F.exists(p, lambda c: F.size(c) > 1)) | (size(scope) > 1) | F.coalesce("other_roles", F.lit(False)) | F.col("linked").isNotNull()
    )
    folded = F.transform(F.coalesce("accepted", none), F.lower)

    questions = cases.select("case_id", squeeze(F.col("question")).alias("q"))
    copies = questions.join(questions.groupBy("q").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "q", "left_semi")
    near = similar_sets(cases.select(F.col("case_id").alias("id"), word_set(F.col("question")).alias("tokens")), NEAR)
    near = near.select(F.explode(F.array("a", "b")).alias("case_id")).distinct()
    asked = gold.filter(~abstains).join(questions, "case_id").withColumn("said", squeezed_values(F.col("answers")))
    leak = F.exists("said", lambda a: (F.char_length(a) >= 3) & F.contains("q", a))

    per_approval = approvals.groupBy("record_id").agg(F.collect_set("identity").alias("approvers"))
    judged = records.join(per_approval, "record_id", "left").join(reviews.select("record_id", F.lit(True).alias("reviewed")).distinct(), "record_id", "left")
    unjudged = F.col("approvers").isNull() | F.array_contains("approvers", F.col("actor")) | F.col("reviewed").isNull()
    node = lambda c: F.concat_ws("/", F.col("gold_id").cast("string"), F.col(c).cast("string"))
    circular = cycles(dependencies.select(node("dependency_id").alias("source"), node("depends_on").alias("target")))
    circular = circular.select(F.substring_index("node", "/", 1).alias("gold_id"))

    found = [
        _rows(ends.join(ids, "object_id", "left_anti"), RULES[0], "relation_id"),
        _rows(cases.groupBy("case_revision_id").count(), RULES[1], "case_revision_id", F.col("count") > 1),
        _rows(gold.groupBy("gold_id").count(), RULES[1], "gold_id", F.col("count") > 1),
        _rows(objects, RULES[2], "object_id", (F.col("representation") != "missing") & ((F.col("n_spans") == 0) | F.col("source_sha256").isNull())),
        _rows(documents, RULES[3], "document_id", ~consistent),
        _rows(used.join(ids, "object_id", "left_anti"), RULES[4], "object_id"),
        _rows(lineage.withColumn("affected", F.coalesce(F.col("gold_id").cast("string"), F.col("case_id").cast("string"))), RULES[4], "affected", ~F.col("case_revision_id").eqNullSafe(F.col("selected"))),
        _rows(unreachable, RULES[5], "object_id"),
        _rows(documents, RULES[6], "document_id", ~F.col("file_sha256").eqNullSafe(F.col("dataset_source"))),
        _rows(records, RULES[7], "record_id", F.col("lifecycle").isin(*UNRELEASED) | (F.lit(False) if expected is None else F.col("lifecycle") != expected)),
        _rows(gold, RULES[8], "gold_id", ~abstains & ((size("paths") == 0) | F.exists("paths", lambda p: F.size(p) == 0))),
        _rows(full, RULES[9], "gold_id", (~abstains & (size("required") == 0)) | disagree),
        _rows(full, RULES[10], "gold_id", F.when(abstains, incomplete).otherwise(size(scope) > 0)),
        _rows(circular, RULES[11], "gold_id"),
        _rows(copies, RULES[12], "case_id"),
        _rows(near.join(copies.select("case_id"), "case_id", "left_anti"), RULES[12], "case_id", severity="warn"),
        _rows(asked, RULES[13], "case_id", leak),
        _rows(gold, RULES[14], "gold_id", F.size(F.array_distinct(folded)) < F.size(folded)),
        _rows(full.filter(F.size(F.array_distinct(folded)) == F.size(folded)), RULES[14], "gold_id", F.col("unresolved"), "warn"),
        _rows(judged, RULES[15], "record_id", unjudged),
        _rows(full, RULES[16], "gold_id", lossy, "warn"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def report(found: DataFrame, has_canonical: bool = True) -> DataFrame:
    """(rule_id, result, severity, n_affected) of each of RULES, from violations; warnings count where a rule has no error."""
    spark = found.sparkSession
    rules = spark.range(1).select(F.explode(F.array(*map(F.lit, RULES))).alias("rule_id"))
    per = found.groupBy("rule_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    j = rules.join(F.broadcast(per), "rule_id", "left").fillna(0, ["errors", "warnings"])  # at most a row for each rule
    absent = F.lit(not has_canonical) & F.col("rule_id").isin(*OF_CANONICAL)
    some = F.col("errors") + F.col("warnings") > 0
    quiet = F.when(F.col("rule_id") == RULES[16], "info").otherwise("error")
    return j.select(
        "rule_id", F.when(absent, "NOT_APPLICABLE").when(some, "FAIL").otherwise("PASS").alias("result"),
        F.when(absent | (F.col("errors") > 0), "error").when(some, "warn").otherwise(quiet).alias("severity"),
        F.when(absent, 0).when(F.col("errors") > 0, F.col("errors")).otherwise(F.col("warnings")).cast("bigint").alias("n_affected"),
    )
