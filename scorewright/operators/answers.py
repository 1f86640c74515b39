"""Answer scoring by kind, grounding, and failure labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.text import NUMBER_FORMS, canonical_formula, contains_unit, declines, normalize_ascii, numbers, plain, plain_values, unambiguous_statement

PASS, FAIL, REVIEW = "PASS", "FAIL", "NEEDS_REVIEW"


def numeric_verdict(answer: Column, accepted: Column, tolerance: Column, unit: Column) -> Column:
    """No number, or none within the tolerance of an accepted one, fails; others beside it need review; a missing unit fails.

    All texts are given in their normal form.
    """
    found, want = numbers(answer), F.flatten(F.transform(accepted, numbers))
    within = F.coalesce(tolerance, F.lit(0))

    def near(x: Column) -> Column:
        # the finest form that both numbers have decides
        far = lambda y: F.coalesce(*[F.abs(F.try_subtract(x[f], y[f])).cast("double") for f in NUMBER_FORMS])
        exact = lambda y: F.coalesce(*[F.abs(F.try_subtract(x[f], y[f])) <= within for f in NUMBER_FORMS[:-1]], far(y) <= within)
        return F.coalesce(F.exists(want, exact), F.lit(False))

    return (
        F.when((F.size(found) == 0) | (F.size(want) == 0) | ~F.exists(found, near), FAIL)
        .when(F.exists(found, lambda x: ~near(x)), REVIEW)
        .when(unit.isNotNull() & ~contains_unit(answer, unit), FAIL)
        .otherwise(PASS)
    )


def set_verdict(members: Column, want: Column) -> Column:
    """Of normalized values: equal sets pass, more or fewer members fail, others and an empty gold set need review."""
    more, less = F.size(F.array_except(members, want)), F.size(F.array_except(want, members))
    return F.when(F.size(want) == 0, REVIEW).when((more == 0) & (less == 0), PASS).when((more == 0) | (less == 0), FAIL).otherwise(REVIEW)


#: Fixed value: what parts the members of a set in an answer.
MEMBERS_PARTED_BY = "[,;\n、，；]+"


def formula_verdict(answer: Column, accepted: Column) -> Column:
    """Equal canonical forms pass, others need review."""
    return F.when(F.array_contains(F.split(canonical_formula(F.array_join(accepted, "|")), r"\|"), canonical_formula(answer)), PASS).otherwise(REVIEW)


def score_answers(answers: DataFrame, ascii_only: bool = False) -> DataFrame:
    """answers (kind, answer, gold array<string>, accepted array<string>, tolerance, unit) with `verdict`.

    Abstention is decided first; an empty answer fails. Text passes if it is an accepted value or a plain statement of one,
    else it needs review and never fails. Texts are compared in their normal form (NFKC, case-folded, white space as single
    spaces), each normalized once. ascii_only, for texts known to be ASCII, stays inside the JVM: no formulas and statements.
    """
    a, gold = F.coalesce("answer", F.lit("")), F.coalesce("gold", F.array().cast("array<string>"))
    everything = F.array_distinct(F.concat(gold, F.coalesce("accepted", F.array().cast("array<string>"))))
    members = F.split(a, MEMBERS_PARTED_BY)
    if ascii_only:
        one, many = normalize_ascii, lambda values: F.filter(F.transform(values, normalize_ascii), lambda x: x != "")
    else:
        one, many = plain, plain_values
    forms = {"a": one(a), "unit": one(F.col("unit")), "values": many(everything), "members": many(members), "want": many(gold)}
    if not ascii_only:
        forms |= {"statement": unambiguous_statement(a, everything), "formula": formula_verdict(a, everything)}
    # the forms are columns of their own, so that each is computed once
    given = answers.withColumn("forms__", F.struct(*[c.alias(name) for name, c in forms.items()]))
    f = {name: F.col(f"forms__.{name}") for name in forms}
    passes = F.array_contains(f["values"], f["a"])
    verdict = (
        F.when(F.col("kind") == "abstain", F.when(declines(f["a"]), PASS).otherwise(FAIL))
        .when(f["a"] == "", FAIL)
        .when(F.col("kind") == "numeric", numeric_verdict(f["a"], f["values"], F.col("tolerance"), f["unit"]))
        .when(F.col("kind") == "set", set_verdict(f["members"], f["want"]))
        .when(F.col("kind") == "text", F.when(passes if ascii_only else passes | f["statement"], PASS).otherwise(REVIEW))
    )
    if not ascii_only:
        verdict = verdict.when(F.col("kind") == "formula", f["formula"])
    return given.withColumn("verdict", verdict).drop("forms__")


def grounding(cases: DataFrame) -> DataFrame:
    """cases (verdict, context_complete, observability_reason) with groundedness and unsupported_answer_rate.

    The rate is 0 only for a passed answer whose context is complete, otherwise it needs review; it is never 1.
    """
    good = (F.col("verdict") == PASS) & F.col("context_complete")
    status = F.when(F.col("observability_reason").isNotNull(), "unavailable").when(good, "observed").otherwise("needs_review")
    return cases.withColumn("unsupported_status", status).withColumn("unsupported_answer_rate", F.when(status == "observed", 0.0))


def segment_answer_metrics(cases: DataFrame) -> DataFrame:
    """cases (kind, verdict, empty_answer, context_outcome) with accuracy, groundedness and hallucination and their statuses."""
    passed, complete = F.col("verdict") == PASS, F.col("context_outcome") == "complete"
    abstain = F.col("kind") == "abstain"
    accuracy = F.when(passed, 1.0).when(F.col("verdict") == FAIL, 0.0)
    grounded = F.when(abstain, None).when(F.col("context_outcome").isNull(), None).when(passed & complete, 1.0).when(F.col("verdict") == FAIL, 0.0)
    clean = F.when(F.col("empty_answer"), 0.0).when(passed & (complete | abstain), 0.0)
    state = lambda v: F.when(v.isNotNull(), "observed").otherwise("needs_review")
    return (
        cases.withColumn("answer_accuracy", accuracy).withColumn("accuracy_status", state(accuracy))
        .withColumn("answer_groundedness", grounded).withColumn("groundedness_status", F.when(abstain, "not_applicable").otherwise(state(grounded)))
        .withColumn("answer_hallucination", clean).withColumn("hallucination_status", state(clean))
    )


#: The failure labels that this table of a case's stages can give, in their order.
FAILURES = ("timeout", "adapter_error", "provenance_unavailable", "retrieval_missing", "ranking_failure", "context_selection_loss", "generation_failure", "unsupported_answer", "needs_review")


def failure_labels(cases: DataFrame) -> DataFrame:
    """cases with `labels`: what failed, each once.

    Columns: status; for each stage x of raw, ranked, context: x_complete (null where the stage is not observable) and
    x_unknown (evidence whose provenance is missing decides); context_empty, verdict, groundedness. A case that did not
    complete has one label. A stage loses what the one before it had whole.
    """
    is_true = lambda c: F.coalesce(c, F.lit(False))
    seen = {x: F.col(f"{x}_complete").isNotNull() for x in ("raw", "ranked", "context")}
    unknown = {"raw": seen["raw"] & F.col("raw_unknown"), "ranked": seen["raw"] & seen["ranked"] & F.col("ranked_unknown"), "context": seen["ranked"] & seen["context"] & F.col("context_unknown")}
    lost = lambda before, after: seen[before] & seen[after] & ~unknown[after] & F.col(f"{before}_complete") & ~F.col(f"{after}_complete")
    review = ~seen["raw"] | ~seen["ranked"] | ~seen["context"] | unknown["raw"] | unknown["ranked"] | unknown["context"] | (F.col("verdict") == REVIEW)
    found = F.array(
        F.when(is_true(unknown["raw"] | unknown["ranked"] | unknown["context"]), "provenance_unavailable"),
        F.when(is_true(seen["raw"] & ~unknown["raw"] & ~F.col("raw_complete")), "retrieval_missing"),
        F.when(is_true(lost("raw", "ranked")), "ranking_failure"),
        F.when(is_true(lost("ranked", "context")), "context_selection_loss"),
        F.when(is_true(F.col("context_complete") & (F.col("verdict") == FAIL)), "generation_failure"),
        F.when(is_true(F.col("context_empty") & (F.col("groundedness") == 0)), "unsupported_answer"),
        F.when(is_true(review), "needs_review"),
    )
    whole = F.when(F.col("status") == "timeout", F.array(F.lit("timeout"))).when(F.col("status") == "system_error", F.array(F.lit("adapter_error")))
    whole = whole.when(F.col("status").eqNullSafe("completed"), F.array_compact(found)).otherwise(F.array(F.lit("needs_review")))
    return cases.withColumn("labels", whole)


#: Outcomes of a segment stage that are failure labels themselves.
OUTCOME_LABELS = ("retrieval_missing", "partial_coverage", "unsupported_stage", "runtime_error", "mapping_corrupted")


def segment_failure_labels(cases: DataFrame) -> DataFrame:
    """cases with `labels` in the order in which they are found, each once, and `certainty` (unknown where one is for review).

    Columns: raw_outcome, ranked_outcome, context_outcome, and of the answer accuracy, accuracy_status, groundedness_status,
    hallucination, hallucination_status; null statuses are metrics that do not exist.
    """
    on = lambda condition, label: F.when(F.coalesce(condition, F.lit(False)), label)
    whole = lambda stage: F.col(f"{stage}_outcome") == "complete"
    said = [on(F.col(f"{s}_outcome").isin(*OUTCOME_LABELS), F.col(f"{s}_outcome")) for s in ("raw", "ranked", "context")]
    review = F.lit(False)
    for metric in ("hallucination", "accuracy", "groundedness"):
        review = review | F.coalesce(F.col(f"{metric}_status") == REVIEW.lower(), F.lit(False))
    found = F.array(
        *said,
        on(whole("raw") & ~whole("ranked"), "ranking_failure"),
        on(whole("ranked") & ~whole("context"), "context_selection_loss"),
        on(whole("context") & (F.col("accuracy_status") == "observed") & (F.col("accuracy") == 0), "generation_failure"),
        on((F.col("hallucination_status") == "observed") & (F.col("hallucination") == 1), "unsupported_answer"),
        on(review, "needs_review"),
    )
    return cases.withColumn("labels", F.array_distinct(F.array_compact(found))).withColumn("certainty", F.when(review, "unknown").otherwise("deterministic"))


def private_failure_labels(cases: DataFrame) -> DataFrame:
    """cases with sorted `labels` and `certainty`, where absence from a content-only mapping proves nothing.

    Columns: answer_kind, raw_paths, ranked_paths, context_paths (complete paths), unmapped (items of any stage without a
    mapping), accuracy, accuracy_status. An abstention is never judged by what retrieval lacks.
    """
    on = lambda condition, label: F.when(F.coalesce(condition, F.lit(False)), label)
    wrong = (F.col("accuracy_status") == "observed") & (F.col("accuracy") == 0)
    lost = F.when(F.col("raw_paths") == 0, "retrieval_missing").when(F.col("ranked_paths") == 0, "ranking_failure").when(F.col("context_paths") == 0, "context_selection_loss")
    review = (F.col("accuracy_status") == "needs_review") | (F.col("unmapped") > 0)
    answered = F.array(lost, on(wrong, "generation_failure"), on(review, "needs_review"))
    abstained = F.array(on(wrong, "unsupported_answer"), F.lit("needs_review"))
    labels = F.array_sort(F.array_compact(F.when(F.col("answer_kind") == "abstain", abstained).otherwise(answered)))
    return cases.withColumn("labels", labels).withColumn("certainty", F.when(F.array_contains(labels, "needs_review"), "unknown").otherwise("deterministic"))


def capability_faults(stages: DataFrame) -> DataFrame:
    """Stages (declared, required, returned) where what is declared and what is returned differ."""
    fault = F.when(F.col("declared") & F.col("required") & ~F.col("returned"), "declared_but_missing").when(~F.col("declared") & F.col("returned"), "returned_but_not_declared")
    return stages.withColumn("fault", fault).filter("fault IS NOT NULL")


def expected_metrics(cases: DataFrame, metric_ids: list[str], metrics: DataFrame) -> DataFrame:
    """Every (case, metric) that is expected, with its row in metrics or an error."""
    ids = F.array(*map(F.lit, metric_ids))
    asked = cases.select("case_id", F.explode(ids).alias("metric_id"))
    j = asked.join(metrics, ["case_id", "metric_id"], "left")
    return j.withColumn("status", F.coalesce("status", F.lit("error")))
