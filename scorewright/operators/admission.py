"""Named rules of admission: of sources, of cases with their gold, and of a candidate's gates.

Each report has one row per subject and rule: (subject, rule_id, severity, result, affected). Every detail table is first
reduced to a row per subject, so that the reports are joins of tables that are already partitioned by the subject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.text import plain, squeezed_together, tokens
from scorewright.operators.dedup import open_overlap
from scorewright.sources.scratch import written

PASS, FAIL, HUMAN, NA = "PASS", "FAIL", "HUMAN_REVIEW_REQUIRED", "NOT_APPLICABLE"
#: What a comparison of two texts can be found to be.
DUPLICATES, UNDETERMINED = ("exact_duplicate", "near_duplicate"), "undetermined"
#: Roles of evidence that raise the risk of a case.
RISKY_ROLES = ("conflicting", "negative_scope")

_none = lambda: F.array().cast("array<string>")
_yes = lambda c: F.coalesce(c, F.lit(False))
_list = lambda c: F.coalesce(F.array_sort(F.array_distinct(c)), _none())


def _which(when: Column, what: Column) -> Column:
    """The different values of `what` in the rows of a group for which a condition holds."""
    return F.collect_set(F.when(_yes(when), what.cast("string")))


def _finding(rule: str, severity: Column | str, result: Column, affected: Column | None = None) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(rule).alias("rule_id"), as_column(severity).alias("severity"), result.alias("result"), (_none() if affected is None else _list(affected)).alias("affected"))


def _verdict(holds: Column) -> Column:
    return F.when(_yes(holds), PASS).otherwise(FAIL)


def _severity(result: Column) -> Column:
    """What a result weighs: an open review is for humans, an inapplicable rule information."""
    return F.when(result == HUMAN, "human_review").when(result == NA, "info").otherwise("error")


def _report(rows: DataFrame, subject: str, findings: list[Column]) -> DataFrame:
    """A row for each finding; they are made by a projection, as a generator would evaluate them one by one without
    code of their own; inline_outer, as the filter against empty lists would make them, and call Python, a second time."""
    return rows.select(F.col(subject).alias("subject"), F.array(*findings).alias("findings")).select("subject", F.inline_outer("findings"))


def _told(rows: DataFrame, flags: dict[str, Column] | None = None, **values: tuple[Column, Column]) -> DataFrame:
    """(case_id, tag, value): of each row the values whose condition holds, and the flags that do, with null values."""
    each = [(tag, when, F.lit(None)) for tag, when in (flags or {}).items()] + [(tag, when & what.isNotNull(), what) for tag, (when, what) in values.items()]
    tell = [F.struct(F.when(_yes(when), tag).alias("tag"), what.cast("string").alias("value")) for tag, when, what in each]
    return rows.select("case_id", F.inline(F.array(*tell))).filter("tag IS NOT NULL")


def source_admission(sources: DataFrame, similarity: DataFrame, families: DataFrame) -> DataFrame:
    """The four findings of each source.

    sources: (source_id, family_id, registered_family_id, family_class, independent_test, parsing, structure, locators, admission);
    similarity: (source_id, family_id, document_id, disposition) of compared documents; families: (family_id) of development.
    An independent-test source must have been compared with each of these families, a list of some thousands at most.
    """
    known = families.select(F.col("family_id").cast("string").alias("family_id")).distinct()
    near = similarity.withColumn("family_id", F.col("family_id").cast("string")).join(known, "family_id", "left_semi")
    per = near.groupBy("source_id").agg(
        F.collect_set("family_id").alias("compared"),
        _which(F.col("disposition").isin(*DUPLICATES), F.col("document_id")).alias("bad"),
        _which(F.col("disposition") == UNDETERMINED, F.col("document_id")).alias("open"),
    )
    every = known.agg(F.collect_set("family_id").alias("families"))
    rows = sources.join(per, "source_id", "left").crossJoin(every)
    complete = reduce(lambda a, b: a & b, [F.col(c) == "complete" for c in ("parsing", "structure", "locators")])
    test = _yes(F.col("independent_test"))
    family = F.col("family_id").eqNullSafe(F.col("registered_family_id")) & (~test | (F.col("family_class") == "held_out"))
    missing = F.when(test, F.array_except("families", F.coalesce("compared", _none()))).otherwise(_none())
    bad, unknown = F.coalesce("bad", _none()), F.coalesce("open", _none())
    isolated = F.when((F.size(missing) > 0) | (F.size(bad) > 0), FAIL).when(F.size(unknown) > 0, HUMAN).otherwise(PASS)
    return _report(rows, "source_id", [
        _finding("source.parse_structure_locator", "error", _verdict(complete), F.array(F.col("source_id").cast("string"))),
        _finding("source.family_classification", "error", _verdict(family), F.array(F.col("family_id").cast("string"))),
        _finding("source.family_isolation_and_similarity", _severity(isolated), isolated, F.concat(missing, bad, unknown)),
        _finding("source.admission_status", "error", F.when(_yes(F.col("admission") == "admitted"), PASS).otherwise(HUMAN), F.array(F.col("source_id").cast("string"))),
    ])


def case_admission(cases: DataFrame, evidence: DataFrame, sources: DataFrame, scope: DataFrame, objects: DataFrame, clauses: DataFrame, checks: DataFrame, comparisons: DataFrame, reviews: DataFrame, assistance: DataFrame) -> DataFrame:
    """The eleven findings of each case.

    cases: (case_id, gold_case_id, usage, source_eligible, source_admitted, source_matches, has_scope, scope_matches, lineage,
    multi_hop, dependencies, generated, risky_source, structured, paths, question, answer_kind, answers array, negative_scope
    array, negative_rationale, actors array), actors being who wrote case and gold; evidence: (case_id, object_id, role); sources:
    (case_id, object_id), the case's own objects; scope: (case_id, object_id), the objects that its scope lists; objects:
    (object_id, eligible); clauses and checks: (case_id, path, clause, alternatives array), checks with `necessary`, null while
    it is undetermined; comparisons: (case_id, other_id, usage, disposition); reviews: (case_id, reviewer, complete), independent
    if the reviewer is none of the actors; assistance: (case_id, assistance_id, of_case_id, proposal_only). A scope must hold
    all source and evidence objects, and none that is unknown or not eligible, cited or not.
    """
    key = lambda df: df.withColumn("alternatives", F.sort_array("alternatives"))
    name, object_id, always = F.concat_ws("/", "path", "clause"), F.col("object_id"), F.lit(True)
    known = objects.select("object_id", "eligible", F.lit(True).alias("known"))
    unusable = ~(_yes(F.col("known")) & _yes(F.col("eligible")))
    negative = F.col("role") == "negative_scope"
    needed = evidence.select("case_id", "object_id").union(sources.select("case_id", "object_id")).distinct()
    exact = ["case_id", "path", "clause", "alternatives"]
    sound = F.col("of_case_id").eqNullSafe(F.col("case_id")) & _yes(F.col("proposal_only"))
    told = reduce(DataFrame.unionByName, [
        _told(evidence.join(known, "object_id", "left"), {"risky_roles": F.col("role").isin(*RISKY_ROLES)}, unreachable=(unusable, object_id), negative=(negative, object_id), usable_negative=(negative & ~unusable, object_id)),
        _told(needed.join(scope, ["case_id", "object_id"], "left_anti"), unscoped=(always, object_id)),
        _told(scope.join(known, "object_id", "left").filter(unusable), unsafe=(always, object_id)),
        _told(key(clauses).join(key(checks), exact, "left_anti"), unchecked=(always, name)),
        _told(checks, redundant=(F.col("necessary") == False, name), undecided=(F.col("necessary").isNull(), name)),  # noqa: E712
        _told(comparisons, {"met_development": F.col("usage") == "development"}, duplicates=(F.col("disposition").isin(*DUPLICATES), F.col("other_id")), unresolved=(F.col("disposition") == UNDETERMINED, F.col("other_id"))),
        _told(reviews.filter("complete"), reviewers=(always, F.col("reviewer"))),
        _told(assistance, {"helped": always}, malformed=(~sound, F.col("assistance_id"))),
    ])
    per = told.groupBy("case_id").agg(F.collect_set(F.struct("tag", "value")).alias("told"))
    of = lambda tag: F.filter("told", lambda x: x["tag"] == tag)["value"]
    tags = ("risky_roles", "unreachable", "negative", "usable_negative", "unscoped", "unsafe", "unchecked", "redundant", "undecided", "met_development", "duplicates", "unresolved", "reviewers", "helped", "malformed")
    rows = cases.withColumnRenamed("usage", "slot_usage").join(per, "case_id", "left").withColumns({tag: F.coalesce(of(tag), _none()) for tag in tags})
    rows = rows.transform(squeezed_together({"q": F.col("question")}, {"said": F.col("answers")}))

    ids = F.array(F.col("case_id").cast("string"))
    some = lambda c: F.size(F.col(c)) > 0
    abstains = F.col("answer_kind") == "abstain"
    held_out = _yes(F.col("slot_usage") == "held_out")
    scope = F.when(~_yes(F.col("has_scope")), NA).otherwise(_verdict(F.col("scope_matches") & ~some("unscoped") & ~some("unsafe")))
    admitted = _yes(F.col("source_admitted"))
    bound = F.when(held_out, admitted & _yes(F.col("source_eligible"))).otherwise(admitted | (scope == PASS))
    minimal = F.when(some("unchecked") | some("redundant"), FAIL).when(some("undecided"), HUMAN).otherwise(PASS)
    want = F.coalesce(F.col("negative_scope").cast("array<string>"), _none())
    negative = (F.size(want) > 0) & (F.size(F.array_except(want, "usable_negative")) == 0) & (F.col("negative_rationale") != "")
    leaks = F.exists("said", lambda a: (F.char_length(a) >= 3) & F.contains("q", a))
    leaked = F.when(abstains, NA).otherwise(_verdict(~_yes(leaks)))
    similar = F.when(some("duplicates"), FAIL).when(held_out & ~some("met_development"), HUMAN).when(some("unresolved"), HUMAN).otherwise(PASS)
    who = F.when(some("duplicates"), F.col("duplicates")).when(similar == HUMAN, F.when(held_out & ~some("met_development"), _none()).otherwise(F.col("unresolved")))
    reviewers = F.size(F.array_except("reviewers", F.coalesce(F.col("actors").cast("array<string>"), _none())))
    unhelped = _yes(F.col("generated")) & (~some("helped") | (reviewers == 0))
    proposal = F.when(some("malformed"), FAIL).when(unhelped, HUMAN).otherwise(PASS)
    risk = _yes(F.col("multi_hop")) | _yes(F.col("structured")) | _yes(F.col("risky_source")) | (F.col("paths") > 1) | some("risky_roles")
    reviewed = F.when(reviewers < F.when(_yes(risk), 2).otherwise(1), HUMAN).otherwise(PASS)
    return _report(rows, "case_id", [
        _finding("case.source_and_slot_binding", "error", _verdict(bound & F.col("source_matches")), ids),
        _finding("case.reliable_canonical_evidence_scope", _severity(scope), scope, F.when(scope == FAIL, F.concat("unscoped", "unsafe"))),
        _finding("case.gold_lineage", "error", _verdict(F.col("lineage") & (F.col("gold_case_id") == F.col("case_id"))), ids),
        _finding("gold.evidence_reachability", "error", _verdict(~some("unreachable")), F.col("unreachable")),
        _finding("gold.mses_minimality", _severity(minimal), minimal, F.when(minimal == FAIL, F.concat("unchecked", "redundant")).otherwise(F.col("undecided"))),
        _finding("gold.negative_scope", F.when(abstains, "error").otherwise("info"), F.when(abstains, _verdict(negative)).otherwise(NA), F.when(abstains, F.array_except(want, "negative"))),
        _finding("gold.multi_hop_dependency", "error", _verdict(~_yes(F.col("multi_hop")) | (F.col("dependencies") > 0)), ids),
        _finding("case.answer_leakage", _severity(leaked), leaked, ids),
        _finding("case.duplicate_and_contamination", _severity(similar), similar, who),
        _finding("model.output_proposal_only", _severity(proposal), proposal, F.col("malformed")),
        _finding("review.independent_admission_checklist", _severity(reviewed), reviewed, ids),
    ])


#: Similarity of questions from which a candidate fails, and from which it is flagged.
OVERLAP_FAIL, OVERLAP_FLAG = 0.98, 0.75
#: States in which a candidate is history and no proposal that others are compared with.
CLOSED_STATES = ("rejected", "blocked")


def candidate_gates(candidates: DataFrame, evidence: DataFrame, objects: DataFrame) -> DataFrame:
    """The twelve gates of each candidate: (subject, gate, status).

    candidates: (candidate_id, question, state, cues array, digests_match, answer_kind, answers array, n_sources, capability,
    has_negative_scope, profile_status), texts as they are; profile_status is the worst of all profiles, null if there is none.
    The overlap of a question is its greatest similarity, by tokens, to that of another candidate that is neither rejected nor
    blocked. evidence: (candidate_id, object_id); objects: (object_id, status, eligible, object_type).
    """
    known = objects.select("object_id", "status", "eligible", "object_type", F.lit(True).alias("known"))
    cited = evidence.join(known, "object_id", "left")
    sound = _yes(F.col("known")) & (F.col("status") == "supported") & F.coalesce("eligible", F.lit(True))
    per = cited.groupBy("candidate_id").agg(F.count_if(~_yes(sound)).alias("unsound"), F.count_distinct("object_id").alias("cited"), F.count_if(F.col("object_type") == "cell").alias("cells"))
    sets = candidates.select(F.col("candidate_id").alias("id"), tokens(F.col("question")).alias("tokens"), plain(F.col("question")).alias("text"), (~F.coalesce("state", F.lit("")).isin(*CLOSED_STATES)).alias("open"))
    overlap = open_overlap(written(sets), OVERLAP_FLAG).withColumnRenamed("id", "candidate_id")
    rows = candidates.join(per, "candidate_id", "left").join(overlap, "candidate_id", "left").fillna(0, ["unsound", "cited", "cells"])
    rows = rows.transform(squeezed_together({"q": F.col("question")}, {c: F.col(c) for c in ("cues", "answers")}))
    inside = lambda values, least: F.exists(values, lambda v: (F.char_length(v) >= least) & F.contains("q", v))
    abstains = F.col("answer_kind") == "abstain"
    gate = lambda name, status: F.struct(F.lit(name).alias("gate"), status.alias("status"))
    fails = lambda when: F.when(_yes(when), "FAIL").otherwise("PASS")
    hops = _yes(F.contains("capability", F.lit("multi_hop")) | (F.col("capability") == "cross_section_relation"))
    several = (F.col("n_sources") >= 2) & (F.col("cited") >= 2)
    sound = F.col("unsound") == 0
    return rows.select(F.col("candidate_id").alias("subject"), F.inline(F.array(
        gate("source_evidence_digest_match", fails(~_yes(F.col("digests_match")))),
        gate("title_file_object_id_leakage", fails(inside("cues", 1))),
        gate("answer_leakage", fails(~abstains & inside("answers", 3))),
        gate("duplicate_template_overlap", F.when(F.col("overlap") >= OVERLAP_FAIL, "FAIL").when(F.col("overlap") >= OVERLAP_FLAG, "FLAG").otherwise("PASS")),
        gate("locator_witness_round_trip", fails(~sound)),
        gate("table_recomputation", F.when((F.col("cells") > 0) & F.col("answer_kind").isin("numeric", "formula"), "FLAG").otherwise("PASS")),
        gate("negative_absence", F.when(~abstains, "PASS").when(_yes(F.col("has_negative_scope")) & (F.col("cited") == 0), "FLAG").otherwise("FAIL")),
        gate("single_block_shortcut", fails(hops & ~several)),
        gate("multi_hop_removal", F.when(~hops, "PASS").when(several, "FLAG").otherwise("FAIL")),
        gate("export_representability", fails(~(sound & (abstains | (F.col("cited") > 0))))),
        gate("runtime_evidence_representability", F.when(_yes(F.col("profile_status") == "FULL"), "PASS").otherwise("FLAG")),
        gate("alternative_answers", F.lit("FLAG")),
    )))
