"""Queries of the named admission and release rules. Their inputs are stated once, in SQL that Spark and DuckDB read alike; only
the rules themselves are written twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import admission, formal

#: The derived inputs; @array makes an array.
INPUTS = {
    "src": """SELECT s_suppkey AS source_id, s_nationkey AS family_id, CASE WHEN s_suppkey % 19 = 0 THEN -1 ELSE s_nationkey END AS registered_family_id, CASE WHEN s_nationkey % 2 = 0 THEN 'held_out' ELSE 'development' END AS family_class,
 s_suppkey % 3 <> 0 AS independent_test, CASE WHEN s_suppkey % 7 = 0 THEN 'partial' ELSE 'complete' END AS parsing, 'complete' AS structure, CASE WHEN s_suppkey % 11 = 0 THEN 'partial' ELSE 'complete' END AS locators,
 CASE WHEN s_suppkey % 5 = 0 THEN 'candidate' ELSE 'admitted' END AS admission FROM {supplier}""",
    "sim": """SELECT l_suppkey AS source_id, l_partkey % 6 AS family_id, l_partkey AS document_id, CASE (l_partkey + l_suppkey) % 71 WHEN 0 THEN 'near_duplicate' WHEN 1 THEN 'undetermined' ELSE 'distinct' END AS disposition FROM {lineitem} WHERE l_linenumber = 1""",
    "fam": "SELECT n_nationkey AS family_id FROM {nation} WHERE n_nationkey < 5",
    "ca": """SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_orderkey END AS gold_case_id, CASE WHEN o_orderkey % 3 = 0 THEN 'held_out' ELSE 'development' END AS usage, o_orderkey % 4 <> 0 AS source_eligible, o_orderkey % 5 <> 0 AS source_admitted,
 o_orderkey % 43 <> 0 AS source_matches, o_orderkey % 2 = 0 AS has_scope, o_orderkey % 47 <> 0 AS scope_matches, o_orderkey % 53 <> 0 AS lineage, o_orderpriority LIKE '1%' AS multi_hop, o_orderkey % 6 AS dependencies, o_orderkey % 7 = 0 AS generated,
 o_orderkey % 59 = 0 AS risky_source, o_orderkey % 61 = 0 AS structured, @array(o_orderkey % 9, o_orderkey % 90) AS actors, 1 + CAST(o_orderkey % 13 = 0 AS INT) AS paths, 'Is it Order ' || o_orderkey || ' ' || o_orderpriority AS question, CASE WHEN o_orderkey % 11 = 0 THEN 'abstain' ELSE 'text' END AS answer_kind,
 @array(CASE WHEN o_orderkey % 17 = 0 THEN 'IT  order' ELSE o_orderstatus END, o_orderkey || 'x') AS answers, @array(CAST(o_orderkey % 190 + 1 AS STRING)) AS negative_scope, CASE WHEN o_orderkey % 22 = 0 THEN '' ELSE 'none there' END AS negative_rationale FROM {orders}""",
    "ev": "SELECT l_orderkey AS case_id, CASE WHEN l_linenumber = 5 THEN l_orderkey % 190 + 1 ELSE l_partkey END AS object_id, CASE l_linenumber WHEN 5 THEN 'negative_scope' WHEN 6 THEN 'conflicting' ELSE 'required' END AS role FROM {lineitem}",
    "so": "SELECT l_orderkey AS case_id, l_suppkey % 190 + 1 AS object_id FROM {lineitem} WHERE l_linenumber = 1",
    "sc": "SELECT l_orderkey AS case_id, CASE WHEN l_linenumber = 5 THEN l_orderkey % 190 + 1 ELSE l_partkey END AS object_id FROM {lineitem} WHERE l_linenumber <> 4 OR l_partkey % 5 > 0 UNION SELECT l_orderkey, l_suppkey % 190 + 1 FROM {lineitem} WHERE l_linenumber = 1 AND l_suppkey % 7 > 0 UNION SELECT l_orderkey, l_suppkey % 195 + 1 FROM {lineitem} WHERE l_linenumber = 2",
    "ob": "SELECT p_partkey AS object_id, p_partkey % 29 <> 0 AS eligible FROM {part} WHERE p_partkey % 31 <> 0",
    "cl": "SELECT l_orderkey AS case_id, 0 AS path, l_linenumber AS clause, @array(CAST(l_partkey AS STRING), 'z') AS alternatives FROM {lineitem}",
    "ck": "SELECT l_orderkey AS case_id, 0 AS path, l_linenumber AS clause, @array('z', CAST(l_partkey AS STRING)) AS alternatives, CASE l_suppkey % 23 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS necessary FROM {lineitem} WHERE (l_partkey + l_orderkey) % 19 <> 0",
    "co": "SELECT l_orderkey AS case_id, l_suppkey AS other_id, CASE WHEN l_linenumber % 2 = 0 THEN 'development' ELSE 'held_out' END AS usage, CASE (l_suppkey + l_orderkey) % 37 WHEN 0 THEN 'near_duplicate' WHEN 1 THEN 'undetermined' ELSE 'distinct' END AS disposition FROM {lineitem}",
    "re": "SELECT l_orderkey AS case_id, l_suppkey % 9 AS reviewer, l_partkey % 6 <> 0 AS complete FROM {lineitem} WHERE l_linenumber <= 3",
    "he": "SELECT l_orderkey AS case_id, l_partkey AS assistance_id, CASE WHEN l_partkey % 61 = 0 THEN 0 ELSE l_orderkey END AS of_case_id, l_partkey % 67 <> 0 AS proposal_only FROM {lineitem} WHERE l_linenumber = 3",
    "cd": """SELECT p_partkey AS candidate_id, CASE WHEN p_partkey % 40 = 0 THEN CASE WHEN p_partkey % 80 = 0 THEN '?' ELSE ' ! ' || p_size END WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_name ELSE p_name || ' ' || p_type END AS question, @array(p_brand, CASE WHEN p_partkey % 9 = 0 THEN p_type ELSE '' END) AS cues, p_partkey % 37 <> 0 AS digests_match, CASE p_partkey % 5 WHEN 0 THEN 'abstain' WHEN 1 THEN 'numeric' ELSE 'text' END AS answer_kind,
 @array(CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_brand END) AS answers, CASE p_partkey % 9 WHEN 4 THEN 'rejected' WHEN 5 THEN 'blocked' ELSE 'draft' END AS state, p_partkey % 4 AS n_sources, CASE p_partkey % 6 WHEN 0 THEN 'x_multi_hop' WHEN 1 THEN 'cross_section_relation' ELSE 'fact' END AS capability,
 p_partkey % 2 = 0 AS has_negative_scope, CASE p_partkey % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'PARTIAL_UNOBSERVABLE' END AS profile_status FROM {part}""",
    "ce": "SELECT l_partkey AS candidate_id, l_suppkey AS object_id FROM {lineitem} WHERE l_linenumber = 7 AND l_partkey % 8 <> 0",
    "cob": "SELECT s_suppkey AS object_id, CASE WHEN s_suppkey % 10 = 4 THEN 'partial' ELSE 'supported' END AS status, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 10 <> 1 END AS eligible, CASE WHEN s_suppkey % 3 = 0 THEN 'cell' ELSE 'paragraph' END AS object_type FROM {supplier}",
    "fob": "SELECT p_partkey AS object_id, CASE WHEN p_partkey % 23 = 0 THEN 'missing' ELSE 'complete' END AS representation, p_partkey % 17 AS n_spans, CASE WHEN p_partkey % 19 <> 0 THEN 'x' END AS source_sha256, p_partkey % 29 <> 0 AS eligible FROM {part} WHERE p_partkey % 97 <> 0",
    "frl": "SELECT l_orderkey * 10 + l_linenumber AS relation_id, l_partkey AS source_id, l_partkey + 1 AS target_id FROM {lineitem}",
    "fdc": """SELECT n_nationkey AS document_id, 'a' AS revision_source_digest, 'a' AS revision_canonical_digest, 'a' AS revision_configuration_digest, 'a' AS revision_parser_identity, 'a' AS revision_canonicalizer_identity, 'a' AS manifest_source_digest,
 CASE WHEN n_nationkey % 9 = 1 THEN 'b' ELSE 'a' END AS manifest_canonical_digest, 'a' AS manifest_configuration_digest, CASE WHEN n_nationkey % 9 <> 2 THEN 'a' END AS manifest_parser_identity, 'a' AS manifest_canonicalizer_identity, 'a' AS dataset_source, CASE WHEN n_nationkey % 8 = 3 THEN 'z' ELSE 'a' END AS file_sha256 FROM {nation}""",
    "fca": """SELECT conv_id * 100 + turn AS case_id, 'c' || CASE WHEN conv_id % 50 = 7 THEN 0 ELSE conv_id * 100 + turn END AS case_revision_id, text AS question, @array((conv_id * 7 + turn) % 199 + 1) AS object_ids,
 CASE WHEN conv_id % 31 = 5 THEN 'draft' ELSE 'approved' END AS lifecycle, 'a' || conv_id % 3 AS actor FROM {conversations} WHERE role = 'user'""",
    "fgo": """SELECT 'g' || (conv_id * 100 + turn) AS gold_id, conv_id * 100 + turn AS case_id, 'c' || CASE WHEN conv_id % 50 = 7 THEN 0 WHEN conv_id % 50 = 8 THEN 1 ELSE conv_id * 100 + turn END AS case_revision_id, CASE WHEN conv_id % 9 = 0 THEN 'abstain' ELSE 'text' END AS answer_kind,
 @array(CASE WHEN conv_id % 5 = 0 THEN substring(text, 1, 9) ELSE 'not in it' END) AS answers, @array('Yes', CASE WHEN conv_id % 13 = 0 THEN 'yes' ELSE 'sure' END) AS accepted,
 CASE WHEN conv_id % 17 = 0 THEN NULL WHEN conv_id % 17 = 1 THEN @array(@array(@array('e1')), @array(@array('e2'))) WHEN conv_id % 17 = 2 THEN @array(@array(@array('e1', 'e2'), @array('e3'))) ELSE @array(@array(@array('e1'))) END AS paths,
 CASE WHEN conv_id % 9 = 0 OR conv_id % 23 = 1 THEN @array(CAST((conv_id * 7 + turn * 3 + 3) % 199 + 1 AS STRING)) END AS negative_scope, CASE WHEN conv_id % 4 <> 1 THEN 'why' END AS negative_rationale,
 CASE WHEN conv_id % 29 = 3 THEN 'rejected' ELSE 'frozen' END AS lifecycle, 'a' || conv_id % 3 AS actor FROM {conversations} WHERE role = 'user' AND conv_id % 37 <> 9""",
    "fev": """SELECT 'g' || (conv_id * 100 + turn) AS gold_id, 'e' || j AS evidence_id, CAST((conv_id * 7 + turn * 3 + j) % 199 + 1 AS STRING) AS object_id, CASE WHEN j = 3 AND conv_id % 9 = 0 THEN 'negative_scope' WHEN j = 3 AND conv_id % 8 = 0 THEN 'conflicting' ELSE 'required' END AS role,
 CASE WHEN conv_id % 16 = 0 THEN 'r' END AS rationale FROM {conversations} CROSS JOIN (VALUES (1), (2), (3)) t(j) WHERE role = 'user' AND conv_id % 37 <> 9""",
    "fde": """SELECT 'g' || (conv_id * 100 + turn) AS gold_id, j AS dependency_id, CASE WHEN conv_id % 12 = 0 THEN (j + 1) % 3 ELSE j + 1 END AS depends_on FROM {conversations} CROSS JOIN (VALUES (0), (1), (2)) t(j) WHERE role = 'user' AND conv_id % 6 = 0""",
    "frv": "SELECT CAST(conv_id * 100 + turn AS STRING) AS record_id, 'b' AS identity FROM {conversations} WHERE role = 'user' AND conv_id % 11 <> 0 UNION ALL SELECT 'g' || (conv_id * 100 + turn), 'b' FROM {conversations} WHERE role = 'user'",
    "fap": "SELECT CAST(conv_id * 100 + turn AS STRING) AS record_id, CASE WHEN conv_id % 14 = 2 THEN 'a' || conv_id % 3 ELSE 'b' END AS identity FROM {conversations} WHERE role = 'user' UNION ALL SELECT 'g' || (conv_id * 100 + turn), 'b' FROM {conversations} WHERE role = 'user' AND conv_id % 15 <> 4",
}
_TABLES = ("supplier", "lineitem", "nation", "orders", "part", "conversations")


def _inputs(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    return [spark.sql(INPUTS[n].replace("@array", "array"), **{t: df for t, df in tables.items() if f"{{{t}}}" in INPUTS[n]}) for n in names]


def _ctes(*names: str) -> str:
    text = ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)
    return text.replace("@array", "list_value").replace("{", "").replace("}", "")


def source_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = admission.source_admission(*_inputs(spark, sf_dir, "src", "sim", "fam"))
    return out.withColumn("affected", F.array_join("affected", ","))


def case_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = admission.case_admission(*_inputs(spark, sf_dir, "ca", "ev", "so", "sc", "ob", "cl", "ck", "co", "re", "he"))
    return out.withColumn("affected", F.array_join("affected", ","))


def candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.candidate_gates(*_inputs(spark, sf_dir, "cd", "ce", "cob"))


def _release(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _inputs(spark, sf_dir, "fob", "frl", "fdc", "fca", "fgo", "fev", "fde", "frv", "fap")
    text_ids = lambda df, *names: df.withColumns({n: F.col(n).cast("string") for n in names})
    tables[0], tables[3] = text_ids(tables[0], "object_id"), text_ids(tables[3], "case_id").withColumn("object_ids", F.col("object_ids").cast("array<string>"))
    tables[1], tables[4] = text_ids(tables[1], "source_id", "target_id"), text_ids(tables[4], "case_id")
    return formal.violations(*tables)


def release_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _release(spark, sf_dir)


def release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formal.report(_release(spark, sf_dir))


QUERIES = {f.__name__: f for f in (source_admission, case_admission, candidate_gates, release_violations, release_report)}

_JOINED = "coalesce(array_to_string(list_sort(list_distinct({})), ','), '')"
_SQ = r"regexp_replace(replace(lower({}), 'ß', 'ss'), '\s+', '', 'g')"
_SOURCES = f"""{_ctes("src", "sim", "fam")},
p AS (SELECT source_id, family_id, document_id::varchar AS d, disposition AS x FROM sim SEMI JOIN fam USING (family_id)),
m AS (SELECT source_id, fam.family_id::varchar AS d FROM src, fam WHERE independent_test AND NOT EXISTS (SELECT 1 FROM p WHERE p.source_id = src.source_id AND p.family_id = fam.family_id)),
w AS (SELECT source_id, d, 2 AS bad FROM m UNION ALL SELECT source_id, d, CASE x WHEN 'near_duplicate' THEN 2 ELSE 1 END FROM p WHERE x <> 'distinct'),
i AS (SELECT source_id, max(bad) AS bad, {_JOINED.format("list(d)")} AS who FROM w GROUP BY 1)
SELECT source_id AS subject, 'source.parse_structure_locator' AS rule_id, 'error' AS severity, CASE WHEN source_id % 7 = 0 OR source_id % 11 = 0 THEN 'FAIL' ELSE 'PASS' END AS result, source_id::varchar AS affected FROM src
UNION ALL SELECT source_id, 'source.family_classification', 'error', CASE WHEN source_id % 19 = 0 OR (independent_test AND family_id % 2 = 1) THEN 'FAIL' ELSE 'PASS' END, family_id::varchar FROM src
UNION ALL SELECT source_id, 'source.family_isolation_and_similarity', CASE WHEN bad = 1 THEN 'human_review' ELSE 'error' END, CASE bad WHEN 2 THEN 'FAIL' WHEN 1 THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'PASS' END, coalesce(who, '') FROM src LEFT JOIN i USING (source_id)
UNION ALL SELECT source_id, 'source.admission_status', 'error', CASE WHEN source_id % 5 = 0 THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'PASS' END, source_id::varchar FROM src"""
_CASES = f"""{_ctes("ca", "ev", "so", "sc", "ob", "cl", "ck", "co", "re", "he")},
e1 AS (SELECT case_id, list(object_id::varchar) FILTER (NOT coalesce(eligible, false)) AS un,
 list(object_id::varchar) FILTER (role = 'negative_scope') AS ng, list(object_id::varchar) FILTER (role = 'negative_scope' AND coalesce(eligible, false)) AS nu, bool_or(role IN ('conflicting', 'negative_scope')) AS rk FROM ev LEFT JOIN ob USING (object_id) GROUP BY 1),
s1 AS (SELECT case_id, list(DISTINCT o::varchar) AS sc FROM (SELECT case_id, object_id AS o FROM (SELECT case_id, object_id FROM ev UNION SELECT case_id, object_id FROM so) n WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.case_id = n.case_id AND sc.object_id = n.object_id)
 UNION SELECT case_id, object_id FROM sc WHERE object_id NOT IN (SELECT object_id FROM ob WHERE eligible)) GROUP BY 1),
c1 AS (SELECT case_id, list('0/' || clause) AS un FROM cl WHERE NOT EXISTS (SELECT 1 FROM ck WHERE ck.case_id = cl.case_id AND ck.clause = cl.clause AND ck.alternatives[2] = cl.alternatives[1]) GROUP BY 1),
k1 AS (SELECT case_id, list('0/' || clause) FILTER (NOT necessary) AS no, list('0/' || clause) FILTER (necessary IS NULL) AS op FROM ck GROUP BY 1),
o1 AS (SELECT case_id, list(other_id::varchar) FILTER (disposition = 'near_duplicate') AS du, list(other_id::varchar) FILTER (disposition = 'undetermined') AS un, bool_or(usage = 'development') AS dev FROM co GROUP BY 1),
r1 AS (SELECT re.case_id, count(DISTINCT reviewer) FILTER (complete AND NOT list_contains(actors, reviewer)) AS n FROM re JOIN ca USING (case_id) GROUP BY 1),
h1 AS (SELECT case_id, count(*) AS n, list(assistance_id::varchar) FILTER (of_case_id <> case_id OR NOT proposal_only) AS bad FROM he GROUP BY 1),
x AS (SELECT ca.*, e1.un AS e_un, s1.sc, coalesce(ng, []) AS ng, coalesce(nu, []) AS nu, coalesce(rk, false) AS rk, c1.un AS c_un, no, op, du, o1.un AS o_un, coalesce(dev, false) AS dev, coalesce(r1.n, 0) AS rn, coalesce(h1.n, 0) AS hn, bad,
 CASE WHEN NOT has_scope THEN 'NOT_APPLICABLE' WHEN scope_matches AND s1.sc IS NULL THEN 'PASS' ELSE 'FAIL' END AS scope, answer_kind = 'abstain' AS ab, {_SQ.format("question")} AS q
 FROM ca LEFT JOIN e1 USING (case_id) LEFT JOIN s1 USING (case_id) LEFT JOIN c1 USING (case_id) LEFT JOIN k1 USING (case_id) LEFT JOIN o1 USING (case_id) LEFT JOIN r1 USING (case_id) LEFT JOIN h1 USING (case_id)),
y AS (SELECT *, CASE WHEN c_un IS NOT NULL OR no IS NOT NULL THEN 'FAIL' WHEN op IS NOT NULL THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'PASS' END AS mi,
 CASE WHEN du IS NOT NULL THEN 'FAIL' WHEN usage = 'held_out' AND NOT dev THEN 'HUMAN_REVIEW_REQUIRED' WHEN o_un IS NOT NULL THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'PASS' END AS si,
 CASE WHEN bad IS NOT NULL THEN 'FAIL' WHEN generated AND (hn = 0 OR rn = 0) THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'PASS' END AS pr, CASE WHEN rn < CASE WHEN multi_hop OR structured OR risky_source OR paths > 1 OR rk THEN 2 ELSE 1 END THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'PASS' END AS rv,
 CASE WHEN ab THEN 'NOT_APPLICABLE' WHEN len(list_filter(answers, lambda a: length({_SQ.format("a")}) >= 3 AND contains(q, {_SQ.format("a")}))) > 0 THEN 'FAIL' ELSE 'PASS' END AS le FROM x),
f AS (SELECT case_id, unnest([
 {{'r': 'case.source_and_slot_binding', 'v': CASE WHEN source_matches AND CASE WHEN usage = 'held_out' THEN source_admitted AND source_eligible ELSE source_admitted OR scope = 'PASS' END THEN 'PASS' ELSE 'FAIL' END, 'a': [case_id::varchar]}},
 {{'r': 'case.reliable_canonical_evidence_scope', 'v': scope, 'a': CASE WHEN scope = 'FAIL' THEN coalesce(sc, []) ELSE [] END}},
 {{'r': 'case.gold_lineage', 'v': CASE WHEN lineage AND gold_case_id = case_id THEN 'PASS' ELSE 'FAIL' END, 'a': [case_id::varchar]}},
 {{'r': 'gold.evidence_reachability', 'v': CASE WHEN e_un IS NULL THEN 'PASS' ELSE 'FAIL' END, 'a': coalesce(e_un, [])}},
 {{'r': 'gold.mses_minimality', 'v': mi, 'a': CASE WHEN mi = 'FAIL' THEN list_concat(coalesce(c_un, []), coalesce(no, [])) ELSE coalesce(op, []) END}},
 {{'r': 'gold.negative_scope', 'v': CASE WHEN NOT ab THEN 'NOT_APPLICABLE' WHEN list_contains(nu, negative_scope[1]) AND negative_rationale <> '' THEN 'PASS' ELSE 'FAIL' END, 'a': CASE WHEN ab AND NOT list_contains(ng, negative_scope[1]) THEN negative_scope ELSE [] END}},
 {{'r': 'gold.multi_hop_dependency', 'v': CASE WHEN multi_hop AND dependencies = 0 THEN 'FAIL' ELSE 'PASS' END, 'a': [case_id::varchar]}},
 {{'r': 'case.answer_leakage', 'v': le, 'a': [case_id::varchar]}},
 {{'r': 'case.duplicate_and_contamination', 'v': si, 'a': CASE WHEN si = 'FAIL' THEN du WHEN si = 'PASS' OR (usage = 'held_out' AND NOT dev) THEN [] ELSE o_un END}},
 {{'r': 'model.output_proposal_only', 'v': pr, 'a': coalesce(bad, [])}},
 {{'r': 'review.independent_admission_checklist', 'v': rv, 'a': [case_id::varchar]}}]) AS u FROM y)
SELECT case_id AS subject, u.r AS rule_id, CASE u.v WHEN 'HUMAN_REVIEW_REQUIRED' THEN 'human_review' WHEN 'NOT_APPLICABLE' THEN 'info' ELSE 'error' END AS severity, u.v AS result, {_JOINED.format("u.a")} AS affected FROM f"""
_GATES = f"""{_ctes("cd", "ce", "cob")},
tk AS (SELECT candidate_id AS id, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS t, state NOT IN ('rejected', 'blocked') AS open, list_distinct(list_transform(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_.-]{{1,}}|[0-9]+(?:\\.[0-9]+)?'), lambda y: lower(y))) AS ws FROM cd),
tw AS (SELECT id, unnest(ws) AS w FROM tk), sh AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM tw x JOIN tw y ON x.w = y.w AND x.id <> y.id GROUP BY ALL),
ov AS (SELECT id, max(j) AS overlap FROM (SELECT a AS id, c / (len(p.ws) + len(q.ws) - c) AS j FROM sh JOIN tk p ON p.id = a JOIN tk q ON q.id = b WHERE q.open UNION ALL SELECT p.id, 1.0 FROM tk p JOIN tk q ON p.t = q.t AND p.id <> q.id AND q.open WHERE len(p.ws) = 0) GROUP BY 1),
e AS (SELECT candidate_id, count(*) FILTER (NOT (coalesce(status = 'supported', false) AND coalesce(eligible, true))) AS bad, count(DISTINCT object_id) AS n, count(*) FILTER (object_type = 'cell') AS cells FROM ce LEFT JOIN cob USING (object_id) GROUP BY 1),
x AS (SELECT cd.*, coalesce(bad, 0) AS bad, coalesce(n, 0) AS n, coalesce(cells, 0) AS cells, {_SQ.format("question")} AS q, answer_kind = 'abstain' AS ab, candidate_id % 6 IN (0, 1) AS hop, coalesce(n, 0) >= 2 AND n_sources >= 2 AS many, overlap FROM cd LEFT JOIN e USING (candidate_id) LEFT JOIN ov ON ov.id = candidate_id),
g AS (SELECT candidate_id, unnest([
 {{'g': 'source_evidence_digest_match', 's': CASE WHEN digests_match THEN 'PASS' ELSE 'FAIL' END}},
 {{'g': 'title_file_object_id_leakage', 's': CASE WHEN contains(q, {_SQ.format("cues[1]")}) OR (cues[2] <> '' AND contains(q, {_SQ.format("cues[2]")})) THEN 'FAIL' ELSE 'PASS' END}},
 {{'g': 'answer_leakage', 's': CASE WHEN NOT ab AND contains(q, {_SQ.format("answers[1]")}) THEN 'FAIL' ELSE 'PASS' END}},
 {{'g': 'duplicate_template_overlap', 's': CASE WHEN overlap >= 0.98 THEN 'FAIL' WHEN overlap >= 0.75 THEN 'FLAG' ELSE 'PASS' END}},
 {{'g': 'locator_witness_round_trip', 's': CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END}},
 {{'g': 'table_recomputation', 's': CASE WHEN cells > 0 AND answer_kind = 'numeric' THEN 'FLAG' ELSE 'PASS' END}},
 {{'g': 'negative_absence', 's': CASE WHEN NOT ab THEN 'PASS' WHEN has_negative_scope AND n = 0 THEN 'FLAG' ELSE 'FAIL' END}},
 {{'g': 'single_block_shortcut', 's': CASE WHEN hop AND NOT many THEN 'FAIL' ELSE 'PASS' END}},
 {{'g': 'multi_hop_removal', 's': CASE WHEN NOT hop THEN 'PASS' WHEN many THEN 'FLAG' ELSE 'FAIL' END}},
 {{'g': 'export_representability', 's': CASE WHEN bad = 0 AND (ab OR n > 0) THEN 'PASS' ELSE 'FAIL' END}},
 {{'g': 'runtime_evidence_representability', 's': CASE WHEN profile_status = 'FULL' THEN 'PASS' ELSE 'FLAG' END}},
 {{'g': 'alternative_answers', 's': 'FLAG'}}]) AS u FROM x)
SELECT candidate_id AS subject, u.g AS gate, u.s AS status FROM g"""
_RULES = f"""{_ctes("fob", "frl", "fdc", "fca", "fgo", "fev", "fde", "frv", "fap")},
o AS (SELECT object_id::varchar AS id, * FROM fob), c AS (SELECT *, case_id::varchar AS id, object_ids[1]::varchar AS ob, {_SQ.format("question")} AS q FROM fca),
rec AS (SELECT id, lifecycle, actor FROM c UNION ALL SELECT gold_id, lifecycle, actor FROM fgo),
pg AS (SELECT gold_id, list(evidence_id) FILTER (role = 'required') AS rq, list(object_id) FILTER (role = 'negative_scope') AS ng, coalesce(bool_or(role = 'conflicting' AND coalesce(rationale, '') = ''), false) AS un, bool_or(role = 'conflicting') AS oth FROM fev GROUP BY 1),
g AS (SELECT fgo.*, rq, coalesce(ng, []) AS ng, coalesce(un, false) AS un, coalesce(oth, false) AS oth, answer_kind = 'abstain' AS ab, EXISTS (SELECT 1 FROM fde WHERE fde.gold_id = fgo.gold_id) AS dep FROM fgo LEFT JOIN pg USING (gold_id)),
tok AS (SELECT id, list_distinct(regexp_extract_all(replace(lower(question), 'ß', 'ss'), '[a-z0-9_.-]+|[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}')) AS t FROM c),
pr AS (SELECT a.id AS a, b.id AS b FROM tok a JOIN tok b ON a.id < b.id WHERE len(list_intersect(a.t, b.t)) > 0 AND len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.9 - 1e-12),
dup AS (SELECT id FROM c WHERE q IN (SELECT q FROM c GROUP BY q HAVING count(*) > 1)),
v AS (SELECT 'canonical.schema_relation_integrity' AS rule_id, 'error' AS severity, relation_id::varchar AS affected_id FROM frl WHERE source_id NOT IN (SELECT object_id FROM fob) OR target_id NOT IN (SELECT object_id FROM fob)
 UNION SELECT 'case_gold.revision_integrity', 'error', case_revision_id FROM fca GROUP BY 3 HAVING count(*) > 1
 UNION SELECT 'canonical.object_span_provenance', 'error', id FROM o WHERE representation <> 'missing' AND (n_spans = 0 OR source_sha256 IS NULL)
 UNION SELECT 'document.revision_digest_consistency', 'error', document_id::varchar FROM fdc WHERE document_id % 9 IN (1, 2)
 UNION SELECT 'cross_reference.integrity', 'error', ob FROM c WHERE ob NOT IN (SELECT id FROM o)
 UNION SELECT 'cross_reference.integrity', 'error', coalesce(gold_id, c.id) FROM c FULL JOIN fgo ON fgo.case_id = c.case_id WHERE fgo.case_revision_id IS DISTINCT FROM c.case_revision_id
 UNION SELECT 'gold.evidence_reachability', 'error', object_id FROM fev WHERE object_id NOT IN (SELECT id FROM o WHERE eligible)
 UNION SELECT 'integrity.checksums', 'error', document_id::varchar FROM fdc WHERE document_id % 8 = 3
 UNION SELECT 'case_gold.release_lifecycle', 'error', id FROM rec WHERE lifecycle IN ('draft', 'rejected')
 UNION SELECT 'gold.mses_completeness', 'error', gold_id FROM g WHERE NOT ab AND paths IS NULL
 UNION SELECT 'gold.answer_evidence_consistency', 'error', gold_id FROM g WHERE (NOT ab AND rq IS NULL) OR NOT list_has_all(coalesce(rq, []), coalesce(flatten(flatten(paths)), []))
 UNION SELECT 'gold.negative_unanswerable_scope', 'error', gold_id FROM g WHERE CASE WHEN ab THEN negative_scope IS NULL OR negative_rationale IS NULL OR NOT list_has_all(ng, negative_scope) ELSE negative_scope IS NOT NULL END
 UNION SELECT 'gold.multi_hop_dependency', 'error', gold_id FROM fde GROUP BY gold_id HAVING bool_or(depends_on < dependency_id)
 UNION SELECT 'case.duplicate_near_miss', 'error', id FROM dup
 UNION SELECT 'case.duplicate_near_miss', 'warn', id FROM (SELECT a AS id FROM pr UNION SELECT b FROM pr) WHERE id NOT IN (SELECT id FROM dup)
 UNION SELECT 'case.answer_leakage', 'error', c.id FROM g JOIN c ON c.case_id = g.case_id WHERE NOT ab AND length({_SQ.format("answers[1]")}) >= 3 AND contains(q, {_SQ.format("answers[1]")})
 UNION SELECT 'gold.ambiguity', CASE WHEN lower(accepted[2]) = 'yes' THEN 'error' ELSE 'warn' END, gold_id FROM g WHERE lower(accepted[2]) = 'yes' OR un
 UNION SELECT 'ledger.review_approval_integrity', 'error', id FROM rec WHERE id NOT IN (SELECT record_id FROM frv) OR id NOT IN (SELECT record_id FROM fap) OR EXISTS (SELECT 1 FROM fap WHERE record_id = id AND identity = actor)
 UNION SELECT 'bundle_v2.projection_lossiness', 'warn', gold_id FROM g WHERE len(paths) > 1 OR len(flatten(paths)[1]) > 1 OR dep OR oth)"""

ORACLES = {
    "source_admission": f"WITH {_SOURCES}",
    "case_admission": f"WITH {_CASES}",
    "candidate_gates": f"WITH {_GATES}",
    "release_violations": f"WITH {_RULES} SELECT * FROM v",
    "release_report": f"""WITH {_RULES}, n AS (SELECT rule_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warn') AS w FROM v GROUP BY 1)
SELECT r AS rule_id, CASE WHEN e + w > 0 THEN 'FAIL' ELSE 'PASS' END AS result, CASE WHEN e > 0 THEN 'error' WHEN w > 0 THEN 'warn' WHEN r = 'bundle_v2.projection_lossiness' THEN 'info' ELSE 'error' END AS severity, coalesce(CASE WHEN e > 0 THEN e ELSE w END, 0)::bigint AS n_affected
FROM (SELECT unnest([{", ".join(f"'{r}'" for r in formal.RULES)}]) AS r) LEFT JOIN n ON n.rule_id = r""",
}
