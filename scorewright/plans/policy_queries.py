"""Queries of answer scoring, statistics, comparison, coverage and validation over tables derived from the driver's data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.digests import merged_config
from scorewright.operators import aggregate, answers, compare, mses, validate
from scorewright.plans.traces import TRACE_SQL, trace


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("numeric", "numeric", "numeric", "set", "set", "text", "abstain", "numeric"))), (n % 8 + 1).cast("int"))
    parts = F.split("p_name", " ")
    answer = (
        F.when(n % 8 == 0, F.concat(F.lit("it is "), size, F.lit(" kg"))).when(n % 8 == 1, F.concat(size, F.lit(" or 1000"))).when(n % 8 == 2, F.concat(size, F.lit(" m")))
        .when(n % 8 == 3, F.array_join(F.reverse(parts), ", ")).when(n % 8 == 4, F.array_join(parts, "; ")).when(n % 8 == 5, F.upper("p_name"))
        .when(n % 8 == 6, F.when(n % 3 == 0, "I cannot answer that.").otherwise("It is blue.")).otherwise(F.when(n % 3 == 0, "").otherwise("none"))
    )
    answer = F.when(n % 8 == 4, F.concat(F.array_join(parts, ";"), F.lit("; extra"))).otherwise(answer)
    gold = F.when(kind == "numeric", F.array((F.col("p_size") + F.when(n % 5 == 0, 3).otherwise(0)).cast("string"))).when(kind == "set", parts).otherwise(F.array("p_name"))
    rows = p.select("p_partkey", kind.alias("kind"), answer.alias("answer"), gold.alias("gold"), F.array().cast("array<string>").alias("accepted"), F.lit(1).cast("decimal(38,18)").alias("tolerance"), F.lit("kg").alias("unit"))
    return answers.score_answers(rows, ascii_only=True).select("p_partkey", "kind", "verdict")


def answer_scores_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in any script: two words of each document as value, said in other notations, stated, as a set, in a formula."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(F.split("text", r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), lambda w: w != "").alias("w"))
    d = d.filter("size(w) > 1").select("doc_id", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"), (F.col("doc_id") % 6).alias("way"))
    pick = lambda *options: F.element_at(F.array(*options), (F.col("way") + 1).cast("int"))
    both, text = F.concat("a", F.lit(" "), "b"), F.lit("text")
    answer = pick(F.concat(F.lit("  "), F.lower("a"), F.lit(" \n\t"), F.lower("b")), F.concat(F.lit("The name is: "), both, F.lit(".")), F.concat("b", F.lit("，"), "a", F.lit("; ")), F.concat(F.lit("\\frac{v "), "a", F.lit("}{2} \\times X")), both, F.concat("b", F.lit("; "), "a", F.lit(", one more")))
    gold = pick(F.array(both), F.array(both), F.array("a", "b"), F.array(F.concat(F.lit("V"), F.lower("a"), F.lit(" / 2 x"))), F.array("a"), F.array("a", "b"))
    rows = d.select("doc_id", pick(text, text, F.lit("set"), F.lit("formula"), text, F.lit("set")).alias("kind"), answer.alias("answer"), gold.alias("gold"), F.array().cast("array<string>").alias("accepted"), F.lit(None).cast("decimal(38,18)").alias("tolerance"), F.lit(None).cast("string").alias("unit"))
    return answers.score_answers(rows).select("doc_id", "kind", "verdict")


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "P", "FAIL").otherwise("NEEDS_REVIEW").alias("verdict"),
                                           (F.col("o_orderkey") % 3 == 0).alias("context_complete"), F.when(F.col("o_orderkey") % 7 == 0, "context is not observable").alias("observability_reason"))
    return answers.grounding(o).groupBy("unsupported_status").agg(F.count(F.lit(1)).alias("n"), F.sum("unsupported_answer_rate").alias("total"))


def segment_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(F.when(n % 6 == 0, "abstain").otherwise("text").alias("kind"), F.when(n % 3 == 0, "PASS").when(n % 3 == 1, "FAIL").otherwise("NEEDS_REVIEW").alias("verdict"),
                                           (n % 11 == 0).alias("empty_answer"), F.when(n % 4 == 0, "complete").when(n % 4 == 1, "partial_coverage").when(n % 4 == 2, "retrieval_missing").alias("context_outcome"))
    m = answers.segment_answer_metrics(o)
    return m.groupBy("accuracy_status", "groundedness_status", "hallucination_status").agg(F.count(F.lit(1)).alias("n"), F.sum("answer_accuracy").alias("accuracy"), F.sum("answer_groundedness").alias("grounded"))


def capability_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    rows = _t(spark, sf_dir, "part").select("p_partkey", (n % 2 == 0).alias("declared"), (n % 3 == 0).alias("required"), (n % 5 < 2).alias("returned"))
    return answers.capability_faults(rows).select("p_partkey", "fault")


def expected_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    got = cases.filter("case_id % 5 <> 0").select("case_id", F.lit("raw_mrr").alias("metric_id"), F.lit("observed").alias("status"))
    return answers.expected_metrics(cases, ["raw_mrr", "ranked_mrr"], got).groupBy("metric_id", "status").agg(F.count(F.lit(1)).alias("n"))


def portfolio_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    state = F.element_at(F.array(*map(F.lit, ("planned", "authored", "approved", "frozen", "blocked"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    slots = p.select("p_brand", "p_type", F.floor(F.col("p_size") / 10).alias("size_class"), F.split("p_name", " ").alias("words"), F.concat_ws("|", "p_brand", "p_type").alias("brand_type"), state.alias("state"))
    return aggregate.coverage(slots, ["p_brand", "p_type", "size_class", "words", "brand_type"])


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "unsupported").when(F.col("quality") == 1, "supported").otherwise("needs_review").alias("judgment"))
    return aggregate.histogram(rows, "judgment", ("supported", "unsupported", "needs_review", "unavailable"))


def representability(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 2).alias("profile"), (F.col("l_linenumber") % 2).alias("evidence_group"), (F.col("l_partkey") % 3).cast("int").alias("code"))
    return aggregate.roll_up(rows)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"))
    s = s.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("system", F.explode(F.array(F.lit("base"), F.lit("new"))))
    bonus = F.when(F.col("system") == "new", 5).otherwise(0)
    return s.withColumn("value", ((F.col("case_id") * 7 + F.col("seed") * 3 + bonus * F.col("case_id")) % 10).cast("double"))


def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.paired_deltas(_scores(spark, sf_dir), "base", "new")
    return out.withColumn("delta", F.round("delta", 9))


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.clustered_bootstrap(compare.paired_deltas(_scores(spark, sf_dir), "base", "new"), iterations=1000)
    return out.select("n_cases", *[F.round(c, 9).alias(c) for c in ("estimate", "low", "high")])


def stratified_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = compare.paired_deltas(_scores(spark, sf_dir), "base", "new").withColumn("stratum", F.col("case_id") % 3)
    out = compare.stratified_bootstrap(deltas, weights={"0": 1.0, "1": 2.0, "2": 1.0})
    return out.select("n_cases", *[F.round(c, 9).alias(c) for c in ("estimate", "low", "high")])


def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.filter(k % 11 != 3)
    new = c.filter(k % 13 != 5).withColumn("c_acctbal", F.when(k % 7 == 0, 0.0).otherwise(F.col("c_acctbal"))).withColumn("c_mktsegment", F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")))
    out = compare.table_diff(old, new, ["c_custkey"], ["c_acctbal", "c_mktsegment"])
    return out.select("c_custkey", "change", F.array_join("fields", ",").alias("fields"))


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.concat(F.lit("p/"), F.col("p_partkey")).alias("path"), "p_partkey", F.sha2("p_name", 256).alias("sha256"))
    actual = p.filter("p_partkey % 50 <> 1").select(F.when(F.col("p_partkey") % 50 == 2, F.concat("path", F.lit(".tmp"))).otherwise(F.col("path")).alias("path"), F.when(F.col("p_partkey") % 50 == 3, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return compare.verify_manifest(p, actual)


def config_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    a = n.select(F.concat(F.lit("factor"), F.col("n_regionkey"), F.lit("."), F.col("n_name")).alias("path"), F.col("n_nationkey").cast("string").alias("value"))
    b = a.filter("value <> '7'").select("path", F.when(F.col("value").cast("int") % 4 == 0, "x").otherwise(F.col("value")).alias("value"))
    return compare.config_drift(a, b, ["factor1", "factor2.NATION_2"])


def incompatible_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").withColumn("fixed", F.lit("one"))
    return compare.incompatible_fields(o, ["o_orderstatus", "o_orderpriority", "fixed"])


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return compare.first_wins(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("archived")), "c_custkey")


def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p = (_t(spark, sf_dir, x) for x in ("lineitem", "orders", "part"))
    lines = li.withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    questions = p.select(F.col("p_partkey").alias("case_id"), F.concat("p_name", F.lit(" "), F.when(F.col("p_partkey") % 9 == 0, F.lower("p_brand")).otherwise("")).alias("question"), F.concat(F.lit(" "), F.col("p_brand")).alias("answer"))
    return validate.gates([
        validate.unique_key(lines, "line_id"),
        validate.known_reference(lines, "l_orderkey", "line_id", o.filter("o_orderkey % 101 <> 0"), "o_orderkey", "known_order"),
        validate.predicate(lines, F.col("l_discount") <= 0.09, "line_id", "discount_bound", "warning"),
        validate.answer_leakage(questions),
        validate.parity(p.select("p_partkey", "p_size"), p.select("p_partkey", F.when(F.col("p_partkey") % 97 == 0, -1).otherwise(F.col("p_size")).alias("p_size")), "p_partkey", ["p_size"], "runtime_parity"),
    ]).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("affected_id").alias("first"))


def endpoint_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    objects = n.select(F.col("n_nationkey").alias("object_id"), F.when(F.col("n_regionkey") < 2, "table").when(F.col("n_regionkey") < 4, "row").otherwise("cell").alias("object_type"))
    relations = n.select(F.col("n_nationkey").alias("relation_id"), F.when(F.col("n_nationkey") % 2 == 0, "contains").otherwise("header_of").alias("kind"), F.col("n_nationkey").alias("source_id"), ((F.col("n_nationkey") * 3 + 1) % 27).alias("target_id"))
    return validate.endpoint_types(relations, objects, [("contains", "table", "row"), ("contains", "row", "cell"), ("header_of", "cell", "cell")])


def packed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("segment_id"), F.floor(F.col("p_partkey") / 10).alias("document_id"))
    batches = p.filter("segment_id % 31 <> 0").groupBy(F.floor((F.col("segment_id") + F.when(F.col("segment_id") % 200 == 9, 5).otherwise(0)) / 5).alias("batch_id")).agg(F.collect_list("segment_id").alias("segment_ids"))
    return validate.packed_once(p, batches)


def lossiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out = validate.lossiness(o, {"large": F.col("o_totalprice") > 400000, "urgent": F.startswith("o_orderpriority", F.lit("1")), "odd": F.col("o_orderkey") % 2 == 1})
    return out.groupBy(F.array_join("reasons", "+").alias("reasons"), "lossy").agg(F.count(F.lit(1)).alias("n"))


def clause_necessity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    required = t.lines.filter("ln <> 7").select("case_id", F.col("ln").alias("evidence_id"))
    return validate.clause_necessity(required, t.gold.select("case_id", "evidence_id"))


def content_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_type", F.concat("p_name", F.lit("/"), F.col("p_partkey")).alias("path"), F.sha2("p_brand", 256).alias("sha"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: F.concat(x["path"], F.lit(chr(0)), x["sha"], F.lit("\n")))
    return p.groupBy("p_type").agg(F.sha2(F.array_join(lines, ""), 256).alias("register_id"))


def path_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    options = F.when(F.col("ln") % 2 == 0, F.array(F.array(F.col("ln")), F.array(F.col("ln") + 10, F.col("ln") + 20))).otherwise(F.array(F.array(F.col("ln"))))
    cases = t.lines.groupBy("case_id").agg(F.collect_list(F.transform(options, lambda o: F.transform(o, lambda x: x.cast("string")))).alias("clauses"))
    out = mses.expand_paths(cases)
    return out.select("case_id", "n_paths", F.size("paths").cast("bigint").alias("made"), F.aggregate("paths", F.lit(0).cast("bigint"), lambda acc, x: acc + F.size(x)).alias("ids"))


def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    low = F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    high = F.create_map(F.lit("key"), F.when(F.col("n_nationkey") % 2 == 0, "x"), F.lit("more"), F.lit("y"))
    m = merged_config(low, high)
    return n.select("n_nationkey", m["name"].alias("name"), m["key"].alias("key"), m["more"].alias("more"))


QUERIES = {f.__name__: f for f in (answer_scores, answer_scores_unicode, grounding, segment_answers, capability_faults, expected_metrics, portfolio_coverage, judgments, representability, paired_deltas, bootstrap, stratified_bootstrap, table_diff, manifest_check,
                                   config_drift, incompatible_fields, first_wins, policy_violations, endpoint_types, packed_once, lossiness, clause_necessity, content_register, path_expansion, config_merge)}

_SCORES = "sc AS (SELECT s_suppkey AS case_id, seed, (s_suppkey * 7 + seed * 3) % 10 AS a, (s_suppkey * 7 + seed * 3 + 5 * s_suppkey) % 10 AS b FROM supplier, (VALUES (0), (1), (2)) t(seed)), de AS (SELECT case_id, avg((b - a)::double) AS delta, count(*) AS seeds FROM sc GROUP BY 1)"

ORACLES = {
    "answer_scores_unicode": r"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '[^\p{L}]', '', 'g')), lambda w: w <> '') AS w FROM documents), v AS (SELECT doc_id, doc_id % 6 AS way, replace(lower(w[1]), 'ß', 'ss') AS a, replace(lower(w[2]), 'ß', 'ss') AS b FROM d WHERE len(w) > 1),
s AS (SELECT *, 'the name is: ' || a || ' ' || b || '.' AS said, a || ' ' || b AS ab FROM v)
SELECT doc_id, CASE WHEN way = 3 THEN 'formula' WHEN way IN (2, 5) THEN 'set' ELSE 'text' END AS kind, CASE way WHEN 0 THEN 'PASS' WHEN 1 THEN CASE WHEN NOT regexp_matches(said, 'either|or|not|\bno\b|\bneither\b') AND length(said) - length(replace(said, ab, '')) = length(ab) THEN 'PASS' ELSE 'NEEDS_REVIEW' END
 WHEN 2 THEN 'PASS' WHEN 3 THEN 'PASS' WHEN 4 THEN CASE WHEN a = ab THEN 'PASS' ELSE 'NEEDS_REVIEW' END ELSE 'FAIL' END AS verdict FROM s""",
    "answer_scores": """SELECT p_partkey, CASE p_partkey % 8 WHEN 3 THEN 'set' WHEN 4 THEN 'set' WHEN 5 THEN 'text' WHEN 6 THEN 'abstain' ELSE 'numeric' END AS kind,
 CASE p_partkey % 8 WHEN 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'FAIL' ELSE 'PASS' END WHEN 1 THEN CASE WHEN p_partkey % 5 = 0 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END WHEN 2 THEN 'FAIL'
 WHEN 3 THEN 'PASS' WHEN 4 THEN 'FAIL' WHEN 5 THEN 'PASS' WHEN 6 THEN CASE WHEN p_partkey % 3 = 0 THEN 'PASS' ELSE 'FAIL' END ELSE 'FAIL' END AS verdict FROM part""",
    "grounding": """WITH x AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'unavailable' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'observed' ELSE 'needs_review' END AS s FROM orders)
SELECT s AS unsupported_status, count(*) AS n, CASE WHEN s = 'observed' THEN 0.0::double END AS total FROM x GROUP BY s""",
    "segment_answers": """WITH x AS (SELECT n % 6 = 0 AS ab, n % 3 AS v, n % 11 = 0 AS e, n % 4 AS c FROM (SELECT o_orderkey AS n FROM orders)),
y AS (SELECT CASE v WHEN 0 THEN 1.0::double WHEN 1 THEN 0.0::double END AS acc, CASE WHEN ab OR c = 3 THEN NULL WHEN v = 0 AND c = 0 THEN 1.0::double WHEN v = 1 THEN 0.0::double END AS gr, ab, e OR (v = 0 AND (c = 0 OR ab)) AS cl FROM x)
SELECT CASE WHEN acc IS NOT NULL THEN 'observed' ELSE 'needs_review' END AS accuracy_status, CASE WHEN ab THEN 'not_applicable' WHEN gr IS NOT NULL THEN 'observed' ELSE 'needs_review' END AS groundedness_status,
 CASE WHEN cl THEN 'observed' ELSE 'needs_review' END AS hallucination_status, count(*) AS n, sum(acc) AS accuracy, sum(gr) AS grounded FROM y GROUP BY 1, 2, 3""",
    "capability_faults": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'declared_but_missing' ELSE 'returned_but_not_declared' END AS fault FROM part
WHERE (p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 >= 2) OR (p_partkey % 2 = 1 AND p_partkey % 5 < 2)""",
    "expected_metrics": "SELECT m AS metric_id, CASE WHEN m = 'raw_mrr' AND o_orderkey % 5 <> 0 THEN 'observed' ELSE 'error' END AS status, count(*) AS n FROM orders, (VALUES ('raw_mrr'), ('ranked_mrr')) t(m) GROUP BY ALL",
    "portfolio_coverage": """WITH s AS (SELECT *, p_partkey % 5 AS st FROM part), a AS (SELECT 'p_brand' AS axis, p_brand AS category, st FROM s UNION ALL SELECT 'p_type', p_type, st FROM s UNION ALL SELECT 'size_class', (p_size // 10)::varchar, st FROM s
 UNION ALL SELECT 'words', unnest(string_split(p_name, ' ')), st FROM s UNION ALL SELECT 'brand_type', p_brand || '|' || p_type, st FROM s)
SELECT axis, category, count(*) AS planned, count(*) FILTER (st IN (2, 3)) AS completed, count(*) FILTER (st = 4) AS blocked, count(*) FILTER (st IN (0, 1)) AS missing FROM a GROUP BY ALL""",
    "judgments": "SELECT count(*) FILTER (toxic <> 1 AND quality = 1) AS n_supported, count(*) FILTER (toxic = 1) AS n_unsupported, count(*) FILTER (toxic <> 1 AND quality <> 1) AS n_needs_review, 0::bigint AS n_unavailable FROM labels",
    "representability": """WITH g AS (SELECT l_orderkey AS case_id, max(l_partkey % 3)::int AS code FROM lineitem GROUP BY l_orderkey, l_suppkey % 2, l_linenumber % 2)
SELECT case_id, min(code) AS code, ['UNOBSERVABLE', 'PARTIAL', 'FULL'][min(code) + 1] AS status FROM g GROUP BY 1""",
    "paired_deltas": f"WITH {_SCORES} SELECT case_id, round(delta, 9) AS delta, seeds FROM de",
    "bootstrap": f"""WITH {_SCORES}, nu AS (SELECT row_number() OVER (ORDER BY case_id) - 1 AS no, delta FROM de), n AS (SELECT count(*) AS n FROM de),
dr AS (SELECT it.range AS it, ('0x' || substr(md5('1:' || it.range || ':all:' || nu.no), 1, 15))::bigint % n AS no FROM nu, range(0, 1000) it, n),
me AS (SELECT it, sum(delta) / any_value(n) AS mean FROM dr JOIN nu USING (no), n GROUP BY 1)
SELECT (SELECT n FROM n) AS n_cases, round((SELECT avg(delta) FROM de), 9) AS estimate, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM me""",
    "stratified_bootstrap": f"""WITH {_SCORES}, nu AS (SELECT case_id % 3 AS st, row_number() OVER (PARTITION BY case_id % 3 ORDER BY case_id) - 1 AS no, count(*) OVER (PARTITION BY case_id % 3) AS n, delta FROM de),
dr AS (SELECT it.range AS it, st, n, ('0x' || substr(md5('1:' || it.range || ':' || st || ':' || no), 1, 15))::bigint % n AS no FROM nu, range(0, 10000) it),
sm AS (SELECT it, dr.st, avg(delta) AS mean FROM dr JOIN nu ON nu.st = dr.st AND nu.no = dr.no GROUP BY ALL), me AS (SELECT it, sum(mean * CASE st WHEN 1 THEN 2 ELSE 1 END) / 4 AS mean FROM sm GROUP BY 1),
es AS (SELECT sum(mean * CASE st WHEN 1 THEN 2 ELSE 1 END) / 4 AS e FROM (SELECT st, avg(delta) AS mean FROM nu GROUP BY 1))
SELECT (SELECT count(*) FROM nu) AS n_cases, round((SELECT e FROM es), 9) AS estimate, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM me""",
    "table_diff": """WITH x AS (SELECT c_custkey, c_custkey % 11 <> 3 AS o, c_custkey % 13 <> 5 AS n, c_custkey % 7 = 0 AND c_acctbal <> 0 AS b, c_custkey % 17 = 0 AS m FROM customer)
SELECT c_custkey, CASE WHEN NOT o THEN 'added' WHEN NOT n THEN 'removed' ELSE 'changed' END AS change, CASE WHEN o AND n THEN array_to_string(list_filter([CASE WHEN b THEN 'c_acctbal' END, CASE WHEN m THEN 'c_mktsegment' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS fields
FROM x WHERE (o OR n) AND (NOT o OR NOT n OR b OR m)""",
    "manifest_check": """SELECT 'p/' || p_partkey AS path, CASE p_partkey % 50 WHEN 3 THEN 'mismatched' ELSE 'missing' END AS fault FROM part WHERE p_partkey % 50 IN (1, 2, 3) UNION ALL SELECT 'p/' || p_partkey || '.tmp', 'unexpected' FROM part WHERE p_partkey % 50 = 2""",
    "config_drift": """WITH a AS (SELECT 'factor' || n_regionkey || '.' || n_name AS path, n_nationkey AS k FROM nation)
SELECT path, k::varchar AS a, CASE WHEN k % 4 = 0 THEN 'x' END AS b FROM a WHERE (k % 4 = 0 OR k = 7) AND NOT starts_with(path, 'factor1.') AND path <> 'factor2.NATION_2' AND NOT starts_with(path, 'factor2.NATION_2.')""",
    "incompatible_fields": "SELECT * FROM (SELECT 'o_orderstatus' AS field, count(DISTINCT o_orderstatus) AS n_values FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders) WHERE n_values > 1",
    "first_wins": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'archived' END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "policy_violations": """WITH l AS (SELECT *, l_orderkey || '-' || l_linenumber AS id FROM lineitem),
v AS (SELECT 'unique_key' AS rule_id, 'error' AS severity, id FROM l GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'known_order', 'error', id FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 101 <> 0)
 UNION ALL SELECT 'discount_bound', 'warning', id FROM l WHERE NOT l_discount <= 0.09 UNION ALL SELECT 'answer_leakage', 'error', p_partkey::varchar FROM part WHERE contains(replace(lower(p_name || CASE WHEN p_partkey % 9 = 0 THEN p_brand ELSE '' END), ' ', ''), lower(p_brand))
 UNION ALL SELECT 'runtime_parity', 'error', p_partkey::varchar FROM part WHERE p_partkey % 97 = 0)
SELECT rule_id, severity, count(*) AS n, min(id) AS first FROM v GROUP BY ALL""",
    "endpoint_types": """WITH o AS (SELECT n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN 'table' WHEN n_regionkey < 4 THEN 'row' ELSE 'cell' END AS t FROM nation),
r AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'contains' ELSE 'header_of' END AS kind, s.t AS st, t.t AS tt FROM nation LEFT JOIN o s ON s.id = n_nationkey LEFT JOIN o t ON t.id = (n_nationkey * 3 + 1) % 27)
SELECT 'endpoint_types' AS rule_id, 'error' AS severity, id::varchar AS affected_id FROM r WHERE NOT coalesce((kind, st, tt) IN (('contains', 'table', 'row'), ('contains', 'row', 'cell'), ('header_of', 'cell', 'cell')), false)""",
    "packed_once": """WITH b AS (SELECT p_partkey AS s, p_partkey // 10 AS d, (p_partkey + CASE WHEN p_partkey % 200 = 9 THEN 5 ELSE 0 END) // 5 AS b FROM part WHERE p_partkey % 31 <> 0)
SELECT 'packed_once' AS rule_id, 'error' AS severity, p_partkey::varchar AS affected_id FROM part WHERE p_partkey % 31 = 0 UNION ALL SELECT 'batch_of_one_document', 'error', b::varchar FROM b GROUP BY b HAVING count(DISTINCT d) > 1""",
    "lossiness": """WITH x AS (SELECT array_to_string(list_filter([CASE WHEN o_totalprice > 400000 THEN 'large' END, CASE WHEN starts_with(o_orderpriority, '1') THEN 'urgent' END, CASE WHEN o_orderkey % 2 = 1 THEN 'odd' END], lambda x: x IS NOT NULL), '+') AS reasons FROM orders)
SELECT reasons, reasons <> '' AS lossy, count(*) AS n FROM x GROUP BY ALL""",
    "clause_necessity": "SELECT DISTINCT 'clause_necessity' AS rule_id, 'error' AS severity, l_orderkey::varchar AS affected_id FROM lineitem WHERE l_linenumber = 7",
    "content_register": "SELECT p_type, sha256(string_agg(p_name || '/' || p_partkey || chr(0) || sha256(p_brand) || chr(10), '' ORDER BY p_name || '/' || p_partkey)) AS register_id FROM part GROUP BY 1",
    "path_expansion": f"""{TRACE_SQL}, q AS (SELECT case_id, count(*) FILTER (ln % 2 = 0) AS e, count(*) AS n FROM li GROUP BY 1)
SELECT case_id, (2 ** e)::bigint AS n_paths, CASE WHEN 2 ** e <= 1024 THEN 2 ** e END::bigint AS made, CASE WHEN 2 ** e <= 1024 THEN (2 ** e) * n + e * (2 ** e) / 2 END::bigint AS ids FROM q""",
    "config_merge": "SELECT n_nationkey, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE n_nationkey::varchar END AS key, 'y' AS more FROM nation",
}
