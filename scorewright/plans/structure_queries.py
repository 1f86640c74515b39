"""Queries of merged-cell tables and of document graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import forms
from scorewright.operators import aggregate, fragments, graph, grid

_KINDS = "CASE s % 23 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate([s[0] for s in graph.SHAPES if s[2] != "table" or s[0] != "caption_of"] + list(graph.FREE) + ["other"])) + " ELSE 'parent_child' END"
_TYPES = "CASE (k * 7 + 3) % 15 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(("document", "section", "section", "table", "row", "cell", "logical_row", "logical_column", "logical_cell", "caption", "reference", "figure", "media_resource", "paragraph"))) + " ELSE 'equation' END"
#: Inputs in SQL that Spark and DuckDB read alike: eight orders are a table, its rows their lines; twenty orders are a document.
INPUTS = {
    "ft": """SELECT l_suppkey % 40 AS table_id, CAST(row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS INT) AS "row", CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey % 90 END AS signature FROM {lineitem}""",
    "fp": """SELECT table_id * 1000 + "row" // 7 AS fragment_id, table_id, CAST("row" % 7 + 1 AS INT) AS "row", CASE WHEN table_id % 5 = 2 AND "row" % 31 = 4 THEN 991 ELSE signature END AS signature
 FROM (SELECT l_suppkey % 40 AS table_id, CAST(row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS INT) AS "row", CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey % 90 END AS signature FROM {lineitem}) t WHERE "row" % 7 < 1 + table_id % 4""",
    "gt": "SELECT DISTINCT o_orderkey // 8 AS table_id, CASE WHEN o_orderkey // 8 % 3 = 0 THEN 7 END AS grid_width, o_orderkey // 8 % 5 = 1 AS first_column_header FROM {orders}",
    "gr": """SELECT o_orderkey // 8 AS table_id, CAST(o_orderkey % 8 + 1 AS INT) AS "row", CASE WHEN o_orderkey % 41 = 3 THEN 1 WHEN o_orderkey % 83 = 4 THEN -1 ELSE 0 END AS grid_before, CASE WHEN o_orderkey % 59 = 5 THEN 2 ELSE 0 END AS grid_after,
 o_orderkey % 8 < o_orderkey // 8 % 3 OR o_orderkey % 101 = 7 AS is_header FROM {orders}""",
    "gc": """SELECT l_orderkey // 8 AS table_id, CAST(l_orderkey % 8 + 1 AS INT) AS "row", CAST(l_linenumber AS INT) AS ordinal, CAST(CASE WHEN l_partkey % 397 = 1 THEN 0 WHEN (l_orderkey // 8 + l_linenumber) % 5 = 0 OR l_suppkey % 19 = 2 AND l_partkey % 5 = 0 THEN 2 ELSE 1 END AS INT) AS span,
 CASE WHEN l_partkey % 389 = 2 THEN 'odd' WHEN (l_orderkey // 8 + l_linenumber) % 3 = 0 THEN CASE WHEN l_orderkey % 4 = 1 THEN 'restart' WHEN l_orderkey % 4 > 1 THEN 'continue' END END AS v_merge, 't' || l_partkey AS text
 FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l""",
    "gd": "SELECT DISTINCT o_orderkey // 20 AS document_id FROM {orders}",
    "go": f"""SELECT o_orderkey // 20 AS bundle_id, CASE WHEN o_orderkey % 211 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS object_id, CASE WHEN o_orderkey % 173 = 4 THEN -1 ELSE o_orderkey // 20 END AS document_id, {_TYPES.replace('k * 7', 'o_orderkey * 7')} AS object_type,
 CASE WHEN o_orderkey % 151 = 5 THEN o_orderkey - 1 ELSE o_orderkey END AS document_order FROM {{orders}}""",
    "ge": f"""SELECT l_orderkey // 20 AS bundle_id, CASE WHEN s % 1013 = 7 THEN 0 ELSE l_orderkey * 10 + l_linenumber END AS relation_id, CASE WHEN p % 509 = 8 THEN -1 ELSE l_orderkey // 20 END AS document_id, {_KINDS} AS kind, l_orderkey AS source_id,
 CASE WHEN p % 307 = 9 THEN -5 WHEN p % 2 = 0 THEN (l_orderkey // 20) * 20 + (l_orderkey + 1) % 20 ELSE (l_orderkey // 20) * 20 + p % 20 END AS target_id FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey + l_partkey) AS s FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) l""",
}


def _inputs(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    out = []
    for n in names:
        t = "lineitem" if "{lineitem}" in INPUTS[n] else "orders"
        q = INPUTS[n].replace("//", " div ").replace('"row"', "`row`").replace("{" + t + "}", "{it}")
        out.append(spark.sql(q, it=spark.read.parquet(f"{sf_dir}/{t}.parquet")))
    return out


def merged_grid_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_errors(*_inputs(spark, sf_dir, "gt", "gr", "gc"))


def merged_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.logical_cells(*_inputs(spark, sf_dir, "gt", "gr", "gc")).withColumn("header_path", F.array_join("header_path", "/"))


def merged_grid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_tables(*_inputs(spark, sf_dir, "gt", "gr", "gc"))


def document_graph_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_faults(*_inputs(spark, sf_dir, "gd", "go", "ge"))


def table_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, parts = _inputs(spark, sf_dir, "ft", "fp")
    return fragments.fragment_rows(parts, full)


def portfolio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    state = F.element_at(F.array(*map(F.lit, ("planned", "authored", "approved", "frozen", "blocked"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    slots = p.select("p_brand", "p_type", F.split("p_name", " ").alias("words"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4).alias("level"), state.alias("state"), (F.col("p_partkey") % 3 > 0).alias("planned"), (F.col("p_partkey") % 5).isin(2, 3).alias("completed"))
    return aggregate.coverage_report(slots, ["p_brand", "p_type", "words", "level"], [("p_brand", "level"), ("level", "words")])


def normal_form_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("form", forms.offset_form("text"))
    wanted = forms.normal_text(F.concat(F.lit("  "), F.regexp_replace(F.substring("text", 31, 25), " ", "\n \t")))
    start = F.when(F.col("doc_id") % 2 == 0, 5).otherwise(40)
    spans = d.select("doc_id", F.char_length("form.text").cast("long").alias("n"), F.size("form.offsets").cast("long").alias("n_offsets"), forms.raw_span(F.col("form"), wanted, start).alias("s"))
    return spans.select("doc_id", "n", "n_offsets", "s.start", "s.end")


QUERIES = {f.__name__: f for f in (table_fragments, portfolio_report, normal_form_spans, merged_grid_errors, merged_grid_cells, merged_grid_tables, document_graph_faults)}

_IN = ", ".join(f"{n} AS ({q})" for n, q in INPUTS.items()).replace("{orders}", "orders").replace("{lineitem}", "lineitem")
_GRID = f"""{_IN}, c0 AS (SELECT c.*, greatest(span, 1) AS wide, CASE WHEN v_merge IN ('restart', 'continue') THEN v_merge ELSE 'none' END AS merge, greatest(grid_before, 0) AS off FROM gc c JOIN gr r ON r.table_id = c.table_id AND r."row" = c."row"),
c1 AS (SELECT *, (1 + off + coalesce(sum(wide) OVER (PARTITION BY table_id, "row" ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::int AS col FROM c0),
ac AS (SELECT table_id, "row", ordinal, col, wide, "row" AS origin FROM c1 WHERE merge = 'restart' UNION ALL SELECT c1.table_id, c1."row", c1.ordinal, c1.col, c1.wide, ac.origin FROM ac JOIN c1 ON c1.table_id = ac.table_id AND c1."row" = ac."row" + 1 AND c1.col = ac.col AND c1.wide = ac.wide AND c1.merge = 'continue'),
pl AS (SELECT c1.*, col + wide - 1 AS last, CASE WHEN merge = 'continue' THEN (SELECT origin FROM ac WHERE ac.table_id = c1.table_id AND ac."row" = c1."row" AND ac.ordinal = c1.ordinal) ELSE "row" END AS origin FROM c1),
lost AS (SELECT *, EXISTS (SELECT 1 FROM ac WHERE ac.table_id = pl.table_id AND ac."row" = pl."row" - 1 AND ac.col <= pl.col AND pl.last <= ac.col + ac.wide - 1) AS inside FROM pl WHERE origin IS NULL),
w AS (SELECT table_id, "row", max(last) AS last FROM pl GROUP BY ALL), hd AS (SELECT table_id, count(*) AS n, max("row") AS last FROM gr WHERE is_header GROUP BY 1),
er AS (SELECT table_id, "row", ordinal, 'invalid_effective_span' AS error FROM pl WHERE span < 1 UNION ALL SELECT table_id, "row", ordinal, 'invalid_vMerge' FROM pl WHERE v_merge = 'odd' UNION ALL SELECT table_id, "row", ordinal, 'grid_overflow' FROM pl JOIN gt USING (table_id) WHERE last > grid_width
 UNION ALL SELECT table_id, "row", ordinal, CASE WHEN inside THEN 'vMerge_span_mismatch' ELSE 'orphan_or_ambiguous_vMerge_continue' END FROM lost UNION ALL SELECT table_id, "row", NULL, 'invalid_row_grid_offset' FROM gr WHERE grid_before < 0
 UNION ALL SELECT table_id, "row", NULL, 'grid_offset' FROM gr WHERE grid_before >= 0 AND grid_before + grid_after > 0 UNION ALL SELECT gr.table_id, gr."row", NULL, 'empty_physical_row' FROM gr ANTI JOIN gc ON gc.table_id = gr.table_id AND gc."row" = gr."row"
 UNION ALL SELECT w.table_id, w."row", NULL, 'grid_width_mismatch' FROM w JOIN gr ON gr.table_id = w.table_id AND gr."row" = w."row" JOIN gt ON gt.table_id = w.table_id WHERE w.last + CASE WHEN grid_before < 0 THEN 0 ELSE grid_after END <> grid_width UNION ALL SELECT table_id, NULL, NULL, 'non_contiguous_explicit_header_rows' FROM hd WHERE n <> last),
lc AS (SELECT table_id, origin AS "row", col, max("row") AS row_end, wide, arg_min(text, "row") AS text FROM pl WHERE origin IS NOT NULL GROUP BY table_id, origin, col, wide),
lt AS (SELECT lc.*, first_column_header AS side, coalesce(CASE WHEN n = last THEN n END, 0) AS heads FROM lc JOIN gt USING (table_id) LEFT JOIN hd USING (table_id)),
hp AS (SELECT a.table_id, a."row", a.col, list(DISTINCT {{'a': CASE WHEN h."row" <= a.heads AND a."row" > a.heads AND h.col <= a.col AND a.col < h.col + h.wide THEN 0 ELSE 1 END, 'r': h."row", 't': h.text}}) AS p FROM lt a JOIN lt h ON h.table_id = a.table_id
 AND ((h."row" <= a.heads AND a."row" > a.heads AND h.col <= a.col AND a.col < h.col + h.wide) OR (a.side AND a.col > 1 AND h.col = 1 AND h."row" <= a."row" AND a."row" <= h.row_end)) GROUP BY ALL),
ou AS (SELECT lt.table_id, lt."row", lt.col AS "column", row_end, wide AS span, text, row_end <= heads OR (side AND lt.col <= 1) AS is_header, lt."row" > heads AND (NOT side OR lt.col > 1) AS is_data, coalesce(array_to_string(list_transform(list_sort(p), lambda x: x.t), '/'), '') AS header_path,
 CASE WHEN lt.table_id IN (SELECT table_id FROM er) THEN 'partial' ELSE 'supported' END AS status FROM lt LEFT JOIN hp ON hp.table_id = lt.table_id AND hp."row" = lt."row" AND hp.col = lt.col)"""
_SHAPES = ", ".join(f"('{k}', '{s}', '{t}')" for k, s, t in graph.SHAPES if t)
_BOUND = ", ".join(f"'{k}'" for k in sorted({s[0] for s in graph.SHAPES}))
_PLAIN = "translate({}, chr(10) || chr(9) || chr(13), '   ')"
ORACLES = {
    "table_fragments": f"""WITH {_IN}, n AS (SELECT fragment_id, table_id, count(*) AS n, min("row") AS low FROM fp GROUP BY ALL), a AS (SELECT f.fragment_id, f.table_id, t."row" - f."row" AS shift, count(*) AS k FROM fp f JOIN ft t ON t.table_id = f.table_id AND t.signature = f.signature GROUP BY ALL),
w AS (SELECT n.fragment_id, n.table_id, count(k) AS places, min(low + shift) AS first, min(low + shift + n - 1) AS last FROM n LEFT JOIN a ON a.fragment_id = n.fragment_id AND a.table_id = n.table_id AND k = n GROUP BY ALL)
SELECT fragment_id, table_id, CASE WHEN places = 1 THEN first END AS first, CASE WHEN places = 1 THEN last END AS last, places FROM w""",
    "portfolio_report": """WITH s AS (SELECT p_brand, p_type, list_distinct(string_split(p_name, ' ')) AS words, CASE WHEN p_size % 4 > 0 THEN (p_size % 4)::varchar END AS level, p_partkey % 5 = 4 AS b, p_partkey % 3 > 0 AS p, p_partkey % 5 IN (2, 3) AS c FROM part),
e AS (SELECT 'p_brand' AS axis, p_brand AS value, b, p, c FROM s UNION ALL SELECT 'p_type', p_type, b, p, c FROM s UNION ALL SELECT 'words', unnest(words), b, p, c FROM s UNION ALL SELECT 'level', level, b, p, c FROM s UNION ALL SELECT 'p_brand|level', p_brand || '|' || level, b, p, c FROM s UNION ALL SELECT 'level|words', level || '|' || unnest(words), b, p, c FROM s),
g AS (SELECT axis, value, count(*) FILTER (p) AS planned, count(*) FILTER (c) AS completed, count(*) FILTER (b) AS blocked FROM e WHERE value IS NOT NULL GROUP BY ALL)
SELECT *, greatest(planned - completed, 0) AS missing, greatest(completed - planned, 0) AS overrepresented, planned > completed OR blocked > 0 AS deficit FROM g""",
    "normal_form_spans": f"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 40 END AS st, trim(regexp_replace(substr(text, 31, 25), '\\s+', ' ', 'g')) AS q FROM documents), b AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t,
 regexp_extract(substr(text, st + 1), replace(regexp_escape(q), '\\ ', '\\s+')) AS m FROM d)
SELECT doc_id, length(t) AS n, length(t) AS n_offsets, CASE WHEN q <> '' AND m <> '' THEN (st + position(m IN substr(text, st + 1)) - 1)::int END AS start, CASE WHEN q <> '' AND m <> '' THEN (st + position(m IN substr(text, st + 1)) - 1 + length(m))::int END AS "end" FROM b""",
    "merged_grid_errors": f"WITH RECURSIVE {_GRID} SELECT * FROM er",
    "merged_grid_cells": f"WITH RECURSIVE {_GRID} SELECT * FROM ou",
    "merged_grid_tables": f"""WITH RECURSIVE {_GRID}, n AS (SELECT table_id, count(*) AS errors FROM er GROUP BY 1), p AS (SELECT table_id, count(*) AS cells, count(*) FILTER (row_end > "row" OR span > 1) AS merged, bool_or(is_header) AS head, bool_or(is_data) AS data FROM ou GROUP BY 1)
SELECT table_id, CASE WHEN errors IS NULL THEN 'supported' ELSE 'partial' END AS status, coalesce(errors, 0) AS errors, coalesce(cells, 0) AS cells, coalesce(merged, 0) AS merged, errors IS NULL AND coalesce(head AND data, false) AS eligible FROM gt LEFT JOIN n USING (table_id) LEFT JOIN p USING (table_id)""",
    "document_graph_faults": f"""WITH RECURSIVE {_IN}, one AS (SELECT bundle_id AS b, object_id, min({{'o': document_order, 't': object_type}}) AS x FROM go GROUP BY ALL),
j0 AS (SELECT r.*, r.bundle_id AS b, s.x.t AS st, t.x.t AS tt, s.x.o AS so, t.x.o AS "to" FROM ge r LEFT JOIN one s ON s.b = r.bundle_id AND s.object_id = source_id LEFT JOIN one t ON t.b = r.bundle_id AND t.object_id = target_id), j AS (SELECT * FROM j0 WHERE st IS NOT NULL AND tt IS NOT NULL),
tr AS (SELECT DISTINCT b, source_id, target_id FROM j WHERE kind = 'parent_child'), up AS (SELECT b, target_id AS n, min(source_id) AS p FROM tr GROUP BY ALL), an AS (SELECT b, n, p FROM up UNION SELECT an.b, an.n, up.p FROM an JOIN up ON up.b = an.b AND up.n = an.p),
ri AS (SELECT b, n FROM an WHERE n = p),
f AS (SELECT bundle_id AS b, 'repeated_object' AS fault, object_id AS id FROM go GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT bundle_id, 'repeated_order', document_order FROM go GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT bundle_id, 'repeated_relation', relation_id FROM ge GROUP BY ALL HAVING count(*) > 1
 UNION ALL SELECT bundle_id, 'object_of_another_document', object_id FROM go WHERE document_id <> bundle_id UNION ALL SELECT bundle_id, 'relation_of_another_document', relation_id FROM ge WHERE document_id <> bundle_id
 UNION ALL SELECT document_id, 'no_document_object', document_id FROM gd WHERE document_id NOT IN (SELECT bundle_id FROM go WHERE object_type = 'document') UNION ALL SELECT b, 'unknown_end', relation_id FROM j0 WHERE st IS NULL OR tt IS NULL
 UNION ALL SELECT b, kind, relation_id FROM j WHERE kind IN ({_BOUND}) AND NOT CASE kind WHEN 'reference_to' THEN st = 'reference' ELSE (kind, st, tt) IN ({_SHAPES}) END UNION ALL SELECT b, 'unknown_kind', relation_id FROM j WHERE kind = 'other' UNION ALL SELECT b, 'document_order', relation_id FROM j WHERE kind = 'document_order' AND so >= "to"
 UNION ALL SELECT b, 'sibling_without_shared_parent', relation_id FROM j WHERE kind = 'sibling' AND NOT EXISTS (SELECT 1 FROM tr x JOIN tr y ON x.b = y.b AND x.source_id = y.source_id WHERE x.b = j.b AND x.target_id = j.source_id AND y.target_id = j.target_id)
 UNION ALL SELECT b, 'hierarchy_without_parent_child', relation_id FROM j WHERE kind = 'section_hierarchy' AND (b, source_id, target_id) NOT IN (SELECT b, source_id, target_id FROM tr)
 UNION ALL SELECT b, 'several_parents', target_id FROM tr GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT an.b, 'parent_cycle', an.n FROM an JOIN ri ON ri.b = an.b AND ri.n = an.p)
SELECT b AS document_id, fault, id::varchar AS affected_id FROM f""",
}
