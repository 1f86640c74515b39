"""Steps whose work has to grow with the input: what they read, parse, join and shuffle, with the results of a plain definition."""

import json
import random

from pyspark.sql import functions as F

from scorewright.functions import forms, text
from scorewright.operators import align, compare, dedup, fragments, graph, grid, locators, provenance, records
from scorewright.plans import admission_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_json_records_are_parsed_once(spark):
    docs = [(1, '{"table_id": "t", "row": 1, "column": 2, "value": "A"}\n{"object_type": "table", "object_id": 5}'), (2, '\n{"object_type": "table",\n "object_id": "o"}\n'), (3, "no json\n[1"), (4, None)]
    kinds = "evidence_id int, document_id int, formal boolean, type string, start int, end int, object_type string, object_id string, table_id string, row int, column int, page int, x0 double, y0 double, x1 double, y1 double, quote string, value string"
    cell, thing = (None, None, None, None, "t", 1, 2, *[None] * 6), (None, None, "table", "o", None, None, None, *[None] * 6)
    rows = [(1, 1, True, "table_cell", *cell, "a"), (2, 1, True, "table_cell", *cell, "zz"), (3, 1, True, "object", *thing, None), (4, 2, True, "object", *thing, None), (5, 3, True, "object", *thing, None), (6, 4, True, "object", *thing, None)]
    out = locators.locator_faults(spark.createDataFrame(rows, kinds), spark.createDataFrame(docs, "document_id int, text string"))
    assert sorted(r.evidence_id for r in out.collect()) == [2, 3, 5, 6]
    assert "parse" not in plan(out)  # the walk keeps its values; nothing parses its records again


def test_records_of_lines_and_whole_texts(spark):
    texts = ['{"a": 1}\n', '{"a": 1}\n \r\n', '\n{"a": 1}', '\n{"a": 1}\n{"b": 2}', '{\n"a": 1}', '{"a": 1}\n]', '{"a": 1}\r{"b": 2}', '1\n{"a": 1}', 'x\n{"a": 1}', ' {"a": {"b": 1}} ', '{"a": 1},\n{"b": 2}', '"s\n{"a": 1}']
    want = []
    for i, text in enumerate(texts):
        for no, part in [(0, text)] + list(enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))):
            try:
                value = json.loads(part)
            except ValueError:
                continue
            found = [value, *value.values()] if isinstance(value, dict) else []
            want += [(i, no, json.dumps(v, sort_keys=True)) for v in found if isinstance(v, dict)]
            if part == text:
                break
    got = [(r.text_id, r.value_no, json.dumps(json.loads(r.record), sort_keys=True)) for r in records.walked(spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")).collect()]
    assert sorted(got) == sorted(want)


def place_tables(spark, n):
    """n orders with one span each at the same place of one document, and n catalog objects there, in chunks 0 to 4."""
    gold = spark.range(n).selectExpr("id AS case_id", "1 AS evidence_id", "0 AS map_id", "0 AS document_id", "CAST(NULL AS BIGINT) AS object_id", "false AS is_table", "5 AS start", "9 AS end", "'' AS quote", "false AS quote_unique", "false AS corpus_unique")
    items = spark.range(n).selectExpr("id AS case_id", "'raw' AS stage", "id AS item_id", "1 AS rank", "0 AS document_id", "CAST(id % 5 AS INT) AS chunk_id")
    known = spark.range(n).selectExpr("0 AS map_id", "0 AS document_id", "id AS object_id", "array(named_struct('start', 5, 'end', 9)) AS ranges", "CAST(NULL AS BIGINT) AS table_id", "5 AS start", "9 AS end", "id % 2 = 0 AS complete")
    edges = spark.range(n).selectExpr("0 AS map_id", "id AS object_id", "CAST(id % 5 AS INT) AS chunk_id", "0 AS document_id", "IF(id % 3 = 0, 'full', 'partial') AS coverage", "5 AS start", "9 AS end")
    claims = spark.createDataFrame([(3, "raw", 3, 0, 0, 18, "full", 0, 1, 0, 1), (3, "raw", 3, 0, 1, 3, "full", 5, 9, 5, 9)], "case_id long, stage string, item_id long, source int, place int, object_id long, coverage string, start int, end int, e_start int, e_end int")
    return gold, items, known, edges, claims


def joined_rows(df):
    """The most rows that an operator of df has put out once it has run."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        for inner in ("executedPlan", "plan"):
            if type_name(p) in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec") and hasattr(p, inner):
                try:
                    todo.append(getattr(p, inner)())
                except Exception:
                    pass
        metric = p.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def type_name(plan_node):
    return plan_node.getClass().getSimpleName()


def test_golds_of_one_place_do_not_meet_its_objects(spark):
    n = 600
    gold, items, known, edges, claims = place_tables(spark, n)
    out = provenance.first_edges(items, gold, claims, edges, known)
    rows = {r.case_id: r for r in out.collect()}
    full = {c: [o for o in range(n) if o % 5 == c and o % 2 == 0 and o % 3 == 0] for c in range(5)}
    assert len(rows) == n and all(rows[k].n_full == len(full[k % 5]) and rows[k].led and rows[k].edge.object_id == k % 5 and rows[k].edge.source == 2 for k in range(n) if k != 3)
    assert rows[3].edge.source == 0 and rows[3].edge.object_id == 3 and rows[3].n_full == 1 and rows[3].full == [18]
    assert joined_rows(out) < 20 * n
    summary = provenance.target_summary(gold, known)
    assert {(r.n_targets, r.target.object_id) for r in summary.collect()} == {(n, 0)}


def test_what_is_dealt_by_case_is_not_shuffled_again(spark):
    """Items, golds and claims that are dealt by case already meet there: only what the catalog says of golds is moved to them."""
    tables = {"gold": "case_id long, evidence_id int, map_id int, document_id int, object_id int, start int, end int", "items": "case_id long, stage string, item_id int, document_id int, chunk_id int", "claims": "case_id long, stage string, item_id int, source int, place int, object_id int, coverage string, start int, end int, e_start int, e_end int"}
    rows = {
        "gold": [(1, 1, 0, 0, 7, None, None), (1, 2, 0, 0, None, 5, 9), (1, 3, 0, 0, 8, None, None), (2, 1, 0, 1, 9, None, None)],
        "items": [(1, "raw", 1, 0, 4), (1, "raw", 1, 0, 5), (1, "raw", 2, 1, 4), (1, "raw", 3, 0, 6), (2, "raw", 1, None, 4)],
        "claims": [(1, "raw", 1, 1, 3, 8, "full", 1, 2, 0, 0), (1, "raw", 1, 0, 4, 8, None, None, None, 0, 0), (1, "raw", 3, 1, 1, 1, "partial", 4, 9, 0, 0), (1, "raw", 3, 1, 2, 1, "partial", 0, 1, 5, 9), (1, "raw", 2, 1, 1, 7, "full", 0, 1, 0, 0), (2, "raw", 1, 0, 1, 9, "full", 0, 1, 0, 0)],
    }
    frames = {n: spark.createDataFrame(rows[n], kinds).repartition(4, "case_id") for n, kinds in tables.items()}
    known = spark.createDataFrame([(0, 0, 7, [(0, 9)], True, None, None), (0, 1, 7, [(0, 9)], True, None, None)], "map_id int, document_id int, object_id int, ranges array<struct<start: int, end: int>>, complete boolean, start int, end int")
    edges = spark.createDataFrame([(0, 7, 4, None, "full", 1, 2), (0, 7, 5, 0, "partial", 3, 4), (0, 7, 6, 1, "full", 1, 2)], "map_id int, object_id int, chunk_id int, document_id int, coverage string, start int, end int")
    out = provenance.first_edges(frames["items"], frames["gold"], frames["claims"], edges, known)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning(case_id" in x and "stage" in x.split("hashpartitioning", 1)[1].split(")")[0] for x in text.splitlines())
    got = {(r.case_id, r.item_id, r.evidence_id): (tuple(r.edge), r.n_full, r.full, [tuple(p) for p in r.parts], r.led) for r in out.collect()}
    assert got == {
        (1, 1, 1): ((2, 0, 7, "full", 1, 2), 0, [], [(7, 3, 4)], True), (1, 1, 3): ((0, 4, 8, None, None, None), 0, [], [], False), (1, 3, 2): ((1, 1, 1, "partial", 4, 9), 0, [], [], False),
    }


def test_misses_of_spans(spark):
    gold, items, known, edges, _ = place_tables(spark, 30)
    stages = items.select("case_id", "stage")
    missed = lambda e, i=items: {r.case_id for r in provenance.proven_misses(stages, gold, i, e, known).collect()}
    assert missed(edges) == set(range(30))
    one = edges.withColumn("chunk_id", F.lit(1))  # every object only in chunk 1
    assert missed(one) == {k for k in range(30) if k % 5 != 1}
    two = one.union(edges.withColumn("chunk_id", F.lit(2)))  # and in chunk 2: counted twice by chunks 1 and 2, yet all are led to
    both = items.union(items.withColumn("chunk_id", F.lit(2)))
    assert missed(two, both) == set() and missed(two) == {k for k in range(30) if k % 5 not in (1, 2)}
    assert missed(two.withColumn("coverage", F.lit(None).cast("string"))) == set()


def test_exclusions_list_every_object(spark):
    gold, items, known, _, _ = place_tables(spark, 40)
    chunks = spark.createDataFrame([(0, c, 0, c * 5, c * 5 + 4, "verified", "full") for c in range(5)], "map_id int, chunk_id int, document_id int, span_start int, span_end int, span_status string, attribution string")
    got = sorted((r.case_id, r.object_id) for r in provenance.exclusions(items, gold, known, chunks).collect())
    assert got == sorted((c, o) for c in range(40) if c % 5 != 1 for o in range(0, 40, 2))


def test_candidates_of_similar_sets_are_few(spark):
    """200 sets share ten of their rarer words each with the others of a row, yet none is like another but two: pairs are told apart before they are shuffled or compared."""
    import random

    rng = random.Random(5)
    rows = [(i, [f"c{i // 20}.{k}" for k in range(10)] + [f"u{i}.{k}" for k in range(10)] + [f"f{rng.randrange(200)}" for _ in range(60)]) for i in range(200)]
    rows.append((200, rows[7][1][:-1] + ["other"]))
    sets = spark.createDataFrame([(i, sorted(set(t))) for i, t in rows], "id int, tokens array<string>").repartition(4)
    out = dedup.similar_sets(sets, 0.75)
    want = [(a, b) for a, s in rows for b, t in rows if a < b and len(set(s) & set(t)) >= 0.75 * len(set(s) | set(t))]
    assert sorted((r.a, r.b) for r in out.collect()) == want == [(7, 200)]
    assert "bit_count" in plan(out)


def test_similar_sets_of_any_size_and_order(spark):
    import random

    rng = random.Random(11)
    base = [f"w{k}" for k in range(700)]
    rows = []
    for i in range(120):
        size = rng.choice([1, 2, 3, 4, 9, 40, 300, 650])
        rows.append((i, sorted({*rng.sample(base[:size + size // 6 + 1], size)})))
    sets = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(4)
    for threshold in (0.5, 0.75, 0.9):
        reps = {}
        for i, t in rows:
            reps.setdefault(tuple(t), []).append(i)
        want = [(a[0], b) for a in reps.values() for b in a[1:]]
        firsts = [(ids[0], set(t)) for t, ids in reps.items()]
        want += [(a, b) for a, s in firsts for b, t in firsts if a < b and len(s & t) / len(s | t) >= threshold - 1e-12]
        assert sorted((r.a, r.b) for r in dedup.similar_sets(sets, threshold).collect()) == sorted(want)


def test_bootstrap_draws_are_not_shuffled(spark, monkeypatch):
    rows = [(i, str(i % 3), (i * 7 % 11) / 3 - 1) for i in range(200)]
    deltas = spark.createDataFrame(rows, "case_id int, stratum string, delta double")
    out = compare.stratified_bootstrap(deltas, 50, weights={"0": 1.0, "1": 2.0, "2": 1.0})
    assert "times" not in plan(out)  # only sums by iteration leave a task
    small = out.first()
    monkeypatch.setattr(compare, "BROADCAST_CASES", 0)
    large = compare.stratified_bootstrap(deltas, 50, weights={"0": 1.0, "1": 2.0, "2": 1.0}).first()
    assert [round(x, 9) for x in small] == [round(x, 9) for x in large]


def test_fragments_of_frequent_signatures(spark):
    """Equal fragments of frequent signatures cost no rows each; gaps, nulls, long fragments and unknown signatures keep the places of a plain search."""
    import random

    rng = random.Random(3)
    tables = {t: [rng.choice([0, 0, 1, 2]) for _ in range(120)] for t in range(3)}
    tables[2][7] = None
    parts, no = {}, 0
    for t, rows in tables.items():
        for n in (1, 2, 3, 5, 6, 40):
            for at in (0, 17, 33, 120 - n):
                parts[no, t], no = [(9 + k, x) for k, x in enumerate(rows[at:at + n])], no + 1
        parts[no, t], no = [(1, rows[4]), (3, rows[6])], no + 1
        parts[no, t], no = [(1, 77), (2, rows[6])], no + 1
        parts[no, t], no = [(1, None)], no + 1
    full = spark.createDataFrame([(t, k + 1, x) for t, rows in tables.items() for k, x in enumerate(rows)], "table_id int, row int, signature int")
    some = spark.createDataFrame([(f, t, r, x) for (f, t), rows in parts.items() for r, x in rows], "fragment_id int, table_id int, row int, signature int")
    want = []
    for (f, t), rows in parts.items():
        low, n = rows[0][0], rows[-1][0] - rows[0][0]
        hits = [at for at in range(120 - n) if all(x is not None and tables[t][at + r - low] == x for r, x in rows)]
        end = len(rows) - 1
        want.append((f, t, hits[0] + 1 if len(hits) == 1 else None, hits[0] + 1 + end if len(hits) == 1 else None, len(hits)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in fragments.fragment_rows(some, full).collect())
    n = 2000
    full = spark.range(1, n + 1).selectExpr("0 AS table_id", "CAST(id AS INT) AS row", "0 AS signature")
    some = spark.range(n).selectExpr("id AS fragment_id", "0 AS table_id", "1 AS row", "0 AS signature")
    out = fragments.fragment_rows(some, full)
    assert joined_rows(out) < 20 * n and {r.places for r in out.collect()} == {n}


def test_forms_are_made_in_shares(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(forms, "_TOGETHER", 20)
    texts = ["<b>a</b>  c", None, "", "x" * 50, "ﬁ\n\n&amp;", "end"]
    parts = list(forms._forms.func(iter([pa.array(texts), pa.array(["z"])])))
    assert len(parts) > 3 and max(len(p) for p in parts) < len(texts)  # never a whole batch at once
    rows = [x for p in parts for x in p.to_pylist()]
    assert rows[1] is None and rows[2] == {"text": "", "offsets": []} and rows[6] == {"text": "z", "offsets": [0]}
    assert rows[0] == {"text": "a c", "offsets": [1, 2, 5]} and rows[3]["offsets"] == list(range(50)) and rows[4] == {"text": "fi &", "offsets": [0, 0, 1, 3]}
    assert [x for p in forms._normal.func(iter([pa.array(texts)])) for x in p.to_pylist()] == ["a c", None, "", "x" * 50, "fi &", "end"]


def test_edges_of_both_directions_meet_once(spark):
    kinds = "map_id int, object_id int, chunk_id int, document_id int, coverage string, start int, end int"
    forward = spark.createDataFrame([(1, 1, 1, 5, "full", 0, 9), (1, 2, 1, None, "full", None, None), (1, 3, 1, 5, "full", 0, 9), (1, 4, 2, 5, None, None, None), (1, None, 1, 5, "full", 0, 9)], kinds)
    reverse = spark.createDataFrame([(1, 1, 1, None, None, 0, 9), (1, 2, 1, 6, "full", 1, 2), (1, 3, 1, 5, "partial", 0, 9), (1, 6, 1, 5, "full", 0, 9), (1, None, 1, 5, "full", 0, 9)], kinds)
    chunks, known = spark.createDataFrame([(1, 1, 5)], "map_id int, chunk_id int, document_id int"), spark.createDataFrame([(1, o, 5) for o in (1, 3, 6)], "map_id int, object_id int, document_id int")
    out = provenance.edge_faults(forward, reverse, chunks, known)
    assert plan(out).count("join") == 2
    assert sorted((r.object_id or 0, r.direction, r.fault) for r in out.collect()) == [
        (0, "forward", "no_reverse_edge"), (0, "reverse", "no_forward_edge"), (2, "forward", "edges_differ"), (2, "reverse", "document_differs"), (3, "forward", "edges_differ"), (3, "reverse", "edges_differ"),
        (4, "forward", "no_chunk"), (6, "reverse", "no_forward_edge"),
    ]


def test_chunks_of_lineage_take_one_pass(spark):
    from scorewright.plans import mapping_queries

    chunks = plan(mapping_queries.lineage_chunks(spark, "/root/testdata/sf0.001"))
    assert chunks.count("arrowevalpython") <= 3  # one pass over the atoms for all counts of a chunk; there were three


def test_atoms_stay_with_their_chunk(spark):
    """Atoms and chunks are dealt by chunk once; what is chosen for atoms comes to the chunk, and no atom is shuffled by its place."""
    from scorewright.plans import mapping_queries

    for query in (mapping_queries.lineage_edges, mapping_queries.lineage_chunks):
        moved = [x for x in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert moved and not any("place#" in x for x in moved)


def test_items_meet_golds_by_case(spark):
    """Tables that are dealt by case are not shuffled again for the golds' ranks; of several items of a gold the least rank counts."""
    from scorewright.operators import mses

    gold = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 0, 2), (1, 1, 0, 3), (3, 0, 0, 1)], "case_id long, path int, clause int, evidence_id int").repartition(4, "case_id")
    items = spark.createDataFrame([(1, "raw", 1, 4), (1, "raw", 1, 2), (1, "raw", 2, 9), (1, "ranked", 3, 1), (1, "raw", None, 1), (3, "raw", 1, None)], "case_id long, stage string, evidence_id int, rank int").repartition(4, "case_id")
    stages = spark.createDataFrame([(1, "raw"), (1, "ranked"), (2, "raw"), (3, "raw")], "case_id long, stage string").repartition(4, "case_id")
    out = mses.paths_at(gold, items, stages, (3, None))
    assert "ENSURE_REQUIREMENTS" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(1, "raw", 0, 1, 1, 1, 2, 2), (1, "raw", 1, 1, 0, 0, None, None), (1, "ranked", 0, 1, 0, 0, None, None), (1, "ranked", 1, 1, 1, 1, 1, 1), (2, "raw", None, 0, 0, 0, None, None), (3, "raw", 0, 1, 0, 0, None, None)], key=str)


def test_document_graph_meets_its_ends_once(spark):
    objects = [("d", i, "d", "section", i) for i in range(6)]
    relations = [("d", 1, "d", "parent_child", 0, 1), ("d", 2, "d", "parent_child", 0, 2), ("d", 3, "x", "sibling", 1, 2), ("d", 0, "d", "sibling", 2, 1), ("d", 0, "d", "sibling", 4, 5), ("d", 4, "d", None, 1, 2), ("d", 5, "x", "sibling", 1, 9), ("d", 6, "d", "document_order", 3, 3)]
    o = spark.createDataFrame(objects, "bundle_id string, object_id long, document_id string, object_type string, document_order long")
    r = spark.createDataFrame(relations, "bundle_id string, relation_id long, document_id string, kind string, source_id long, target_id long")
    out = graph.graph_faults(spark.createDataFrame([("d",)], "document_id string"), o, r)
    assert plan(out).count("join leftouter") == 2
    want = [("no_document_object", "d"), ("repeated_relation", "0"), ("sibling_without_shared_parent", "0"), ("relation_of_another_document", "3"), ("relation_of_another_document", "5"), ("unknown_end", "5"), ("unknown_kind", "4"), ("document_order", "6")]
    assert sorted((x.fault, x.affected_id) for x in out.collect()) == sorted(want)  # of two siblings with one id, that without a parent shows


def test_repeated_lines_are_aligned_without_their_pairs(spark):
    n = 300
    docs = spark.createDataFrame([(1, "same\n" * n + "- last"), (2, "a\nb")], "document_id int, text string")
    rows = [(1, k, k + 1, "paragraph", None, "same", None) for k in range(n)] + [(1, n, n + 1, "list_item", None, "last", None), (2, 1, 1, "paragraph", None, "b", None), (2, 2, 2, "paragraph", None, "a", None), (2, 3, 3, "paragraph", None, "b", "unsupported")]
    out = align.aligned(docs, spark.createDataFrame(rows, "document_id int, block_id int, body_ordinal int, kind string, level int, value string, status string"))
    got = {(r.document_id, r.block_id): tuple(r)[2:] for r in out.collect()}
    assert got == {(1, k): ("aligned", 5 * k, 5 * k + 4) for k in range(n)} | {(1, n): ("aligned", 5 * n + 2, 5 * n + 6), (2, 1): ("aligned", 2, 3), (2, 2): ("execution_line_not_found", None, None), (2, 3): ("unsupported_object", None, None)}
    assert joined_rows(out) <= 3 * (n + 5)  # not n * n / 2
    assert plan(out).count("join") == 1


def test_logical_cells_place_their_cells_twice_at_most(spark):
    rng, one = random.Random(5), lambda rare, *usual: rng.choice([rare] + 30 * list(usual))
    tables = [(t, rng.choice([None, 2, 3]), rng.choice([None, True, False])) for t in range(120)]
    rows = [(t, r, one(-1, 0), one(None, 0), r == 1 or rng.random() < 0.02) for t in range(119) for r in range(1, 4) if rng.random() < 0.98]
    cells = [(t, r, k, one(2, 1), one("odd", None, None, None, "restart", "continue" if r > 1 else None), f"{r}.{k}") for t in range(119) for r in range(1, 4) if rng.random() < 0.98 for k in range(1, rng.choice([3, 4]) if t % 3 == 0 else 4)]
    t = spark.createDataFrame(tables, "table_id int, grid_width int, first_column_header boolean")
    r = spark.createDataFrame(rows, "table_id int, row int, grid_before int, grid_after int, is_header boolean")
    c = spark.createDataFrame(cells, "table_id int, row int, ordinal int, span int, v_merge string, text string")
    out = grid.logical_cells(t, r, c)
    assert plan(out).count("join") == 5
    got, wrong = out.collect(), {x.table_id for x in grid.grid_errors(t, r, c).collect()}
    assert 20 < len(wrong) < 119 and all((x.status == "partial") == (x.table_id in wrong) for x in got)
    heads = {k: [x[1] for x in rows if x[0] == k and x[4]] for k in range(120)}
    for x in got:
        n = len(heads[x.table_id]) if heads[x.table_id] == list(range(1, len(heads[x.table_id]) + 1)) else 0
        mine = [y for y in got if y.table_id == x.table_id]
        above = sorted((y.row, y.text) for y in mine if x.row > n >= y.row and y.column <= x.column < y.column + y.span)
        beside = sorted((y.row, y.text) for y in mine if tables[x.table_id][2] and x.column > 1 == y.column and y.row <= x.row <= y.row_end)
        assert x.header_path == [y[1] for y in above + beside]


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_case_admission_leaves_the_jvm_once(spark):
    out = admission_queries.case_admission(spark, "/root/testdata/sf0.001")
    assert python_steps(out) == 1 and plan(out).count("join leftouter") == 3  # known objects twice, and one table of details
    rows = [("Straße  4", ["STRASSE", " ", None, "x"]), (None, None), ("plain", []), ("Σας", ["ΣΑΣ"])]
    df = spark.createDataFrame(rows, "t string, v array<string>")
    got = df.transform(text.squeezed_together({"q": F.col("t")}, {"said": F.col("v")})).select("q", "said").collect()
    assert got == df.select(text.squeeze(F.col("t")).alias("q"), text.squeezed_values(F.col("v")).alias("said")).collect() and got[0] == ("strasse4", ["strasse", "x"])


def test_candidate_gates_leave_the_jvm_once(spark):
    assert python_steps(admission_queries.candidate_gates(spark, "/root/testdata/sf0.001")) == 1
