"""Matching retrieved items with gold evidence: locators, quotes, ranges, footprints, round trips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.sources.scratch import written


def locator_covers(observed: str, expected: str) -> Column:
    """Whether one locator struct covers another: same type, and containment or equality by type.

    Fields: type, start, end, object_id, table_id, row, column, page, x0, y0, x1, y1.
    """
    o, e = (lambda f: F.col(f"{observed}.{f}")), (lambda f: F.col(f"{expected}.{f}"))
    span = (o("start") <= e("start")) & (o("end") >= e("end"))
    cell = o("table_id").eqNullSafe(e("table_id")) & o("row").eqNullSafe(e("row")) & o("column").eqNullSafe(e("column"))
    box = (o("page") == e("page")) & (o("x0") <= e("x0")) & (o("y0") <= e("y0")) & (o("x1") >= e("x1")) & (o("y1") >= e("y1"))
    inside = F.when(e("type") == "text_span", span).when(e("type") == "object", o("object_id") == e("object_id")).when(e("type") == "table_cell", cell).when(e("type") == "page_region", box)
    return (o("type") == e("type")) & F.coalesce(inside, F.lit(False))


def cover_join(items: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, evidence_id, item_id, rank): items (…, document_id, locator) that cover gold of the same case and document.

    The equal keys are case, document and locator type; Spark shuffles on these and tests containment on the matches.
    """
    i = items.select("case_id", "document_id", "item_id", "rank", F.col("locator").alias("observed"), F.col("locator.type").alias("type"))
    g = gold.select("case_id", "document_id", "evidence_id", F.col("locator").alias("expected"), F.col("locator.type").alias("type"))
    return i.join(g, ["case_id", "document_id", "type"]).filter(locator_covers("observed", "expected")).select("case_id", "evidence_id", "item_id", "rank")


def earliest_match(matches: DataFrame) -> DataFrame:
    """The match of each (case_id, evidence_id) with the least (rank, item_id)."""
    return matches.groupBy("case_id", "evidence_id").agg(F.min(F.struct("rank", "item_id")).alias("first")).select("case_id", "evidence_id", "first.rank", "first.item_id")


def quote_candidates(quotes: DataFrame, documents: DataFrame, n: int = 3) -> DataFrame:
    """(quote_id, doc_id) pairs that may match: the document has the rarest n-word window of the quote.

    Windows of n whole words inside the quote's edge words, joined by equality: no document is compared with every quote.
    Quotes of fewer than n + 2 words cannot be found this way, see quote_counts.
    """
    windows = lambda df, key: df.select(key, F.split("text", " ").alias("w")).select(
        key, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n - 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i + 1, n), " "))).alias("window"))
    of_quotes = windows(quotes.select("quote_id", F.col("quote").alias("text")).filter(F.size(F.split("text", " ")) >= n + 2), "quote_id").distinct()
    inner = documents.select("doc_id", F.split("text", " ").alias("w"))
    of_docs = inner.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("window")).distinct()
    used = of_docs.join(of_quotes.select("window").distinct(), "window", "left_semi")
    rare = used.groupBy("window").agg(F.count(F.lit(1)).alias("docs"))
    pick = of_quotes.join(rare, "window", "left").groupBy("quote_id").agg(F.min_by("window", F.struct(F.coalesce("docs", F.lit(0)), "window")).alias("window"))
    return used.join(pick, "window").select("quote_id", "doc_id")


#: Bytes of quotes that go to every task at once (16 MB; as an automaton a few times as much).
QUOTES_SENT = 16 << 20


def quote_counts(quotes: DataFrame, documents: DataFrame, most: int = QUOTES_SENT, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """(quote_id, doc_id, n): occurrences without overlap of quotes (quote_id, quote) in documents (doc_id, text), where any.

    Both are compared in their normal form, or in `form` if one is given; empty quotes occur nowhere. Quotes of up to `most` bytes in all (summed first) go to
    the tasks as one automaton, and the documents are read once. Beyond, long quotes meet documents by a shared word window, and
    the short ones, a stated set, are looked for in every document.
    """
    from scorewright.functions.text import occurrences, plain

    form = form or plain
    quotes = quotes.select("quote_id", form(F.col("quote")).alias("quote")).filter("quote <> ''")
    documents = documents.select("doc_id", form(F.col("text")).alias("text"))
    if (quotes.agg(F.sum(F.octet_length("quote"))).first()[0] or 0) <= most:
        return _counted_at_once(quotes, documents)
    found = quote_candidates(quotes, documents).join(quotes, "quote_id").join(documents, "doc_id")
    short = quotes.filter(F.size(F.split("quote", " ")) < 5).crossJoin(documents)
    both = found.select("quote_id", "doc_id", "quote", "text").unionByName(short.select("quote_id", "doc_id", "quote", "text"))
    return both.select("quote_id", "doc_id", occurrences(F.col("text"), F.col("quote")).alias("n")).filter("n > 0")


def _counted_at_once(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    rows = quotes.toArrow()  # bounded by QUOTES_SENT
    ids, texts = rows.column("quote_id"), rows.column("quote").to_pylist()
    sent = quotes.sparkSession.sparkContext.broadcast((ids.combine_chunks(), texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        keys, wanted = sent.value
        of: dict[str, list[int]] = {}
        for k, quote in enumerate(wanted):
            of.setdefault(quote, []).append(k)
        automaton = ahocorasick.Automaton()
        for quote, places in of.items():
            automaton.add_word(quote, (len(quote), places))
        if of:
            automaton.make_automaton()
        for batch in batches:
            quote_rows, doc_rows, counts = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                free: dict[int, list[int]] = {}  # by quote: where the last one counted ends, how many there are
                for last, (length, places) in automaton.iter(text) if of and text else ():
                    seen = free.setdefault(places[0], [0, 0])
                    if last + 1 - length >= seen[0]:
                        seen[:] = last + 1, seen[1] + 1
                for first, (_, n) in free.items():
                    same = of[wanted[first]]
                    quote_rows += same
                    doc_rows += [row] * len(same)
                    counts += [n] * len(same)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(quote_rows, pa.int64())), batch.column(0).take(pa.array(doc_rows, pa.int64())), pa.array(counts, pa.int64())], names=["quote_id", "doc_id", "n"])

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((quotes, "quote_id"), (documents, "doc_id"))]
    return documents.mapInArrow(run, f"quote_id {kinds[0]}, doc_id {kinds[1]}, n long")


def quote_matches(items: DataFrame, gold: DataFrame, counts: DataFrame) -> DataFrame:
    """Items that match gold by their quote: it is unique in the item's document, or in the corpus if the item names none.

    items: (case_id, item_id, rank, document_id?, content, integrity, provenance_status); gold: (case_id, evidence_id, document_id, quote_id, quote).
    """
    corpus = counts.groupBy("quote_id").agg(F.sum("n").alias("corpus_n"))
    near = counts.withColumnRenamed("doc_id", "document_id").withColumnRenamed("n", "doc_n")
    g = gold.join(near, ["quote_id", "document_id"], "left").join(corpus, "quote_id", "left")
    able = ~F.col("integrity").isin("formal", "invalid") & ~F.coalesce(F.col("provenance_status"), F.lit("")).isin("missing", "partial", "unavailable")
    i = items.filter(able).withColumnRenamed("document_id", "named")
    joined = i.join(g, "case_id").filter(F.contains("content", "quote"))
    unique = F.when(F.col("named").isNull(), F.col("corpus_n") == 1).otherwise((F.col("named") == F.col("document_id")) & (F.col("doc_n") == 1))
    return joined.filter(unique).select("case_id", "evidence_id", "item_id", "rank")


def interval_union(gold: DataFrame, pieces: DataFrame, items: bool = False) -> DataFrame:
    """(case_id, evidence_id, complete, rank, covered): whether pieces cover [start, end) of gold without a gap, and from which rank on.

    pieces (case_id, evidence_id, item_id, rank, start, end) lie inside the gold range. Taken by (start, end, rank, item_id);
    a piece that does not reach beyond those before is not used. rank is the greatest of the used ones. With items, a column
    of that name has the used pieces as sorted (rank, item_id).
    """
    keys = ["case_id", "evidence_id"]
    w = Window.partitionBy(*keys).orderBy("start", "end", "rank", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    g = gold.select(*keys, F.col("start").alias("low"), F.col("end").alias("high"))
    p = pieces.join(g, keys).filter("start >= low AND end <= high AND start < end")
    p = p.withColumn("reached", F.coalesce(F.max("end").over(w), F.col("low")))
    used = F.col("end") > F.col("reached")
    per = p.groupBy(*keys).agg(
        F.bool_or(F.col("start") > F.col("reached")).alias("gap"),
        F.max("end").alias("last"),
        F.max(F.when(used, F.col("rank"))).alias("used_rank"),
        F.sum(F.when(used, F.col("end") - F.greatest("start", "reached"))).alias("covered"),
        *([F.sort_array(F.collect_set(F.when(used, F.struct("rank", "item_id")))).alias("items")] if items else []),
    )
    out = g.join(per, keys, "left")
    complete = F.coalesce(~F.col("gap") & (F.col("last") >= F.col("high")), F.lit(False))
    return out.select(*keys, complete.alias("complete"), F.when(complete, F.col("used_rank")).alias("rank"), F.coalesce("covered", F.lit(0)).cast("bigint").alias("covered"), *(["items"] if items else []))


def merge_ranges(ranges: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end: the disjoint ranges that the ranges (keys, start, end) of each key make up, adjacent ones joined; empty
    ranges do not count. A range begins where none before it reaches: windows and sums, no list of a key's ranges."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    r = ranges.filter("start < end").select(*keys, "start", "end").withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("long"))
    r = r.withColumn("nth", F.sum("fresh").over(upto))
    return r.groupBy(*keys, "nth").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("nth")


def footprint(cells: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, table_id, complete, hit_cells, cells, rank): whether every cell of a table has a fully covering item.

    Per cell the least rank counts; the table's is the greatest of its hit cells. Relational division by aggregation.
    """
    hits = edges.filter("coverage = 'full'").join(items, "chunk_id").groupBy("case_id", "object_id").agg(F.min("rank").alias("rank"))
    per = cells.join(hits, ["case_id", "object_id"], "left")
    return per.groupBy("case_id", "table_id").agg(
        F.bool_and(F.col("rank").isNotNull()).alias("complete"), F.count("rank").alias("hit_cells"), F.count(F.lit(1)).alias("cells"), F.max("rank").alias("rank"),
    )


def true_misses(gold: DataFrame, edges: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Gold (case_id, object_id, extent_complete) that is proven not retrieved: its extent is complete, all its edges state
    their coverage, and none leads to a retrieved chunk."""
    known = edges.groupBy("object_id").agg(F.bool_and(F.coalesce(F.col("coverage").isin("full", "partial"), F.lit(False))).alias("explicit"))
    got = edges.join(retrieved, "chunk_id").select("case_id", "object_id").distinct()
    able = gold.filter("extent_complete").join(known.filter("explicit"), "object_id", "left_semi")
    return able.join(got, ["case_id", "object_id"], "left_anti").select("case_id", "object_id")


def localize(gold: DataFrame, exact: DataFrame, union: DataFrame, partial: DataFrame, misses: DataFrame, stages: DataFrame) -> DataFrame:
    """The localization of every gold evidence at every observable stage: matched, partial, retrieval_missed or provenance_missing.

    stages (case_id, stage, observable) drive the result: unobservable ones have no rows, empty ones have misses.
    exact, union: (case_id, stage, evidence_id, rank); partial, misses: (case_id, stage, evidence_id).
    """
    keys = ["case_id", "stage", "evidence_id"]
    out = stages.filter("observable").join(gold.select("case_id", "evidence_id").distinct(), "case_id")
    out = out.join(exact.select(*keys, F.col("rank").alias("exact_rank")), keys, "left").join(union.select(*keys, F.col("rank").alias("union_rank")), keys, "left")
    out = out.join(partial.select(*keys, F.lit(True).alias("in_part")), keys, "left").join(misses.select(*keys, F.lit(True).alias("missed")), keys, "left")
    rank = F.coalesce("exact_rank", "union_rank")
    status = F.when(rank.isNotNull(), "matched").when(F.col("in_part"), "partial").when(F.col("missed"), "retrieval_missed").otherwise("provenance_missing")
    return out.select(*keys, status.alias("status"), rank.alias("rank"))


#: Fixed value: why a stage cannot be scored although it is observable.
UNMAPPED = "runtime provenance mapping is unavailable for required Gold Evidence"


def observability(stages: DataFrame, paths: DataFrame, localized: DataFrame) -> DataFrame:
    """(case_id, stage, reason): why a stage cannot be scored, null if it can.

    A stage that some path completes can; otherwise a clause without a matched alternative must have none whose provenance is
    missing. stages: (case_id, stage, observable); paths: (case_id, path, clause, evidence_id); localized: from localize.cascade.
    """
    keys = ["case_id", "stage"]
    j = stages.filter("observable").select(*keys).join(paths, "case_id").join(localized.select(*keys, "evidence_id", "status"), [*keys, "evidence_id"], "left")
    clause = j.groupBy(*keys, "path", "clause").agg(F.coalesce(F.bool_or(F.col("status") == "matched"), F.lit(False)).alias("hit"), F.coalesce(F.bool_or(F.col("status") == "provenance_missing"), F.lit(False)).alias("unknown"))
    path = clause.groupBy(*keys, "path").agg(F.bool_and("hit").alias("whole"), F.bool_or(~F.col("hit") & F.col("unknown")).alias("unknown"))
    per = path.groupBy(*keys).agg(F.bool_or("whole").alias("whole"), F.bool_or("unknown").alias("unknown"))
    out = stages.select(*keys, "observable").join(per, keys, "left")
    unseen = F.concat("stage", F.lit(" stage is not observable"))
    return out.select(*keys, F.when(~F.col("observable"), unseen).when(~F.col("whole") & F.col("unknown"), UNMAPPED).alias("reason"))


def round_trip(forward: DataFrame, reverse: DataFrame, catalog: DataFrame) -> DataFrame:
    """Edges (object_id, chunk_id, coverage) that only one direction has, that differ, or whose object the catalog lacks."""
    f = forward.select("object_id", "chunk_id", F.col("coverage").alias("there"), F.lit(True).alias("f"))
    r = reverse.select("object_id", "chunk_id", F.col("coverage").alias("back"), F.lit(True).alias("r"))
    both = f.join(r, ["object_id", "chunk_id"], "full_outer").join(catalog.select("object_id", F.lit(True).alias("known")).distinct(), "object_id", "left")
    fault = (
        F.when(F.col("f").isNull(), "no_forward_edge").when(F.col("r").isNull(), "no_reverse_edge")
        .when(~F.col("there").eqNullSafe(F.col("back")), "coverage_differs").when(F.col("known").isNull(), "not_in_catalog")
    )
    return both.select("object_id", "chunk_id", fault.alias("fault")).filter("fault IS NOT NULL")


def overlap_edges(objects: DataFrame, chunks: DataFrame, bucket: int = 1024) -> DataFrame:
    """(document_id, object_id, chunk_id, coverage, start, end): object and chunk ranges of a document that share a place.

    A range join by buckets: both sides name the blocks of `bucket` places that they touch and meet by equality; a pair
    counts in the block where its common part begins.
    """
    blocks = lambda df: df.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    o = blocks(objects.filter("start < end")).select("document_id", "block", "object_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    c = blocks(chunks.filter("start < end")).select("document_id", "block", "chunk_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    j = o.join(c, ["document_id", "block"]).filter("o_start < c_end AND c_start < o_end")
    start, end = F.greatest("o_start", "c_start"), F.least("o_end", "c_end")
    j = j.filter(F.floor(start / bucket) == F.col("block"))
    full = (F.col("c_start") <= F.col("o_start")) & (F.col("c_end") >= F.col("o_end"))
    return j.select("document_id", "object_id", "chunk_id", F.when(full, "full").otherwise("partial").alias("coverage"), start.alias("start"), end.alias("end"))


def section_of(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """The section of each chunk: the greatest overlap, then document order, then id; partial if it touches several.

    edges as from overlap_edges with sections as objects; sections (object_id, document_order).
    """
    j = edges.join(sections.select("object_id", "document_order"), "object_id").withColumn("size", F.col("end") - F.col("start"))
    w = Window.partitionBy("document_id", "chunk_id")
    ranked = j.withColumn("place", F.row_number().over(w.orderBy(F.desc("size"), "document_order", "object_id"))).withColumn("touched", F.count(F.lit(1)).over(w))
    return ranked.filter("place = 1").select("document_id", "chunk_id", F.col("object_id").alias("section_id"), F.col("size").alias("overlap"), (F.col("touched") > 1).alias("partial"))


def active_spans(headings: DataFrame) -> DataFrame:
    """Each heading (document_id, section_id, start) is active until the next one of its document, the last to the end (null)."""
    w = Window.partitionBy("document_id").orderBy("start", "section_id")
    return headings.select("document_id", "section_id", "start", F.lead("start").over(w).alias("end"))


def unique_bridges(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """(chunk_id, class_id): text windows (chunk_id, window) that occur in the equal-value class of one text only.

    texts (class_id, window) holds the windows that each class has; both sides meet by equality.
    """
    met = windows.join(texts, "window").groupBy("chunk_id", "window").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("other"))
    return met.filter("class_id = other").select("chunk_id", "class_id").distinct()


def _windows(texts: DataFrame, key: str, length: int, only: frozenset[str] | None = None) -> DataFrame:
    """(key, window): the different windows of `length` characters of each text (key, text), at every place; or those in `only`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[int], found: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=[key, "window"])

        for batch in batches:
            ids, rows, found = batch.column(0), [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                each = {text[i : i + length] for i in range(len(text or "") - length + 1)}
                each = each if only is None else each & only
                rows += [row] * len(each)
                found += each
                if len(found) > 100_000:
                    yield made(rows, found)
                    rows, found = [], []
            yield made(rows, found)

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, window string")


def witness_bridges(chunks: DataFrame, objects: DataFrame, length: int = 48, step: int = 24, most: int = 1_000_000) -> DataFrame:
    """(chunk_id, class_id): chunks (chunk_id, text) that hold a witness of a class of objects (object_id, value) of equal value.

    Texts are normalized. Witnesses are the value's windows of `length` characters at multiples of `step` and at its end that
    no value of another class contains. class_id is the least object_id of its class. Up to `most` witnesses (counted first) go
    to the tasks, which then give only windows that are witnesses; beyond that all windows are shuffled to meet them.
    """
    from scorewright.functions.text import plain

    values = objects.select("object_id", plain(F.col("value")).alias("value")).groupBy("value").agg(F.min("object_id").alias("class_id")).filter(F.char_length("value") >= length)
    n = F.char_length("value") - length
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), n, F.lit(step)), F.array(n)))
    own = values.select("class_id", F.explode(F.transform(starts, lambda at: F.substring("value", at + 1, F.lit(length)))).alias("window")).distinct()
    every = _windows(values.select("class_id", F.col("value").alias("text")), "class_id", length)
    alone = every.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("window")
    witnesses = written(own.join(alone, "window", "left_semi"))
    only = frozenset(r.window for r in witnesses.select("window").toLocalIterator()) if witnesses.count() <= most else None
    texts = chunks.select("chunk_id", plain(F.col("text")).alias("text"))
    return _windows(texts, "chunk_id", length, only).join(witnesses, "window").select("chunk_id", "class_id").distinct()


def exactly_one(leaves: DataFrame, chunks: DataFrame) -> DataFrame:
    """Leaves (leaf_id) without exactly one chunk, and chunks' leaves that do not exist: (leaf_id, fault)."""
    n = chunks.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("n"))
    j = leaves.select("leaf_id", F.lit(True).alias("known")).join(n, "leaf_id", "full_outer")
    fault = F.when(F.col("known").isNull(), "unknown_leaf").when(F.col("n").isNull(), "no_chunk").when(F.col("n") > 1, "several_chunks")
    return j.select("leaf_id", fault.alias("fault")).filter("fault IS NOT NULL")


def integrity(items: DataFrame) -> DataFrame:
    """items with integrity: legacy (no schema named), formal, or invalid with the first failing check in `reason`.

    Columns: provenance_schema, provenance_status, content, content_sha256, source_sha256, candidates array, map_digest, pins array.
    """
    from scorewright.functions.digests import valid_digest

    none = F.col("provenance_schema").isNull() & F.col("provenance_status").isNull()
    reason = (
        F.when(none, None)
        .when(~F.coalesce(F.col("provenance_status").isin("complete", "partial", "missing", "unavailable"), F.lit(False)), "unknown_status")
        .when(F.col("provenance_schema").isNull(), "unknown_schema")
        .when(F.col("content_sha256").isNotNull() & valid_digest(F.col("content_sha256")).isNull(), "malformed_digest")
        .when(~F.sha2("content", 256).eqNullSafe(F.coalesce(valid_digest(F.col("content_sha256")), F.sha2("content", 256))), "content_differs")
        .when(~F.coalesce(F.array_contains("candidates", F.col("source_sha256")), F.lit(False)), "unknown_source")
        .when(~F.coalesce(F.array_contains("pins", F.col("map_digest")), F.lit(False)), "unpinned_map")
    )
    state = F.when(none, "legacy").when(reason.isNull(), "formal").otherwise("invalid")
    return items.withColumn("reason", reason).withColumn("integrity", state)
