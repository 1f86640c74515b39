"""Canonical objects: projection to segments, targets for questions, gold on leaves, provenance maps, read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.digests import joined_digest
from scorewright.operators.evidence import overlap_edges


def relations(objects: DataFrame) -> DataFrame:
    """(source_id, kind, target_id) of objects (document_id, object_id, parent_id, document_order): containment by parent,
    and the next sibling under the same parent."""
    parts = objects.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("source_id"), F.lit("contains").alias("kind"), F.col("object_id").alias("target_id"))
    w = Window.partitionBy("document_id", "parent_id").orderBy("document_order", "object_id")
    after = objects.select(F.col("object_id").alias("source_id"), F.lit("precedes").alias("kind"), F.lead("object_id").over(w).alias("target_id")).filter("target_id IS NOT NULL")
    return parts.unionByName(after)


def row_segments(cells: DataFrame) -> DataFrame:
    """(table_id, row, content): each row of cells (table_id, row, column, value) but the first as `header: value` pairs."""
    w = Window.partitionBy("table_id", "column").orderBy("row")
    c = cells.withColumn("header", F.first("value").over(w)).withColumn("top", F.min("row").over(Window.partitionBy("table_id")))
    pair = F.concat_ws(": ", "header", "value")
    rows = c.filter("row > top").groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("column", pair.alias("pair")))).alias("pairs"))
    return rows.select("table_id", "row", F.array_join(F.transform("pairs", lambda x: x["pair"]), " | ").alias("content"))


def gold_on_leaves(gold: DataFrame, leaves: DataFrame) -> DataFrame:
    """(case_id, evidence_id, leaf_id, fault): the leaves that a gold range (case_id, evidence_id, document_id, object_id,
    start, end) of an object touches; without any, one row with a fault. A null range means the whole object."""
    j = gold.join(leaves.select("document_id", "object_id", "leaf_id", F.col("start").alias("l_start"), F.col("end").alias("l_end")), ["document_id", "object_id"], "left")
    touches = F.col("start").isNull() | ((F.col("l_start") < F.col("end")) & (F.col("l_end") > F.col("start")))
    hit = F.when(touches, F.col("leaf_id"))
    per = j.groupBy("case_id", "evidence_id").agg(F.array_sort(F.collect_set(hit)).alias("leaves"))
    return per.select("case_id", "evidence_id", F.explode_outer("leaves").alias("leaf_id"), F.when(F.size("leaves") == 0, "not_segmentable").alias("fault"))


def stage_decisions(gold: DataFrame, items: DataFrame, edges: DataFrame, stages: tuple[str, ...] = ("raw", "ranked", "context")) -> DataFrame:
    """(case_id, evidence_id, stage, decision): full, partial, unknown or missed by the best edge of a stage's items.

    items (case_id, stage, chunk_id), edges (chunk_id, evidence_id, coverage); a null coverage is unknown.
    """
    asked = gold.select("case_id", "evidence_id").withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    code = F.when(F.col("coverage") == "full", 3).when(F.col("coverage") == "partial", 2).otherwise(1)
    best = items.join(edges, "chunk_id").groupBy("case_id", "stage", "evidence_id").agg(F.max(code).alias("code"))
    names = F.array(*map(F.lit, ("missed", "unknown", "partial", "full")))
    return asked.join(best, ["case_id", "stage", "evidence_id"], "left").select("case_id", "evidence_id", "stage", F.element_at(names, F.coalesce("code", F.lit(0)) + 1).alias("decision"))


def provenance_map(objects: DataFrame, chunks: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """Forward edges, reverse edges and the catalog of objects (document_id, object_id, start, end, witness_sha256) and chunks
    (document_id, chunk_id, start, end, content) over sources (document_id, text). A chunk counts if its span is its content."""
    placed = chunks.join(sources, "document_id").filter(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("content"))
    edges = overlap_edges(objects, placed.select("document_id", "chunk_id", "start", "end"))
    stated = chunks.join(placed.select("document_id", "chunk_id", F.lit("complete").alias("status")), ["document_id", "chunk_id"], "left")
    return {
        "forward": edges.select("chunk_id", "object_id", "coverage", "start", "end"),
        "reverse": edges.select("object_id", "chunk_id", "coverage"),
        "catalog": objects.select("object_id", "document_id", F.struct("start", "end").alias("extent"), "witness_sha256"),
        "chunks": stated.select("document_id", "chunk_id", F.coalesce("status", F.lit("missing")).alias("status")),
    }


def running_offsets(blocks: DataFrame, separator: int = 2) -> DataFrame:
    """blocks (document_id, ordinal, content) with their [start, end) in the text that joins them by a separator, and the end
    of the scope: where the next block starts, less one."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    size = F.char_length("content")
    end = F.sum(size + separator).over(w) - separator
    out = blocks.withColumn("end", end).withColumn("start", end - size)
    return out.withColumn("scope_end", F.coalesce(F.lead("start").over(w) - 1, F.col("end")))


def grid_matches(known: DataFrame, found: DataFrame) -> DataFrame:
    """(known_id, found_id): tables (id, grid) with equal grids, where each has one counterpart only."""
    key = lambda df, name: df.select(F.col("id").alias(name), F.to_json("grid").alias("grid"))
    one = lambda df, name: key(df, name).groupBy("grid").agg(F.min(name).alias(name), F.count(F.lit(1)).alias(f"n_{name}")).filter(f"n_{name} = 1")
    return one(known, "known_id").join(one(found, "found_id"), "grid").select("known_id", "found_id")


def targets(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """What questions may be asked about: text blocks of 20 to 600 characters, data cells with a header, version statements.

    blocks (object_id, content), cells (object_id, column_header, row_header, value); (target_id, kind, object_id), each once.
    """
    text = blocks.filter(F.char_length("content").between(20, 600)).select(F.lit("block").alias("kind"), "object_id")
    cell = cells.filter("value <> '' AND (coalesce(column_header, '') <> '' OR coalesce(row_header, '') <> '')").select(F.lit("cell").alias("kind"), "object_id")
    cue = blocks.filter(F.col("content").rlike(r"(?i)\bversion\b|\bv\d|\bauthor|版本|批准|发布")).select(F.lit("version").alias("kind"), "object_id")
    every = text.unionByName(cell).unionByName(cue)
    return every.select(joined_digest(F.col("kind"), F.col("object_id")).alias("target_id"), "kind", "object_id").dropDuplicates(["target_id"])


def judgments(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """cases (case_id, metric_verdict, rescored, context_outcome, observable) with the answer and evidence judgments.

    A review's verdict is above rescoring, and that above the stored metric; evidence needs an observable context.
    """
    names = F.create_map(F.lit("PASS"), F.lit("correct"), F.lit("FAIL"), F.lit("incorrect"), F.lit("NEEDS_REVIEW"), F.lit("needs_review"))
    j = cases.join(reviews.select("case_id", F.col("verdict").alias("review")), "case_id", "left")
    answer = F.coalesce("review", F.try_element_at(names, F.coalesce("rescored", "metric_verdict", F.lit(""))), F.lit("unavailable"))
    evidence = (
        F.when(~F.col("observable"), "unverifiable").when(F.col("context_outcome") == "complete", F.when(answer == "correct", "grounded").otherwise("needs_review"))
        .when(F.col("context_outcome") == "retrieval_missing", "missing").when(F.col("context_outcome") == "partial_coverage", "ungrounded").otherwise("unavailable")
    )
    return j.select("case_id", answer.alias("answer"), evidence.alias("evidence"))


def release_content(cases: DataFrame, golds: DataFrame, evidence: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per case and evidence of a release, by the pinned revision ids: nothing is lost where a side is missing."""
    return (
        cases.join(golds, "gold_revision_id", "left")
        .join(evidence, "gold_revision_id", "left")
        .join(objects, "object_id", "left")
        .withColumn("complete", F.col("object_id").isNotNull())
    )


def negative_scope(evidence: DataFrame, scopes: DataFrame) -> DataFrame:
    """Evidence rows, and a row for each negative scope (case_id, object_id) that no evidence covers."""
    rest = scopes.join(evidence, ["case_id", "object_id"], "left_anti").withColumn("role", F.lit("negative_scope"))
    return evidence.withColumn("role", F.lit("required")).select("case_id", "object_id", "role").unionByName(rest.select("case_id", "object_id", "role"))


def acceptance(expected_chunks: DataFrame, ingested: DataFrame) -> DataFrame:
    """(chunk_id, fault): chunks that were not ingested, were not expected, or whose content differs."""
    a = expected_chunks.select("chunk_id", F.col("content_sha256").alias("want"))
    j = a.join(ingested.select("chunk_id", F.sha2("content", 256).alias("have")), "chunk_id", "full_outer")
    fault = F.when(F.col("have").isNull(), "not_ingested").when(F.col("want").isNull(), "not_expected").when(F.col("want") != F.col("have"), "content_differs")
    return j.select("chunk_id", fault.alias("fault")).filter("fault IS NOT NULL")


def next_headers(cells: DataFrame) -> DataFrame:
    """cells (table_id, row, column, value) with the number of cells above them in their column and before them in their row."""
    up, left = Window.partitionBy("table_id", "column").orderBy("row"), Window.partitionBy("table_id", "row").orderBy("column")
    return cells.withColumn("above", F.row_number().over(up) - 1).withColumn("before", F.row_number().over(left) - 1)
