"""Whether the objects and relations of a document are a sound graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators.releases import lineages
from scorewright.sources.scratch import written

#: The kinds of relations that bind certain types of objects, with the types of their ends (None: any).
SHAPES = (
    ("section_hierarchy", "section", "section"),
    ("table_contains_row", "table", "row"),
    ("row_contains_cell", "row", "cell"),
    ("table_contains_logical_row", "table", "logical_row"),
    ("table_contains_logical_column", "table", "logical_column"),
    ("logical_row_contains_cell", "logical_row", "logical_cell"),
    ("logical_column_contains_cell", "logical_column", "logical_cell"),
    ("physical_to_logical_cell", "cell", "logical_cell"),
    ("header_for", "logical_cell", "logical_cell"),
    ("nested_table_in_cell", "cell", "table"),
    ("caption_of", "caption", "figure"),
    ("caption_of", "caption", "table"),
    ("reference_to", "reference", None),
    ("figure_has_resource", "figure", "media_resource"),
    ("paragraph_references_figure", "paragraph", "figure"),
    ("equation_in_paragraph", "equation", "paragraph"),
    ("section_contains_figure", "section", "figure"),
    ("section_contains_equation", "section", "equation"),
)
#: The other kinds, which bind any types.
FREE = ("parent_child", "sibling", "document_order")


def graph_faults(documents: DataFrame, objects: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, fault, affected_id): every way in which a document's objects and relations are not a sound graph.

    documents: (document_id); objects: (bundle_id, object_id, document_id, object_type, document_order), bundle_id being the
    document that they are listed with; relations: (bundle_id, relation_id, document_id, kind, source_id, target_id). Faults are
    named by the rule; the kind's name for ends of wrong types. parent_child must be a forest: an object has one parent at most
    (several_parents) and is not above itself (parent_cycle: those that lie on or below a cycle). Relations with unknown ends are
    judged by nothing else. All joins are by document and object.
    """
    o, r = objects.withColumnRenamed("bundle_id", "b"), relations.withColumnRenamed("bundle_id", "b")
    fault = lambda df, name, key: df.select(F.col("b").alias("document_id"), F.lit(name).alias("fault") if isinstance(name, str) else name.alias("fault"), F.col(key).cast("string").alias("affected_id"))
    twice = lambda df, key: df.groupBy("b", key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = [
        fault(twice(o, "object_id"), "repeated_object", "object_id"), fault(twice(o, "document_order"), "repeated_order", "document_order"), fault(twice(r, "relation_id"), "repeated_relation", "relation_id"),
        fault(o.filter("NOT (document_id <=> b)"), "object_of_another_document", "object_id"),
        fault(documents.select(F.col("document_id").alias("b")).join(o.filter("object_type = 'document'").select("b").distinct(), "b", "left_anti"), "no_document_object", "b"),
    ]
    one = o.groupBy("b", "object_id").agg(F.min(F.struct("document_order", "object_type")).alias("x")).select("b", "object_id", "x.*")
    end = lambda side: one.select("b", F.col("object_id").alias(f"{side}_id"), F.col("object_type").alias(f"{side}_type"), F.col("document_order").alias(f"{side}_order"))
    # all that one relation shows with its ends is told in one pass
    j = r.join(end("source"), ["b", "source_id"], "left").join(end("target"), ["b", "target_id"], "left")
    unknown = F.col("source_type").isNull() | F.col("target_type").isNull()
    fits = F.lit(False)
    for kind, source, target in SHAPES:
        fits = fits | ((F.col("kind") == kind) & (F.col("source_type") == source) & (F.lit(target is None) | (F.col("target_type") == F.lit(target))))
    kinds = sorted({s[0] for s in SHAPES})
    elsewhere = F.when(~F.col("document_id").eqNullSafe(F.col("b")), "relation_of_another_document")
    unsound = F.when(unknown, "unknown_end").when(F.col("kind").isin(*kinds) & ~F.coalesce(fits, F.lit(False)), F.col("kind")).when(~F.coalesce(F.col("kind").isin(*kinds, *FREE), F.lit(False)), "unknown_kind")
    unsound = unsound.when(F.expr("kind = 'document_order' AND source_order >= target_order"), "document_order")
    parts.append(fault(j.select("b", "relation_id", F.explode(F.array_compact(F.array(elsewhere, unsound))).alias("fault")), F.col("fault"), "relation_id"))
    # what several relations show together needs those of three kinds only; they are kept
    there = lambda side: one.filter("object_type IS NOT NULL").select("b", F.col("object_id").alias(f"{side}_id"))
    links = r.filter("kind IN ('parent_child', 'sibling', 'section_hierarchy')").select("b", "relation_id", "kind", "source_id", "target_id")
    links = written(links.join(there("source"), ["b", "source_id"], "left_semi").join(there("target"), ["b", "target_id"], "left_semi"))
    parent_child = links.filter("kind = 'parent_child'").select("b", "source_id", "target_id")
    tree = parent_child.distinct()
    under = lambda side: tree.select("b", F.col("source_id").alias("parent"), F.col("target_id").alias(f"{side}_id"))
    sibling = links.filter("kind = 'sibling'")
    kin = sibling.select("b", "source_id", "target_id").join(under("source"), ["b", "source_id"]).join(under("target"), ["b", "parent", "target_id"])
    parts.append(fault(sibling.join(kin, ["b", "source_id", "target_id"], "left_anti"), "sibling_without_shared_parent", "relation_id"))
    parts.append(fault(links.filter("kind = 'section_hierarchy'").join(tree, ["b", "source_id", "target_id"], "left_anti"), "hierarchy_without_parent_child", "relation_id"))
    parts.append(fault(tree.groupBy("b", "target_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "several_parents", "target_id"))
    node = lambda c: F.struct("b", F.col(c).alias("object_id"))
    chains = parent_child.select(node("target_id").alias("release_id"), node("source_id").alias("parent_id"))
    chains = chains.unionByName(parent_child.select(node("source_id").alias("release_id"), F.lit(None).cast(chains.schema["parent_id"].dataType).alias("parent_id")))
    rings = lineages(chains).filter("state = 'cycle'").select("release_id.b", "release_id.object_id")
    parts.append(fault(rings, "parent_cycle", "object_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
