"""Blocks of a document aligned with the lines of its rendered text, in order, by a cursor that only moves forward.

A block takes the first line at or after the cursor that reads as the block does, and the cursor then stands behind it; a
block without such a line leaves the cursor where it is. What a block gets thus depends on all blocks before it in its
document, and on nothing else: lines and blocks meet by document, whose text is one row already, and each is looked at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where lines end.
_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def source_lines(documents: DataFrame) -> DataFrame:
    """(document_id, line, start, end, text) of the lines of documents (document_id, text), from 0; end excludes the line's end."""
    found = F.filter(F.split("text", rf"(?<=[{_ENDS}])(?!(?<=\r)\n)"), lambda piece: piece != "")
    raw = documents.select("document_id", F.posexplode(found).alias("line", "raw"))
    before = Window.partitionBy("document_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    out = raw.withColumn("start", F.coalesce(F.sum(F.char_length("raw")).over(before), F.lit(0)).cast("int")).withColumn("text", F.regexp_replace("raw", r"[\r\n]+$", ""))
    return out.select("document_id", "line", "start", (F.col("start") + F.char_length("text")).cast("int").alias("end"), "text")


def rendered(value: Column, kind: Column, level: Column) -> Column:
    """The line that a block's value becomes: headings of levels 1 to 9 and list items have a mark before it."""
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), value)
    return F.when((kind == "heading") & level.between(1, 9), heading).when(kind == "list_item", F.concat(F.lit("- "), value)).otherwise(value)


def _taken(lines: Iterable[str], wanted: Iterable[str | None]) -> list[int | None]:
    """Of each wanted text in turn the first line that reads so behind those taken before."""
    at, cursor, out = defaultdict(list), 0, []
    for i, text in enumerate(lines):
        at[text].append(i)
    for text in wanted:
        places = at.get(text, ())
        k = bisect_left(places, cursor)
        out.append(places[k] if k < len(places) else None)
        cursor = places[k] + 1 if k < len(places) else cursor
    return out


#: How many documents are walked before their places are handed back.
_TOGETHER = 64


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _walked(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for lines, wanted in batches:
        for k in range(0, len(lines), _TOGETHER):
            yield pa.array([_taken(t.as_py() or (), w.as_py()) for t, w in zip(lines.slice(k, _TOGETHER), wanted.slice(k, _TOGETHER))], pa.list_(pa.int32()))


def aligned(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, status, start, end), a row for each block: where its value stands in the document's text.

    blocks: (document_id, block_id, body_ordinal, kind, level, value, status), taken by body_ordinal (none and 0 first), then
    id. status is aligned, unsupported_object or execution_line_not_found, with null places; a block without a value is
    found nowhere. A document's lines and blocks are one row while they meet.
    """
    fault = F.when(F.col("status").eqNullSafe("unsupported"), "unsupported_object").when(F.coalesce("value", F.lit("")) == "", "execution_line_not_found")
    b = blocks.withColumn("fault", fault).withColumn("ordinal", F.coalesce(F.nullif("body_ordinal", F.lit(0)), F.lit(-1)))
    text = F.when(F.col("fault").isNull(), rendered(F.col("value"), F.col("kind"), F.col("level")))
    block = F.struct("ordinal", F.col("block_id").cast("string").alias("name"), "block_id", "fault", F.char_length("value").alias("n"), text.alias("text"))
    in_order = lambda row, name: F.sort_array(F.collect_list(row)).alias(name)
    lines = source_lines(documents).groupBy("document_id").agg(in_order(F.struct("line", "end", "text"), "lines"))
    met = b.groupBy("document_id").agg(in_order(block, "blocks")).join(lines, "document_id", "left")
    taken = F.transform(_walked("lines.text", "blocks.text"), lambda i: F.try_element_at("lines.end", i + 1))
    out = met.select("document_id", F.explode(F.arrays_zip("blocks", taken.alias("end"))).alias("x")).select("document_id", "x.blocks.*", "x.end")
    status = F.coalesce("fault", F.when(F.col("end").isNull(), "execution_line_not_found").otherwise("aligned"))
    return out.select("document_id", "block_id", status.alias("status"), (F.col("end") - F.col("n")).alias("start"), "end")
