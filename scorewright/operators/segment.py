"""Segments: splitting, enveloping, packing, numbering, table contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.digests import joined_digest
from scorewright.functions.text import pieces


def leaves(objects: DataFrame, most: int = 600) -> DataFrame:
    """objects (document_id, object_id, document_order, content) as leaf segments of at most `most` characters.

    (segment_id, document_id, object_id, ordinal, start, end, content, content_sha256); start and end are places in the
    object's content. Ordinals count within an object.
    """
    cut = objects.select("document_id", "object_id", F.posexplode(pieces(F.col("content"), most)).alias("ordinal", "content"))
    w = Window.partitionBy("document_id", "object_id").orderBy("ordinal")
    end = F.sum(F.char_length("content")).over(w)
    out = cut.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("content"))
    sha = F.sha2("content", 256)
    return out.select(joined_digest(F.col("document_id"), F.col("object_id"), F.col("ordinal"), sha).alias("segment_id"), "document_id", "object_id", "ordinal", "start", "end", "content", sha.alias("content_sha256"))


#: Fixed value: the line before a segment's content.
ENVELOPE = "[[RAG_BENCHMARK_SEGMENT id=%s]]\n%s"


def enveloped(segments: DataFrame) -> DataFrame:
    """segments with the text that goes to a system: a line with the id before the content."""
    return segments.withColumn("envelope", F.format_string(ENVELOPE, "segment_id", "content"))


def packed(documents: DataFrame, most: int) -> DataFrame:
    """(document_id, batch, first, last, n, size): the successive segments of each document in batches of at most `most`; a
    larger one is alone. documents: (document_id, sizes array<long>), a row each, so that nothing is shuffled."""
    names = ["batch", "first", "last", "n", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for row, sizes in enumerate(batch.column(1)):
                until = np.concatenate([[0], np.cumsum(sizes.values.to_numpy() if sizes.is_valid else [])]).astype(np.int64)
                start, number = 0, 0
                while start < len(until) - 1:
                    stop = max(start + 1, int(np.searchsorted(until, until[start] + most, "right")) - 1)
                    of.append(row)
                    found.append((number, start, stop - 1, stop - start, int(until[stop] - until[start])))
                    start, number = stop, number + 1
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], names=["document_id", *names])

    kind = documents.schema["document_id"].dataType.simpleString()
    given = documents.select("document_id", F.col("sizes").cast("array<bigint>").alias("sizes"))
    return given.mapInArrow(run, f"document_id {kind}, batch long, first long, last long, n long, size long")


def runtime_order(segments: DataFrame) -> DataFrame:
    """segments with file_no: their number within the document by (ordinal, segment_id)."""
    w = Window.partitionBy("document_id").orderBy("ordinal", "segment_id")
    return segments.withColumn("file_no", F.row_number().over(w) - 1)


def cell_headers(cells: DataFrame) -> DataFrame:
    """cells (table_id, row, column, value) with the values of their column's first row and their row's first column."""
    w_row, w_col = Window.partitionBy("table_id", "column").orderBy("row"), Window.partitionBy("table_id", "row").orderBy("column")
    return cells.withColumn("column_header", F.first("value").over(w_row)).withColumn("row_header", F.first("value").over(w_col))


def json_tables(text: DataFrame) -> DataFrame:
    """(key, table_no, grid) of <table format="json"> blocks whose rows are equally long. text: (key, text)."""
    found = F.regexp_extract_all("text", F.lit(r'(?s)<table format="json">(.*?)</table>'), F.lit(1))
    rows = text.select("key", F.posexplode(found).alias("table_no", "raw"))
    grid = F.from_json("raw", "array<array<string>>")
    return rows.select("key", "table_no", grid.alias("grid")).filter((F.size("grid") > 0) & F.forall("grid", lambda r: F.size(r) == F.size(F.col("grid")[0])))


def shared_tokens(sections: DataFrame, first: int = 3) -> DataFrame:
    """(token, n_sections, sections): tokens that occur in at least two sections (section_id, tokens), with the first few ids."""
    rows = sections.select("section_id", F.explode("tokens").alias("token")).distinct()
    w = Window.partitionBy("token").orderBy("section_id")
    few = rows.withColumn("place", F.row_number().over(w))
    return few.groupBy("token").agg(F.count(F.lit(1)).alias("n_sections"), F.array_sort(F.collect_list(F.when(F.col("place") <= first, F.col("section_id")))).alias("sections")).filter("n_sections >= 2")
