"""Tables with merged cells as grids: where each cell stands, which cells are one, what heads them, and what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROW, _CELL = ["table_id", "row"], ["table_id", "row", "ordinal"]


def placed_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """cells with their column, end and origin_row: the first row of the merged cell that they belong to, null if that is unclear.

    Columns begin after the row's offset and run on by the cells' spans, a running sum. A cell that continues belongs to the one
    above it if that has the same column and span and is itself the start (`restart`) of a merged cell or continues one: islands
    of successive rows within (table, column, span), whose first cell must be a start.

    rows: (table_id, row, grid_before); cells: (table_id, row, ordinal, span, v_merge, text); spans under 1 and null count as 1,
    unknown kinds of merging as none.
    """
    same = Window.partitionBy("table_id", "column", "wide").orderBy("row")
    c = _in_columns(rows, cells)
    c = c.withColumn("starts", (F.col("merge") != "continue") | ~F.lag("row").over(same).eqNullSafe(F.col("row") - 1))
    head = F.last(F.when(F.col("starts"), F.struct("merge", "row")), ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, 0))
    origin = F.when(F.col("merge") != "continue", F.col("row")).when(head["merge"] == "restart", head["row"])
    return c.withColumn("origin_row", origin).drop("starts")


def _in_columns(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """cells with wide and merge, their span and kind of merging as they count, and column and end; see placed_cells."""
    span = F.when(F.col("span") >= 1, F.col("span")).otherwise(1)
    merge = F.when(F.col("v_merge").isin("restart", "continue"), F.col("v_merge")).otherwise("none")
    before = Window.partitionBy(*_ROW).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.select(*_ROW, F.when(F.col("grid_before") > 0, F.col("grid_before")).otherwise(0).alias("offset"))
    c = cells.join(offset, _ROW, "left").withColumn("wide", span).withColumn("merge", merge)
    c = c.withColumn("column", (1 + F.coalesce("offset", F.lit(0)) + F.coalesce(F.sum("wide").over(before), F.lit(0))).cast("int")).drop("offset")
    return c.withColumn("end", (F.col("column") + F.col("wide") - 1).cast("int"))


def grid_errors(tables: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, row, ordinal, error): all that is wrong with the tables; row or ordinal are null where none is meant.

    tables: (table_id, grid_width, first_column_header), no check of widths where grid_width is null; rows also have grid_after
    and is_header, and count from 1.
    """
    c = placed_cells(rows, cells).join(tables.select("table_id", "grid_width"), "table_id", "left")
    of = lambda df, name, *at: df.select("table_id", *(F.col(x).cast("int") if x in at else F.lit(None).cast("int").alias(x) for x in ("row", "ordinal")), F.lit(name).alias("error"))
    cell = lambda condition, name: of(c.filter(condition), name, "row", "ordinal")
    line = lambda df, name: of(df, name, "row")
    bad = lambda x: F.coalesce(F.col(x) < 0, F.lit(True))
    offset = rows.filter(~(bad("grid_before") | bad("grid_after")))
    lost = c.filter("merge = 'continue' AND origin_row IS NULL")
    # a lost cell that lies within one merged cell of the row above is of another width, else it has nothing to continue
    above = c.filter("origin_row IS NOT NULL AND merge <> 'none'").select("table_id", (F.col("row") + 1).alias("row"), F.col("column").alias("a_column"), F.col("end").alias("a_end"))
    mismatch = lost.join(above, _ROW).filter("a_column <= column AND end <= a_end").select(*_CELL).distinct()
    width = c.groupBy(*_ROW).agg(F.max("end").alias("last"))
    wide = rows.join(width, _ROW).join(tables.select("table_id", "grid_width"), "table_id").filter((F.col("last") + F.when(bad("grid_before") | bad("grid_after"), 0).otherwise(F.col("grid_after"))) != F.col("grid_width"))
    heads = rows.filter("is_header").groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("last")).filter("n <> last")
    parts = [
        cell(~F.coalesce(F.col("span") >= 1, F.lit(False)), "invalid_effective_span"), cell(~F.coalesce(F.col("v_merge").isin("restart", "continue", "none"), F.lit(True)), "invalid_vMerge"),
        cell(F.col("end") > F.col("grid_width"), "grid_overflow"), of(mismatch, "vMerge_span_mismatch", "row", "ordinal"), of(lost.join(mismatch, _CELL, "left_anti"), "orphan_or_ambiguous_vMerge_continue", "row", "ordinal"),
        line(rows.filter(bad("grid_before") | bad("grid_after")), "invalid_row_grid_offset"), line(offset.filter("grid_before > 0 OR grid_after > 0"), "grid_offset"),
        line(rows.join(cells.select(*_ROW).distinct(), _ROW, "left_anti"), "empty_physical_row"), line(wide, "grid_width_mismatch"), of(heads, "non_contiguous_explicit_header_rows"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _table_states(tables: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, side, heads, wrong) of each table: whether its first column is a header, how many rows are, and whether any error of
    grid_errors is there, lost cells excepted. What rows have is reduced row by row, then table by table, before it meets the tables."""
    odd = ~F.coalesce(F.col("span") >= 1, F.lit(False)) | ~F.coalesce(F.col("v_merge").isin("restart", "continue", "none"), F.lit(True))
    per_row = _in_columns(rows, cells).groupBy(*_ROW).agg(F.max("end").alias("last"), F.bool_or(odd).alias("odd"))
    stated = rows.select(*_ROW, "grid_after", F.col("is_header").alias("header"), F.coalesce((F.col("grid_before") == 0) & (F.col("grid_after") == 0), F.lit(False)).alias("even"), F.lit(True).alias("stated"))
    fault = F.col("odd") | (F.col("stated") & (~F.col("even") | F.col("last").isNull()))
    full = F.when(F.col("stated"), F.col("last") + F.col("grid_after"))  # where the offset is invalid, the table is wrong anyway
    per_table = stated.join(per_row, _ROW, "full_outer").groupBy("table_id").agg(
        F.bool_or(fault).alias("fault"), F.max("last").alias("last"), F.min(full).alias("least"), F.max(full).alias("most"), F.count_if("header").alias("n"), F.max(F.when(F.col("header"), F.col("row"))).alias("last_head"),
    )
    width = F.col("grid_width")
    wrong = reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), [F.col("last") > width, F.col("least") != width, F.col("most") != width, F.col("n") != F.col("last_head")], F.coalesce("fault", F.lit(False)))
    heads = F.when(F.col("n") == F.col("last_head"), F.col("n")).otherwise(0)
    return tables.join(per_table, "table_id", "left").select("table_id", F.coalesce("first_column_header", F.lit(False)).alias("side"), heads.alias("heads"), wrong.alias("wrong"))


def logical_cells(tables: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, row, column, row_end, span, text, is_header, is_data, header_path, status): the cells as they are seen, merged ones once.

    header_path: the texts of the header cells above its first column, by row, then that of the first column's cell in its
    row if that column is a header; each header once. status is partial in a table with any error, else supported. Header cells stand once
    more in each column or row that they head, and windows over these hand them to the cells; cells are dealt out by table once.
    """
    c = placed_cells(rows, cells)
    lost = (F.col("merge") == "continue") & F.col("origin_row").isNull()
    ends = c.groupBy("table_id", "column", F.col("wide").alias("span"), F.col("origin_row").alias("row")).agg(F.max("row").alias("row_end"), F.min_by("text", "row").alias("text"), F.bool_or(lost).alias("lost"))
    lc = ends.join(_table_states(tables, rows, cells), "table_id").withColumn("wrong", F.col("wrong") | F.bool_or("lost").over(Window.partitionBy("table_id"))).filter("row IS NOT NULL")
    at = lambda kind, row, column: F.struct(F.lit(kind).alias("kind"), row.alias("at_row"), column.alias("at_column"))
    itself = F.array(at("cell", F.col("row"), F.col("column")))
    above = F.when(F.col("row") <= F.col("heads"), F.transform(F.sequence(F.col("column"), F.col("column") + F.col("span") - 1), lambda x: at("above", F.col("row"), x)))
    beside = F.when(F.col("side") & (F.col("column") == 1), F.transform(F.sequence("row", "row_end"), lambda x: at("beside", x, F.col("column"))))
    none = F.slice(itself, 1, 0)
    x = lc.select("*", F.inline(F.concat(itself, F.coalesce(above, none), F.coalesce(beside, none))))
    of = lambda kind, line: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.struct("row", "text"))).over(Window.partitionBy("table_id", line)))
    x = x.withColumn("top", of("above", "at_column")).filter("kind <> 'above'").withColumn("left", of("beside", "at_row")).filter("kind = 'cell'")
    top, left = (F.when(when, F.col(name)).otherwise(F.slice(name, 1, 0)) for name, when in (("top", F.col("row") > F.col("heads")), ("left", F.col("side") & (F.col("column") > 1))))
    is_header = (F.col("row_end") <= F.col("heads")) | (F.col("side") & (F.col("column") <= 1))
    is_data = (F.col("row") > F.col("heads")) & (~F.col("side") | (F.col("column") > 1))
    return x.select("table_id", "row", "column", "row_end", "span", "text", is_header.alias("is_header"), is_data.alias("is_data"), F.concat(top, left)["text"].alias("header_path"), F.when(F.col("wrong"), "partial").otherwise("supported").alias("status"))


def grid_tables(tables: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, status, errors, cells, merged, eligible): each table; eligible as gold if it is supported and has header and data cells."""
    errors = grid_errors(tables, rows, cells).groupBy("table_id").agg(F.count(F.lit(1)).alias("errors"))
    lc = logical_cells(tables, rows, cells)
    per = lc.groupBy("table_id").agg(F.count(F.lit(1)).alias("cells"), F.sum(((F.col("row_end") > F.col("row")) | (F.col("span") > 1)).cast("long")).alias("merged"), F.bool_or("is_header").alias("head"), F.bool_or("is_data").alias("data"))
    out = tables.select("table_id").join(errors, "table_id", "left").join(per, "table_id", "left").fillna(0, ["errors", "cells", "merged"])
    fine = F.col("errors") == 0
    return out.select("table_id", F.when(fine, "supported").otherwise("partial").alias("status"), "errors", "cells", "merged", (fine & F.coalesce(F.col("head") & F.col("data"), F.lit(False))).alias("eligible"))
