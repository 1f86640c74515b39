"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The lists to which the folders of new scratch tables are added, see `recorded`; every thread has its own.
_RECORDS: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("records", default=())


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder path under the shared spark.checkpoint.dir. Where none is set, a temporary folder serves a single
    machine (tests); on a cluster that is an error, as every machine would have its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "scorewright-checkpoint")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    for record in _RECORDS.get():
        record.append(path)
    return path


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The list of the scratch folders that are made inside."""
    record: list[str] = []
    token = _RECORDS.set((*_RECORDS.get(), record))
    try:
        yield record
    finally:
        _RECORDS.reset(token)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession, paths: list[str], but: DataFrame, *more: str) -> None:
    """Delete the scratch folders in paths that `but` does not read and that are not in more."""
    read = but.inputFiles()
    for path in paths:
        name = path.rpartition("/")[2]
        if path not in more and not any(f"/{name}/" in file for file in read):
            delete(spark, path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts the lineage and outlives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def placed(docs: DataFrame) -> DataFrame:
    """docs with `file__` and `row__`, the file of each row and its number there: keys that even equal rows do not share.

    docs that are more than a table of files are written once, to have such places; those that have them stay as they are.
    """
    if {"file__", "row__"} <= set(docs.columns):
        return docs
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = materialize(docs, "placed")
    return docs.select("*", F.col("_metadata.file_path").alias("file__"), F.col("_metadata.row_index").alias("row__"))


def shelve(rows: DataFrame, what: str) -> str:
    """Writes rows (file__, row__, and others) as a folder per file__, where whoever reads that file finds its own."""
    path = scratch(rows.sparkSession, what)
    rows.withColumn("of", F.md5("file__")).drop("file__").repartition("of").write.partitionBy("of").parquet(path)
    return path


def shelf(path: str, file: str) -> pa.Table | None:
    """What `shelve` wrote for a file; None if that is nothing. It has as many rows as the file at most."""
    from pyarrow import fs, parquet

    system, root = fs.FileSystem.from_uri(path)
    folder = f"{root}/of={hashlib.md5(file.encode()).hexdigest()}"
    found = [x.path for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.path.endswith(".parquet")]
    return pa.concat_tables([parquet.read_table(system.open_input_file(x)) for x in found]) if found else None


class Shelf:
    """What a task reads of shelved rows, a file's at a time: (row__, and a value if they have one)."""

    def __init__(self, path: str, value: str | None = None):
        self.path, self.value, self.file = path, value, None

    def of(self, file: str) -> tuple[np.ndarray, pa.Array | None]:
        """The numbers of the file's rows in order, and their values."""
        if file != self.file:
            own = shelf(self.path, file)
            if own is None:
                self.rows, self.values = np.zeros(0, np.int64), None
            else:
                own = own.sort_by("row__")
                self.rows, self.values = own.column("row__").to_numpy(), own.column(self.value).combine_chunks() if self.value else None
            self.file = file
        return self.rows, self.values

    def find(self, file: str, asked: np.ndarray) -> np.ndarray:
        """The index of each row in what the file has, -1 where it is not there."""
        rows, _ = self.of(file)
        if not len(rows):
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(rows, asked), len(rows) - 1)
        return np.where(rows[at] == asked, at, -1)


def on_shelf(path: str):
    """A Spark function of (file__, row__): whether the rows that were shelved at path have this place.

    A worker holds the list of one file at a time; other columns, such as texts, need not leave the JVM.
    """

    @F.arrow_udf("boolean")
    def inside(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held = Shelf(path)
        for files, numbers in batches:
            files, asked = files.dictionary_encode(), numbers.to_numpy(zero_copy_only=False)
            which, out = files.indices.to_numpy(zero_copy_only=False), np.zeros(len(asked), bool)
            for k, file in enumerate(files.dictionary.to_pylist()):
                mine = which == k
                out[mine] = held.find(file, asked[mine]) >= 0
            yield pa.array(out)

    return inside


def from_shelf(path: str, value: str, kind: str = "long"):
    """A Spark function of (file__, row__): the value that was shelved at path for this place, null where none was."""

    @F.arrow_udf(kind)
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held = Shelf(path, value)
        for files, numbers in batches:
            files, asked = files.dictionary_encode(), numbers.to_numpy(zero_copy_only=False)
            which, parts, order = files.indices.to_numpy(zero_copy_only=False), [], []
            for k, file in enumerate(files.dictionary.to_pylist()):
                mine = np.flatnonzero(which == k)
                at = held.find(file, asked[mine])
                order.append(mine)
                parts.append(held.values.take(pa.array(at, mask=at < 0)) if held.values is not None else pa.nulls(len(mine), pa.int64()))
            if not parts:
                yield pa.array([], pa.int64())
                continue
            back = np.argsort(np.concatenate(order))
            yield pa.concat_arrays(parts).take(pa.array(back))

    return found


#: Groups that hold at least this part of all rows are broadcast with their values: so many of them at most.
HOT_GROUPS = 10_000
#: Rows in a range of `numbered`.
RANGE_ROWS = 500_000


def with_values(rows: DataFrame, groups: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows with the columns of groups (key, n rows, ...) for their key; both are written tables, every key has a group.

    Groups of n_rows / HOT_GROUPS or more rows are broadcast, as there are HOT_GROUPS of them at most; so no task has to
    gather the rows of a frequent key. The other rows meet their groups by a shuffle.
    """
    least = max(2, -(-n_rows // HOT_GROUPS))
    hot = F.broadcast(groups.filter(F.col("n") >= least))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.filter(F.col("n") < least), key)
    return rows.join(hot, key).unionByName(rest)


def numbered(df: DataFrame, group: list[str], order: list, n_rows: int, name: str = "place") -> DataFrame:
    """df with a column `name`: the place, from 0, of each row among the rows of its group by the columns in order.

    The rows are dealt to ranges of (group, order), so a group may be of any size; a range numbers its rows by itself, and
    what the ranges before it hold of the same group (a row per range and group) is added.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // RANGE_ROWS))
    by = [*map(F.col, group), *order]
    laid = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at__", F.monotonically_increasing_id())
    laid = materialize(laid, "ordered").withColumn("part__", F.shiftright("at__", 33)).withColumn("at__", F.col("at__").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = laid.groupBy("part__", *group).agg(F.min("at__").alias("first__"), F.count(F.lit(1)).alias("n__"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part__", *group, (F.coalesce(F.sum("n__").over(earlier), F.lit(0)) - F.col("first__")).alias("start__"))
    out = laid.join(F.broadcast(starts), ["part__", *group])
    return out.withColumn(name, F.col("start__") + F.col("at__")).drop("part__", "at__", "start__")


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop shuffle files whose data frames are gone, before the next phase writes its own."""
    spark.sparkContext._jvm.System.gc()


#: Bytes of rows that go to a Python worker at once; the JVM and the worker hold a few times as much.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of texts by their bytes, as a number of rows says little where texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def give_back() -> None:
    """Hand memory that this Python worker has freed back to the system: workers outlive tasks, and the next ones are others' work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc lack it
        ctypes.CDLL(None).malloc_trim(0)


_CACHES: dict[str, dict] = {}


def claim(name: str) -> dict:
    """What this Python worker remembers under a name. Workers outlive tasks and stages, so all else that they remember goes."""
    others = [cache for other, cache in _CACHES.items() if other != name and cache]
    for cache in others:
        cache.clear()
    if others:
        give_back()
    return _CACHES.setdefault(name, {})


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one uint8 array, and the len+1 offsets of its rows; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, lengths)
        if (np.diff(offsets) != lengths).any():
            column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
            return utf8(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
