"""Benchmark decontamination by winnowing.

Of every w successive k-word fingerprints the least is kept (the rightmost of equals). Two texts that share w + k - 1 =
10 words in a row share a kept fingerprint, so joining the kept ones of documents and benchmark finds every such span;
the hits are then extended word by word in the texts themselves. Items of fewer words than a window have one
fingerprint, of all their words, which documents are searched for at every position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import materialize
from scorewright.llm.words import batches_of, grams, word_hashes, words

#: Words in a window, and in a fingerprint.
WINDOW, K = 10, 4
#: As many different benchmark fingerprints are sent to all tasks at most (32 MB), to drop other fingerprints early;
#: with more, documents send all of theirs to the join.
SENT_AT_MOST = 4_000_000


def winnowed(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints kept by winnowing the rows of words between offsets."""
    n, span = len(hashes) - WINDOW + 1, WINDOW - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prints = grams(hashes, K)
    start = np.arange(n)
    inside = start + WINDOW <= np.repeat(offsets[1:], np.diff(offsets))[:n]
    start = start[inside]
    at, least = start, prints[start]
    for j in range(1, span):
        other = prints[start + j]
        take = other <= least
        least, at = np.where(take, other, least), np.where(take, start + j, at)
    kept = np.zeros(len(prints), bool)
    kept[at] = True
    kept = np.flatnonzero(kept)
    return kept, prints[kept]


def whole_windows(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints of all n-word windows."""
    prints = grams(hashes, n)
    at = np.arange(len(prints))
    at = at[at + n <= np.repeat(offsets[1:], np.diff(offsets))[: len(at)]]
    return at, prints[at] + np.uint64(n)


def benchmark_prints(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, item) of the benchmark, and (print, item, at, n) of its different word sequences; item is the words joined by spaces."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b" ".join(words(x)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["item_id", "item"])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = word_hashes(batch.column(0))
            counts = np.diff(offsets)
            short = np.flatnonzero((counts > 0) & (counts < WINDOW))
            at, found = winnowed(hashes, offsets)
            row = np.searchsorted(offsets, at, "right") - 1
            parts = [(row, at - offsets[row], found, counts[row])]
            for n in np.unique(counts[short]).tolist():
                at, found = whole_windows(hashes, offsets, n)
                row = np.searchsorted(offsets, at, "right") - 1
                own = counts[row] == n
                parts.append((row[own], at[own] - offsets[row[own]], found[own], counts[row[own]]))
            row, at, found, n = map(np.concatenate, zip(*parts))
            columns = [pa.array(found.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["print", "item", "at", "n"])

    items = benchmark.select("item_id", "text").mapInArrow(fold, "item_id long, item string").filter("item != ''")
    items = materialize(items, "items")
    return items, materialize(items.select("item").distinct().mapInArrow(prints, "print long, item string, at int, n int"), "item-prints")


def seeds(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, item, shift): shift = place in the document - place in the item of a shared fingerprint."""
    short = [r.n for r in prints.filter(F.col("n") < WINDOW).select("n").distinct().collect()]  # 9 numbers at most
    spark, sent = docs.sparkSession, None
    different = prints.select("print").distinct()
    if different.count() <= SENT_AT_MOST:
        known = np.sort(different.toPandas()["print"].to_numpy().view(np.uint64))
        sent = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if sent is None else sent.value
        for batch in batches:
            for start, stop in batches_of(batch.column(1)):
                part = batch.slice(start, stop - start)
                hashes, offsets = word_hashes(part.column(1))
                parts = [winnowed(hashes, offsets), *(whole_windows(hashes, offsets, n) for n in short)]
                at, found = map(np.concatenate, zip(*parts))
                if known is not None:
                    place = np.searchsorted(known, found)
                    keep = known[np.minimum(place, len(known) - 1)] == found if len(known) else np.zeros(len(found), bool)
                    at, found = at[keep], found[keep]
                row = np.searchsorted(offsets, at, "right") - 1
                columns = [part.column(0).take(pa.array(row)), pa.array((at - offsets[row]).astype(np.int32)), pa.array(found.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "print"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place int, print long")
    return found.join(prints, "print").select("doc_id", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()


def extend(text: list[bytes], item: list[bytes], shift: int, hit: np.ndarray) -> bool:
    """Mark the words that lie in runs of a window's length or more along one shift; whether there are any."""
    need, run, found = min(WINDOW, len(item)), 0, False
    for k in range(max(0, shift), min(len(text), shift + len(item)) + 1):
        if k < min(len(text), shift + len(item)) and text[k] == item[k - shift]:
            run += 1
            continue
        if run >= need:
            hit[k - run : k], found = True, True
        run = 0
    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurring window) and items (ids of the items with such, as sorted strings).

    Null or wordless texts have no words; so have such items, which never occur. Items that repeat are all listed. A
    repeated doc_id gives a row each, by its own text; a null doc_id is a value like others. Former columns of the three
    names go, others stay.
    """
    docs = docs.drop("n_words", "n_hit", "items")
    items, prints = benchmark_prints(benchmark)
    ids = items.groupBy("item").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    found = seeds(docs, prints).join(ids, "item")
    grouped = found.groupBy("doc_id").agg(F.collect_list(F.struct("item", "ids", "shift")).alias("seeds__"))
    grouped = materialize(grouped.withColumnRenamed("doc_id", "seed__id"), "seeds")
    joined = docs.join(grouped, F.col("doc_id").eqNullSafe(F.col("seed__id")), "left").drop("seed__id")
    kept, text_at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in batches_of(batch.column(text_at)):
                part = batch.slice(start, stop - start)
                counts, hits, items = [], [], []
                for text, seeded in zip(part.column(text_at), part.column(part.num_columns - 1).to_pylist()):
                    found = words(text.as_py())
                    counts.append(len(found))
                    hit, ids = np.zeros(len(found), bool), set()
                    for seed in seeded or ():
                        if extend(found, seed["item"].encode().split(b" "), seed["shift"], hit):
                            ids.update(seed["ids"])
                    hits.append(int(hit.sum()))
                    items.append(sorted(ids))
                more = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*kept, "n_words", "n_hit", "items"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return joined.mapInArrow(run, ", ".join([*fields, "n_words long, n_hit long, items array<string>"]))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows."""
    return contamination(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


REPORT_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dg JOIN bg USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
