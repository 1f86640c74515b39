"""Importance resampling towards a target distribution of hashed word features.

Identical texts are collapsed first: rows are grouped by the digest of their full text, and one row of each group is read
for its features. Their counts go into the corpus's totals times the group's number of rows; a text's weight is computed once
and joined back to all its rows, which then get noise of their own by doc_id. The rows of the highest sums are drawn:
sampling without replacement in proportion to the weights' exponentials (Gumbel noise).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import claim, discard, from_shelf, give_back, materialize, numbered, on_shelf, placed, recorded, shelve, small_batches, utf8, with_values
from scorewright.llm.words import _FOLD, CACHE_BYTES, ENTRY_BYTES, batches_of

#: Buckets of features; words in a feature at most; percent of the documents with LEAST_WORDS words or more that are drawn;
#: what the noise is seeded with.
BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024


class _Buckets(dict):
    """Word to the bucket of its hash, as many as there is room for."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.room = buckets, CACHE_BYTES

    def __missing__(self, word: bytes) -> int:
        out = zlib.crc32(word) % self.buckets
        if (cost := len(word) + ENTRY_BYTES) <= self.room:
            self.room -= cost
            self[word] = out
        return out


def text_features(texts: pa.Array, buckets: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text the number of words and the buckets (uint32) of all its runs of 1 to `longest` words."""
    data, offsets = utf8(texts)
    of = claim("buckets").setdefault(buckets, _Buckets(buckets)).__getitem__
    for start, stop in zip(offsets.tolist(), offsets[1:].tolist()):
        found = data[start:stop].tobytes().translate(_FOLD).split()
        parts = [np.fromiter(map(of, found), np.uint32, len(found))]
        for k in range(2, longest + 1):
            runs = (zlib.crc32(b" ".join(found[i : i + k])) % buckets for i in range(len(found) - k + 1))
            parts.append(np.fromiter(runs, np.uint32, max(0, len(found) - k + 1)))
        yield len(found), np.concatenate(parts)


def features(docs: DataFrame, keep: list[str], buckets: int, longest: int) -> DataFrame:
    """The columns keep, n_words, n_features and buckets (uint32 numbers in order, as bytes) of each row's text."""
    given = docs.select(*keep, "text")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "n_words long, n_features long, buckets binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in batches_of(batch.column(len(keep))):
                part = batch.slice(start, stop - start)
                found = list(text_features(part.column(len(keep)), buckets, longest))
                more = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([np.sort(x).tobytes() for _, x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*keep, "n_words", "n_features", "buckets"])
        give_back()

    return given.mapInArrow(run, fields)


def bucket_totals(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features there are in each bucket; a row's count n times. A number per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for n, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                own, times = np.unique(np.frombuffer(own.as_buffer(), np.uint32), return_counts=True)
                total[own] += n * times
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "total"])

    rows = found.select("n", "buckets").mapInArrow(run, "bucket long, total long").groupBy("bucket").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("total").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of a bucket's smoothed shares in target and corpus)."""
    s, t, k = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """found with its buckets replaced by weight, the sum of their gains."""
    sent = found.sparkSession.sparkContext.broadcast(gain)  # a number per bucket
    kept = found.drop("buckets")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            sums = [int(sent.value[np.frombuffer(x.as_buffer(), np.uint32)].sum()) for x in batch.column(last)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(sums, pa.int64())], names=[*names, "weight"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "weight long"])
    return found.select(*names, "buckets").mapInArrow(run, schema)


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, file__, row__, n_words, n_features, weight, score, rank) of each row of docs, and the place it was read from.

    rank: 1, 2, 3 ... for the rows drawn, percent of those with at least least_words words; null for others. Equal scores
    rank by ascending doc_id, null last. Every row counts, copies and rows of a repeated doc_id too; noise depends on the
    doc_id alone (on nothing, if it is null). Null and empty texts have no features and weight 0. An empty target has no
    features, as has an empty table, which gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = placed(docs)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest")
    with recorded() as made:
        rows = materialize(docs.select("doc_id", "file__", "row__", digest), "rows")
        first = F.min(F.struct("file__", "row__")).alias("first")
        groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first)
        shelf = shelve(groups.select("first.file__", "first.row__", "n"), "texts")
        one_each = docs.filter(on_shelf(shelf)("file__", "row__")).select("text", digest, from_shelf(shelf, "n")("file__", "row__").alias("n"))
        found = materialize(features(one_each, ["digest", "n"], buckets, longest), "features")
        goal = features(target.select("text"), [], buckets, longest).select(F.lit(1).cast("long").alias("n"), "buckets")
        gain = gains(bucket_totals(found, buckets), bucket_totals(goal, buckets))
        weights = materialize(weighted(found, gain), "weights")
        n_rows = rows.count()
        scored = with_values(rows, weights, "digest", n_rows).drop("digest", "n")
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
        scored = scored.withColumn("score", F.col("weight") + noise)
        low = (F.col("n_words") < least_words).alias("low")
        out = numbered(scored.withColumn("low__", low), [], [F.col("low__"), F.desc("score"), F.asc_nulls_last("doc_id")], n_rows)
        drawn = out.filter("NOT low__").count() * percent // 100
    discard(spark, made, out)
    rank = F.when(~F.col("low__") & (F.col("place") < drawn), F.col("place") + 1)
    return out.withColumn("rank", rank).drop("low__", "place")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that `importance` draws, with all their columns."""
    docs = placed(docs)
    drawn = shelve(importance(docs, target, **options).filter("rank IS NOT NULL").select("file__", "row__"), "drawn")
    return docs.filter(on_shelf(drawn)("file__", "row__")).drop("file__", "row__")


def resampling_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows."""
    return importance(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


_CRC_TABLE = "(SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"


def crc32_sql(bytes_list: str, table: str) -> str:
    """SQL for the unsigned CRC-32 of a list of byte values; table is the name of _CRC_TABLE's list."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_list}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
RESAMPLING_SQL = rf"""
WITH crc AS {_CRC_TABLE},
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dt AS (SELECT doc_id, unnest(w) AS word FROM dw),
bt AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
wb AS (SELECT word, {crc32_sql("list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::bigint)", "t")} % {BUCKETS} AS b
  FROM (SELECT word FROM dt UNION SELECT word FROM bt), crc),
s AS (SELECT b, count(*) AS s FROM dt JOIN wb USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bt JOIN wb USING (word) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0)::bigint FROM s) + {BUCKETS}) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0)::bigint FROM t) + {BUCKETS}))))::bigint AS g
  FROM s FULL JOIN t USING (b)),
w AS (SELECT doc_id, count(*) AS n, sum(g)::bigint AS weight FROM dt JOIN wb USING (word) JOIN g USING (b) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint AS score FROM dw LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM d WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM r) * {PERCENT} // 100 THEN r END AS rank FROM d LEFT JOIN r USING (doc_id)
"""
