"""Shards of nearly equal size by longest-processing-time scheduling: groups that must stay together, the largest first,
go to the shard with the least load.

Groups are the rows of equal text. Only what decides the balance passes through the heap of the driver: each group of at
least a quantum, the total over shards * UNITS, by itself, so there are shards * UNITS of them at most; smaller groups are
strung together, the larger ones first, to runs of about a quantum, as many again at most. The loads then differ by less
than two quanta, unless a single group is larger than an even share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import discard, materialize, numbered, placed, recorded, with_values
from scorewright.llm.resampling import _CRC_TABLE, crc32_sql

#: Shards; quanta in an even share of a shard (0.02 % of its size each); bytes that a row takes besides its text.
SHARDS, UNITS, ROW_BYTES = 24, 4_096, 8
#: Groups under a quantum of which a task strings runs.
BIN_GROUPS = 250_000


def longest_first(sizes: Iterable[int], shards: int) -> list[int]:
    """The shard of each item; the sizes come in descending order. Of equal loads the least shard takes the item."""
    heap, out = [(0, s) for s in range(shards)], []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append(shard)
    return out


def scheduled(groups: DataFrame, shards: int) -> DataFrame:
    """(digest, n, shard) of the groups (digest, n, bytes), a written table.

    Items of equal size are taken in the order of their least digest.
    """
    spark = groups.sparkSession
    n_groups, total = groups.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    quantum = max(1, -(-(total or 0) // (shards * UNITS)))
    bins = max(1, -(-n_groups // BIN_GROUPS))
    large = groups.filter(F.col("bytes") >= quantum).withColumn("item", F.hex("digest"))
    larger = Window.partitionBy("bin").orderBy(F.desc("bytes"), "digest").rowsBetween(Window.unboundedPreceding, -1)
    small = groups.filter(F.col("bytes") < quantum).withColumn("bin", F.pmod(F.xxhash64("digest"), F.lit(bins)))
    small = small.withColumn("run", F.floor(F.coalesce(F.sum("bytes").over(larger), F.lit(0)) / quantum))
    small = small.withColumn("item", F.concat_ws(":", "bin", "run")).drop("bin", "run")
    marked = materialize(large.unionByName(small), "items")
    items = marked.groupBy("item").agg(F.sum("bytes").alias("bytes"), F.min("digest").alias("least")).orderBy(F.desc("bytes"), "least").select("item", "bytes").toArrow()
    plan = pa.table({"item": items.column("item"), "shard": pa.array(longest_first(items.column("bytes").to_pylist(), shards), pa.int32())})
    return marked.join(F.broadcast(spark.createDataFrame(plan)), "item").select("digest", "n", "shard")


def balanced(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, file__, row__, size, text_crc32, shard, slot) of each row of docs, and the place that it was read from.

    size: the UTF-8 bytes of its text and ROW_BYTES. Rows of equal text share a shard; null counts as the empty text.
    slot numbers the rows of a shard without gaps from 0, in the order of a hash of doc_id (of the row's place where that is
    null), so a shard is shuffled. Rows that repeat are rows of their own. An empty table gives no rows; with fewer groups
    than shards some shards stay empty. Other columns are ignored.
    """
    docs = placed(docs)
    text = F.coalesce("text", F.lit(""))
    with recorded() as made:
        own = docs.select("doc_id", "file__", "row__", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
        rows = materialize(own, "rows")
        groups = materialize(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "groups")
        plan = materialize(scheduled(groups, shards), "plan")
        n_rows = rows.count()
        key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", "file__", "row__")))
        dealt = with_values(rows, plan, "digest", n_rows).drop("digest", "n").withColumn("key__", key)
        out = numbered(dealt, ["shard"], [F.col("key__"), F.col("file__"), F.col("row__")], n_rows, "slot")
    discard(docs.sparkSession, made, out)
    return out.drop("key__")


def write_shards(docs: DataFrame, where: str, shards: int = SHARDS) -> DataFrame:
    """Writes the rows of docs under the folder `where`, a folder shard=s for each shard, with a column slot; reads them back.

    Files hold a row's neighbours by slot. Former columns shard and slot go.
    """
    docs = placed(docs.drop("shard", "slot"))
    places = balanced(docs, shards).select("file__", "row__", "shard", "slot")
    rows = docs.join(places, ["file__", "row__"]).drop("file__", "row__")
    rows.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(where)
    return docs.sparkSession.read.parquet(where)


def shard_report(docs: DataFrame) -> DataFrame:
    """The contract's rows; the law is `bytes`."""
    return balanced(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_KEY = "sha256(coalesce(text, ''))"
SHARD_SQL = f"""
WITH RECURSIVE rows AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size, {_KEY} AS digest, text FROM documents),
groups AS (SELECT digest, sum(size)::bigint AS bytes FROM rows GROUP BY digest),
cut AS (SELECT greatest(1, (sum(bytes)::bigint + {SHARDS * UNITS - 1}) // {SHARDS * UNITS}) AS quantum FROM groups),
small AS (SELECT digest, bytes, '0:' || coalesce(sum(bytes) OVER (ORDER BY bytes DESC, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint // quantum AS item FROM groups, cut WHERE bytes < quantum),
marked AS (SELECT digest, bytes, digest AS item FROM groups, cut WHERE bytes >= quantum UNION ALL SELECT digest, bytes, item FROM small),
items AS MATERIALIZED (SELECT item, sum(bytes)::bigint AS bytes, row_number() OVER (ORDER BY sum(bytes) DESC, min(digest)) AS k FROM marked GROUP BY item),
lpt AS (SELECT 0::bigint AS k, list_transform(range({SHARDS}), lambda x: 0::bigint) AS loads, -1::bigint AS shard
  UNION ALL SELECT k + 1, list_transform(loads, lambda x, j: x + CASE WHEN j = s THEN bytes ELSE 0 END), s - 1
  FROM (SELECT lpt.k, loads, list_position(loads, list_min(loads))::bigint AS s, items.bytes FROM lpt JOIN items ON items.k = lpt.k + 1)),
crc AS {_CRC_TABLE}
SELECT doc_id, size::bigint AS size, {crc32_sql("list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)", "t")} AS text_crc32, 'bytes' AS law,
 lpt.shard::integer AS shard, row_number() OVER (PARTITION BY lpt.shard ORDER BY md5(doc_id::varchar)) - 1 AS slot, NULL::integer AS grown_shard
FROM rows JOIN marked USING (digest) JOIN items USING (item) JOIN lpt USING (k), crc
"""
