"""Which rows of a table a fragment of it holds, by what the rows read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: The lengths of fragments, the commonest first, whose windows are counted at once.
_LENGTHS = 64


def fragment_rows(fragments: DataFrame, tables: DataFrame) -> DataFrame:
    """(fragment_id, table_id, first, last, places): the rows of its table that each fragment can be; first and last are null
    unless there is exactly one such place.

    fragments: (fragment_id, table_id, row, signature), tables: (table_id, row, signature), rows numbered without gaps. A place
    is a run of successive rows with the fragment's signatures in order. All windows of the tables of a fragment's length are
    counted by a digest of their signatures, so equal fragments and frequent signatures multiply nothing: the work is the
    tables' rows times the different lengths of their fragments. Fragments with gaps, and of lengths beyond the _LENGTHS
    commonest, are tried where their rarest signature is.
    """
    keys = ["fragment_id", "table_id"]
    inside = Window.partitionBy(*keys).orderBy("row")
    f = fragments.withColumn("shift", F.col("row") - F.row_number().over(inside))
    low = f.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), (F.min("shift") == F.max("shift")).alias("sound"))
    counts = low.groupBy("n", "sound").agg(F.count(F.lit(1)).alias("fragments"))
    most = counts.filter("sound").orderBy(F.desc("fragments"), "n").limit(_LENGTHS).collect()
    lengths = sorted(x.n for x in most)
    known = F.col("sound") & F.col("n").isin(*lengths) if lengths else F.lit(False)
    out = low.filter(known).select(*keys, "n")
    asked = _windows(fragments, keys, lengths).withColumn("first_row", F.min("row").over(inside)).filter("row = first_row").join(out, [*keys, "n"])
    by_table = out.select("table_id", "n").distinct()
    met = _windows(tables, ["table_id"], lengths).join(F.broadcast(by_table) if _few(by_table) else by_table, ["table_id", "n"])
    places = met.groupBy("table_id", "n", "key").agg(F.count(F.lit(1)).alias("places"), F.min("row").alias("at"))
    j = out.join(asked.join(places, ["table_id", "n", "key"]).select(*keys, "places", "at"), keys, "left").withColumn("places", F.coalesce("places", F.lit(0).cast("long")))
    one = F.col("places") == 1
    found = j.select(*keys, F.when(one, F.col("at")).alias("first"), F.when(one, F.col("at") + F.col("n") - 1).alias("last"), "places")
    if counts.agg(F.sum("fragments")).first()[0] == sum(x.fragments for x in most):
        return found
    return found.unionByName(_by_rarest(fragments.join(low.filter(~known).select(*keys), keys, "left_semi"), tables))


def _few(df: DataFrame, most: int = 1_000_000) -> bool:
    return df.limit(most + 1).count() <= most


def _windows(rows: DataFrame, part: list[str], lengths: list[int]) -> DataFrame:
    """(part, row, n, key): a digest of the signatures of the n rows from each row on, for each of lengths, where there are so
    many without a null. Digests of 1, 2, 4 ... rows are made of each other; one of n rows is two of them that overlap."""
    w = Window.partitionBy(*part).orderBy("row")
    digest = lambda c: F.unhex(F.md5(c))
    ahead = lambda k, by: F.concat(f"k{k}", F.lead(f"k{k}", by).over(w))
    out = rows.select(*part, "row", digest(F.col("signature").cast("string").cast("binary")).alias("k0"))
    for k in range(1, max(lengths, default=1).bit_length()):
        out = out.withColumn(f"k{k}", digest(ahead(k - 1, 1 << (k - 1))))
    key = lambda n, k: F.col(f"k{k}") if n == 1 << k else digest(ahead(k, n - (1 << k)))
    every = [F.struct(F.lit(n).alias("n"), key(n, n.bit_length() - 1).alias("key")) for n in lengths] or [F.struct(F.lit(0).alias("n"), F.lit(None).cast("binary").alias("key"))]
    return out.select(*part, "row", F.array(*every).alias("every")).select(*part, "row", F.inline("every")).filter("key IS NOT NULL")


def _by_rarest(fragments: DataFrame, tables: DataFrame) -> DataFrame:
    """fragment_rows of fragments of any shape: places are tried where the fragment's rarest signature is, and count if as many rows
    agree as the fragment has."""
    keys = ["fragment_id", "table_id"]
    often = tables.groupBy("table_id", "signature").agg(F.count(F.lit(1)).alias("often"))
    f = fragments.join(often, ["table_id", "signature"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    low = f.groupBy(*keys).agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("row", "signature"), F.struct("often", "row")).alias("rare"), F.min("often").alias("least"))
    tried = low.filter("least > 0").join(tables.select("table_id", F.col("row").alias("at"), F.col("signature").alias("rare_signature")), "table_id").filter("rare_signature = rare.signature")
    tried = tried.select(*keys, "low", "n", (F.col("at") - F.col("rare.row")).alias("shift"))
    agree = tried.join(f.select(*keys, "row", "signature"), keys).withColumn("row", F.col("row") + F.col("shift")).join(tables, ["table_id", "row", "signature"])
    whole = agree.groupBy(*keys, "low", "n", "shift").agg(F.count(F.lit(1)).alias("agree")).filter("agree = n")
    per = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("places"), F.min(F.col("low") + F.col("shift")).alias("first"), F.min(F.col("low") + F.col("shift") + F.col("n") - 1).alias("last"))
    out = low.select(*keys).join(per, keys, "left").withColumn("places", F.coalesce("places", F.lit(0)))
    one = F.col("places") == 1
    return out.select(*keys, F.when(one, F.col("first")).alias("first"), F.when(one, F.col("last")).alias("last"), "places")
