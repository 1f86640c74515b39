"""Connected components of links in tables, by alternating large-star and small-star steps (Kiveris and others, 2014).

Neighbours are never gathered: each step takes a minimum per node, which combines before the shuffle, and joins it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import forget, materialize


def _star(arcs: DataFrame, emit) -> DataFrame:
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return emit(arcs.join(least, "u"))


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all nodes of the links (a, b) that are not the least of their component; label is that least id."""
    stars = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = state(stars)
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, lambda j: j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        small = _star(large, lambda j: j.select("v", "u", "m").select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v")))
        done, stars = stars, materialize(small.filter("u != v").distinct(), "stars")
        forget(done)
        now = state(stars)
        if now == seen:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("label"))
        seen = now
