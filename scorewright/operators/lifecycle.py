"""Append-only revision tables: latest states, legal steps, decisions, release chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The steps that a slot and a revision may take.
SLOT_STEPS = (("planned", "authored"), ("authored", "reviewed"), ("reviewed", "approved"), ("approved", "frozen"), ("planned", "blocked"), ("authored", "blocked"), ("reviewed", "blocked"), ("approved", "blocked"))
REVISION_STEPS = (("draft", "proposed"), ("proposed", "reviewed"), ("reviewed", "approved"), ("approved", "frozen"), ("proposed", "rejected"), ("reviewed", "rejected"), ("frozen", "superseded"), ("frozen", "invalidated"))


def latest(revisions: DataFrame, key: str, order: str) -> DataFrame:
    """The last revision of each entity."""
    rest = [c for c in revisions.columns if c not in (key, order)]
    picked = revisions.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("row"))
    return picked.select(key, *[F.col(f"row.{c}").alias(c) for c in (order, *rest)])


def effective(revisions: DataFrame, superseded: DataFrame, key: str, order: str) -> DataFrame:
    """The last revision of each entity among those that are not superseded (superseded: key, order)."""
    return latest(revisions.join(superseded, [key, order], "left_anti"), key, order)


def decisions(reviews: DataFrame) -> DataFrame:
    """(case_id, verdict, is_human, seq): the latest human decision, or without any the latest of a model."""
    picked = reviews.groupBy("case_id").agg(F.max(F.struct("is_human", "seq", "verdict")).alias("row"))
    return picked.select("case_id", "row.verdict", "row.is_human", "row.seq")


def illegal_steps(history: DataFrame, key: str, order: list[str], state: str, steps: tuple[tuple[str, str], ...], start: str | None = None) -> DataFrame:
    """Successive states of an entity that no allowed step joins; with `start`, a first state other than it."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = history.select(key, *order, F.lag(state).over(w).alias("before"), F.col(state).alias("after"))
    pairs = pairs.filter(F.col("before").isNotNull() | (F.lit(start is not None) & (F.col("after") != (start or ""))))
    allowed = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in steps])
    return pairs.filter(F.col("before").isNull() | ~F.array_contains(allowed, F.struct("before", "after")))


def separation_faults(revisions: DataFrame, reviews: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(revision_id, fault): authors that review themselves, adjudicators that reviewed, adjudications without two decisions."""
    own = revisions.join(reviews, "revision_id").filter("actor = reviewer").select("revision_id", F.lit("author_is_reviewer").alias("fault"))
    judged = adjudications.join(reviews, "revision_id").filter("adjudicator = reviewer").select("revision_id", F.lit("adjudicator_is_reviewer").alias("fault"))
    n = reviews.groupBy("revision_id").agg(F.count_distinct("decision").alias("n"))
    few = adjudications.join(n, "revision_id", "left").filter("coalesce(n, 0) < 2").select("revision_id", F.lit("fewer_than_two_decisions").alias("fault"))
    return own.union(judged).union(few).distinct()


def pending(entities: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """What no decision exists for."""
    return entities.join(decided.select(key).distinct(), key, "left_anti")
