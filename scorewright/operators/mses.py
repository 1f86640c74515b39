"""Minimal sufficient evidence: some path of clauses must hold, a clause by any one of its alternatives.

Tables: gold (case_id, path, clause, evidence_id), one row per alternative; items (case_id, stage, evidence_id, rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAR = 10**12


def explode_paths(cases: DataFrame, paths: str = "evidence_paths") -> DataFrame:
    """gold rows of case_id and an array<array<array<string>>> of paths, clauses, alternatives."""
    one = cases.select("case_id", F.posexplode(paths).alias("path", "clauses"))
    two = one.select("case_id", "path", F.posexplode("clauses").alias("clause", "alternatives"))
    return two.select("case_id", "path", "clause", F.explode("alternatives").alias("evidence_id"))


def expand_paths(cases: DataFrame, clauses: str = "clauses", most: int = 1024) -> DataFrame:
    """(case_id, paths, n_paths): every choice of one of the options (each a list of ids, all needed) in each clause.

    Cases with more than `most` choices have null paths: the number is known before any is made.
    """
    count = F.aggregate(clauses, F.lit(1).cast("bigint"), lambda acc, c: acc * F.size(c))
    kind = "array<array<string>>"

    def step(acc, options):
        joined = F.transform(acc, lambda path: F.transform(options, lambda o: F.array_distinct(F.concat(path, o))))
        return F.flatten(joined)

    start = F.array(F.array().cast("array<string>")).cast(kind)
    made = F.array_distinct(F.aggregate(clauses, start, step))
    return cases.select("case_id", F.when(count <= most, made).alias("paths"), count.alias("n_paths"))


def clause_ranks(gold: DataFrame, items: DataFrame, grid: DataFrame) -> DataFrame:
    """(case_id, stage, k, path, clause, rank): the least rank <= k of a clause's alternatives, null if there is none.

    grid (case_id, stage, k) is what is asked for, so that stages without any item appear. A null k means no limit.
    """
    # the least rank within k is the least of all if that is within k: one join and aggregation serve all cutoffs
    asked = grid.groupBy("case_id", "stage").agg(F.collect_set(F.struct("k")).alias("cutoffs")).join(gold, "case_id")
    best = items.groupBy("case_id", "stage", "evidence_id").agg(F.min("rank").alias("rank"))
    joined = asked.join(best, ["case_id", "stage", "evidence_id"], "left")
    least = joined.groupBy("case_id", "stage", "path", "clause").agg(F.min("rank").alias("least"), F.first("cutoffs").alias("cutoffs"))
    inside = F.when(F.col("k").isNull() | (F.col("least") <= F.col("k")), F.col("least"))
    return least.select("case_id", "stage", "path", "clause", "least", F.inline("cutoffs")).select("case_id", "stage", "k", "path", "clause", inside.alias("rank"))


def path_coverage(clauses: DataFrame) -> DataFrame:
    """Per path: clauses hit and in all, whether it is complete, the greatest rank of its hits."""
    return clauses.groupBy("case_id", "stage", "k", "path").agg(
        F.count("rank").alias("hits"),
        F.count(F.lit(1)).alias("clauses"),
        F.max("rank").alias("last_rank"),
    ).withColumn("complete", F.col("hits") == F.col("clauses"))


def best_path(paths: DataFrame, ranks_of_incomplete: bool = True) -> DataFrame:
    """The path of each (case_id, stage, k): complete first, then by part hit, least last rank, fewest clauses, first.

    With ranks_of_incomplete = False only complete paths are told apart by their ranks.
    """
    rank = F.coalesce("last_rank", F.lit(_FAR))
    rank = rank if ranks_of_incomplete else F.when(F.col("complete"), rank).otherwise(_FAR)
    order = F.struct(~F.col("complete"), -F.col("hits") / F.col("clauses"), rank, "clauses", "path")
    rest = F.struct(*[c for c in paths.columns if c not in ("case_id", "stage", "k")])
    return paths.groupBy("case_id", "stage", "k").agg(F.min_by(rest, order).alias("best")).select("case_id", "stage", "k", "best.*")


def ranked_gold(gold: DataFrame, items: DataFrame, stages: DataFrame, how: str = "inner") -> DataFrame:
    """stages joined with gold by case, and `rank`, the least of the case's items of that stage and evidence, null if there is none.

    The items of a case come to it as one list: all meet by case, so tables that are dealt by case are not shuffled again, and what
    is grouped by case_id and more afterwards is not either.
    """
    of_case = items.groupBy("case_id").agg(F.collect_list(F.struct("stage", "evidence_id", "rank")).alias("its"))
    s = stages.join(of_case, "case_id", "left").withColumn("its", F.filter("its", lambda x: x["stage"] == F.col("stage")))
    found = F.filter("its", lambda x: x["evidence_id"] == F.col("evidence_id"))
    return s.join(gold, "case_id", how).withColumn("rank", F.array_min(F.transform(found, lambda x: x["rank"]))).drop("its")


def paths_at(gold: DataFrame, items: DataFrame, stages: DataFrame, cutoffs: tuple) -> DataFrame:
    """Paths of each row of stages (case_id, stage, ...): the columns of stages, path, clauses, and for the i-th cutoff hits_i and
    last_i, the number and the greatest rank of the clauses that are hit within it; None means no limit.

    Cutoffs are columns, so no row is multiplied by them, and a case is dealt out once: what is grouped by case_id and more
    afterwards needs no further shuffle. A stage whose case has no gold keeps one row with a null path and no clause.
    """
    dealt = ranked_gold(gold, items, stages, "left").select(*stages.columns, "path", "clause", "rank")
    least = dealt.groupBy(*stages.columns, "path", "clause").agg(F.min("rank").alias("rank"))
    inside = [F.col("rank") if k is None else F.when(F.col("rank") <= k, F.col("rank")) for k in cutoffs]
    return least.groupBy(*stages.columns, "path").agg(
        F.count("path").alias("clauses"), *[F.count(x).alias(f"hits_{i}") for i, x in enumerate(inside)], *[F.max(x).alias(f"last_{i}") for i, x in enumerate(inside)]
    )


def best_at(paths: DataFrame, stages: DataFrame, cutoffs: tuple, ranks_of_incomplete: bool = True) -> DataFrame:
    """The columns of stages, k, path, hits, clauses, last_rank, complete: best_path of paths_at for every cutoff; path and what
    follows are null where there is no path."""
    def best(i: int) -> Column:
        whole = F.col(f"hits_{i}") == F.col("clauses")
        rank = F.coalesce(f"last_{i}", F.lit(_FAR))
        rank = rank if ranks_of_incomplete else F.when(whole, rank).otherwise(_FAR)
        order = F.struct((~whole).alias("short"), (-F.col(f"hits_{i}") / F.col("clauses")).alias("part"), rank.alias("by"), "clauses", "path", F.col(f"hits_{i}").alias("hits"), F.col(f"last_{i}").alias("last_rank"))
        return F.min(F.when(F.col("path").isNotNull(), order)).alias(f"best_{i}")

    per = paths.groupBy(*stages.columns).agg(*[best(i) for i in range(len(cutoffs))])
    row = lambda i, k: F.struct(F.lit(k).cast("int").alias("k"), F.col(f"best_{i}").alias("best"))
    out = per.select(*stages.columns, F.inline(F.array(*[row(i, k) for i, k in enumerate(cutoffs)])))
    return out.select(*stages.columns, "k", "best.path", "best.hits", "best.clauses", "best.last_rank", (~F.col("best.short")).alias("complete"))
