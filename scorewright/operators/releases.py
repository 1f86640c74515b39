"""Chains of releases: who descends from whom, what breaks a chain, and which pin of a case is in force at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.sources.scratch import written


def _jumps(releases: DataFrame) -> list[DataFrame]:
    """Tables (release_id, up): the ancestor 1, 2, 4, 8 ... steps above each release that has one; as many as the longest chain
    needs. No release may be in a cycle or below one."""
    known = releases.select(F.col("release_id").alias("parent_id"))
    jump = written(releases.filter("parent_id IS NOT NULL").join(known, "parent_id", "left_semi").select("release_id", F.col("parent_id").alias("up")))
    out = []
    while not jump.isEmpty():
        out.append(jump)
        onward = jump.select(F.col("release_id").alias("up"), F.col("up").alias("far"))
        jump = written(jump.join(onward, "up").select("release_id", F.col("far").alias("up")))
    return out


def _above(start: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(release_id, ancestor, steps): each release of start with itself and all its ancestors, found by halving steps: each
    number of steps is one sum of powers of two, so no pair is found twice."""
    out = start.select("release_id", F.col("release_id").alias("ancestor"), F.lit(0).cast("long").alias("steps"))
    for k in range(len(jumps) - 1, -1, -1):
        j = jumps[k].select(F.col("release_id").alias("ancestor"), F.col("up"))
        out = written(out.unionByName(out.join(j, "ancestor").select("release_id", F.col("up").alias("ancestor"), (F.col("steps") + (1 << k)).alias("steps"))))
    return out


def lineages(releases: DataFrame) -> DataFrame:
    """(release_id, root_id, depth, state): where each release's chain begins and how many releases are above it.

    state: complete, missing_parent (the chain ends at a parent that is not there), cycle (it never ends; root and depth are null).
    Only the last ancestor of each release is followed, by pointer doubling, so a chain may be of any length. Of a release that
    is listed with several parents the least counts, see chain_faults. In round k all releases with less than 2^k above them have
    ended, and those with just 2^k end; so once none ends in a round, what is left never does: the rounds follow the longest
    chain that ends, not the number of releases.
    """
    one = releases.groupBy("release_id").agg(F.min("parent_id").alias("parent_id"))
    known = one.select(F.col("release_id").alias("parent_id"), F.lit(True).alias("there"))
    at = one.join(known, "parent_id", "left").select("release_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("steps"), (F.col("parent_id").isNotNull() & F.col("there").isNull()).alias("lost"))
    at = written(at.withColumn("root", F.when(F.col("up").isNull(), F.col("release_id"))))
    going = at.filter("up IS NOT NULL").count()
    while going:
        onward = at.select(F.col("release_id").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"), F.col("lost").alias("far_lost"), F.col("root").alias("far_root"))
        moved = at.filter("up IS NOT NULL").join(onward, "up")
        moved = moved.select("release_id", F.col("far").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("far_lost").alias("lost"), F.col("far_root").alias("root"))
        at = written(at.filter("up IS NULL").unionByName(moved))
        before, going = going, at.filter("up IS NOT NULL").count()
        if going == before:
            break
    cycle = F.col("up").isNotNull()
    state = F.when(cycle, "cycle").when(F.col("lost"), "missing_parent").otherwise("complete")
    return at.select("release_id", F.col("root").alias("root_id"), F.when(~cycle, F.col("steps")).alias("depth"), state.alias("state"))


def chain_faults(releases: DataFrame, cases: DataFrame, gold: DataFrame) -> DataFrame:
    """(release_id, fault, n): what breaks a chain or a release's pins, and how often.

    several_parents, fork (n releases name it as their parent), cycle, missing_parent (also of those below), case_without_gold,
    gold_without_case, repeated_case, repeated_gold. cases: (release_id, case_id, ...), gold: (release_id, case_id, ...).
    """
    fault = lambda df, name, n: df.select("release_id", F.lit(name).alias("fault"), n.cast("long").alias("n"))
    r = written(releases.select("release_id", "parent_id").distinct())
    parents = r.groupBy("release_id").agg(F.count_distinct("parent_id").alias("n")).filter("n > 1")
    children = r.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("release_id")).agg(F.count_distinct("release_id").alias("n")).filter("n > 1").join(r.select("release_id").distinct(), "release_id", "left_semi")
    broken = lineages(r).filter("state <> 'complete'")
    per = lambda df, what: df.groupBy("release_id", "case_id").agg(F.count(F.lit(1)).alias(what))
    pins = per(cases, "c").join(per(gold, "g"), ["release_id", "case_id"], "full_outer")
    sums = pins.groupBy("release_id").agg(*[F.sum(F.when(x, 1).otherwise(0)).alias(k) for k, x in (("case_without_gold", F.col("g").isNull()), ("gold_without_case", F.col("c").isNull()), ("repeated_case", F.col("c") > 1), ("repeated_gold", F.col("g") > 1))])
    out = fault(parents, "several_parents", F.col("n")).unionByName(fault(children, "fork", F.col("n"))).unionByName(broken.select("release_id", F.col("state").alias("fault"), F.lit(1).cast("long").alias("n")))
    return out.unionByName(sums.unpivot("release_id", ["case_without_gold", "gold_without_case", "repeated_case", "repeated_gold"], "fault", "n").filter("n > 0"))


def effective_selection(releases: DataFrame, cases: DataFrame, gold: DataFrame) -> DataFrame:
    """(head_id, case_id, release_id, steps, case_pin, gold_pin): for every release that none succeeds, the pins in force: of each
    case those of the nearest release above it (or its own) that pins it.

    cases: (release_id, case_id, case_pin), gold: (release_id, case_id, gold_pin); a case without gold in its release is no pin.
    Heads whose chain lacks a parent have none; in a cycle there is no head. Of pins that repeat in a release the least counts.
    """
    r = written(releases.groupBy("release_id").agg(F.min("parent_id").alias("parent_id")))
    sound = written(r.join(lineages(r).filter("state = 'complete'").select("release_id"), "release_id", "left_semi"))
    heads = sound.join(r.select(F.col("parent_id").alias("release_id")), "release_id", "left_anti")
    least = lambda df, pin: df.groupBy("release_id", "case_id").agg(F.min(F.struct(pin)).alias(pin))
    pins = least(cases, "case_pin").join(least(gold, "gold_pin"), ["release_id", "case_id"])
    pins = pins.select("release_id", "case_id", F.struct(F.col("case_pin.case_pin"), F.col("gold_pin.gold_pin")).alias("pin"))
    above = _above(heads, _jumps(sound)).withColumnRenamed("release_id", "head_id").withColumnRenamed("ancestor", "release_id")
    near = above.join(pins, "release_id").groupBy("head_id", "case_id").agg(F.min(F.struct("steps", "release_id", "pin")).alias("x"))
    return near.select("head_id", "case_id", "x.release_id", "x.steps", "x.pin.case_pin", "x.pin.gold_pin")
