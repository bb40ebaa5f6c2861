"""Folds of whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.operators.ranks import running_sums
from latticeworks.sources.scratch import written


def turns(loads: list[int], size: int, groups: int) -> list[tuple[int, list[int]]]:
    """How ``groups`` groups of one size go, one by one, to the lightest fold (the first of ties): runs of (first group, folds in turn). ``loads`` is brought up to date.

    The lightest folds take turns until they have caught up with the next one; there are as many runs as folds at most,
    whatever the number of groups.
    """
    out, at, k = [], 0, len(loads)
    while at < groups:
        order = sorted(range(k), key=lambda f: (loads[f], f))
        # Folds that are within one group of the lightest come before it has its next turn.
        turn = [f for f in order if (loads[f], f) < (loads[order[0]] + size, order[0])]
        outside = order[len(turn) :]
        # Whole rounds until one of them would come after the next fold's turn, or until there are no more groups.
        rounds = (groups - at) // len(turn)
        if outside:
            gap = loads[outside[0]] - loads[turn[-1]]
            rounds = min(rounds, max(0, gap // size))
        if rounds:
            out.append((at, turn))
            at += rounds * len(turn)
            for f in turn:
                loads[f] += rounds * size
        else:
            step = turn[: groups - at] if not outside else turn[:1]
            out.append((at, step))
            at += len(step)
            for f in step:
                loads[f] += size
    return out


def group_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, fold): groups by falling size, ties by key, each into the fold with the least rows so far.

    The rule is sequential, but groups of one size differ only in their turn. So the driver goes over the different
    sizes (n rows have fewer than the root of 2 n), and each group finds its turn by its rank among those of its size.
    Keys may be numbers or texts: ranks are found in ranges of bounded size.
    """
    spark = df.sparkSession
    sizes = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    loads, runs = [0] * k, []
    for row in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect():
        made = turns(loads, row["size"], row["n"])
        runs.append((row["size"], [{"first": a, "folds": f} for a, f in made]))
    table = spark.createDataFrame(runs, "size long, runs array<struct<first:long,folds:array<int>>>")
    ranked = running_sums(sizes, key, {"rank": F.lit(1)}, ["size"]).withColumn("rank", F.col("rank") - 1)
    own = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    turn = own["folds"][F.pmod(F.col("rank") - own["first"], F.size(own["folds"])).cast("int")]
    return ranked.join(table, "size").select(key, turn.alias("fold"))
