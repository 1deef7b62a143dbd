"""Moves of files that may collide: which can be made, in which order, and why others can't.

A move is an edge from a path to its target. Of several moves to one target the least path's counts, the others are refused and
stay where they are. Then every path has at most one move out and one in, so what remains are chains and cycles. A chain whose
last target is free is made from its end (``turn`` 0 first); if a file that doesn't move stands there, the whole chain is
refused. A cycle is made by way of a free name: its least path steps aside first and comes to its target last.

Chains and cycles are found by pointer jumping: each round joins every move with the one that it waits for and doubles the reach,
so their number is the logarithm of the longest chain. Tables between rounds are written to ``work``, a folder that executors share.

Rows without a path, without a target or whose target is their path are no moves. A path that is listed twice has the lesser
target. Files need no row in ``existing`` to be moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASIDE = ".moving"


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _jumped(edges: DataFrame, work: str, n: int) -> DataFrame:
    """Of edges(path, next; next null at an end): path, end (null in a cycle), turn (steps to the end), least (of the paths met)."""
    rows = _stored(edges.select("path", F.col("next").alias("to"), F.col("next").isNotNull().cast("long").alias("turn"), F.col("path").alias("least"), F.col("path").alias("end")), f"{work}/0")
    reach, k = 1, 0
    while not rows.where("to is not null").isEmpty() and reach <= 2 * n:
        ahead = rows.select(F.col("path").alias("__p"), F.col("to").alias("__to"), F.col("turn").alias("__turn"), F.col("least").alias("__least"), F.col("end").alias("__end"))
        met = rows.join(ahead, rows["to"] == ahead["__p"], "left")
        k, reach = k + 1, reach * 2
        waits = F.col("to").isNotNull()
        rows = _stored(
            met.select(
                "path", F.when(waits, F.col("__to")).alias("to"), F.when(waits, F.col("turn") + F.col("__turn")).otherwise(F.col("turn")).alias("turn"),
                F.when(waits, F.least("least", "__least")).otherwise(F.col("least")).alias("least"), F.when(waits, F.col("__end")).otherwise(F.col("end")).alias("end"),
            ),
            f"{work}/{k}",
        )
    return rows.select("path", F.when(F.col("to").isNull(), F.col("end")).alias("end"), "turn", "least")


def ordered_moves(planned: DataFrame, existing: DataFrame, work: str) -> DataFrame:
    """path, target, made, reason, turn, aside of planned(path, target) among existing(path).

    reason is null for a move that can be made, else ``claimed`` (another path's target), ``taken`` (a file that stays is there) or
    ``blocked`` (the file there would have to move, but can't). aside is the free name by which a cycle's least path goes.
    """
    moves = planned.where("path is not null and target is not null and path <> target").groupBy("path").agg(F.min("target").alias("target"))
    first = Window.partitionBy("target").orderBy("path")
    moves = _stored(moves.withColumn("nth", F.row_number().over(first)), f"{work}/moves")
    claimed = moves.where("nth > 1").select("path", "target", F.lit("claimed").alias("reason"))
    won = moves.where("nth = 1").select("path", "target")
    n = won.count()
    sources = won.select(F.col("path").alias("next"))
    edges = won.join(sources, won["target"] == sources["next"], "left")
    found = _jumped(edges.select("path", "next"), f"{work}/chains", n).join(won, "path")
    found = _stored(found, f"{work}/found")
    # chains: what stands at the last target decides for all
    stays = existing.select(F.col("path").alias("target")).unionByName(claimed.select(F.col("path").alias("target"))).distinct()
    ends = found.where("end = path").select("path", "target").join(stays, "target", "left_semi").select(F.col("path").alias("end"), F.lit(True).alias("shut"))
    chains = found.where("end is not null").join(ends, "end", "left")
    reason = F.when(F.col("shut"), F.when(F.col("end") == F.col("path"), "taken").otherwise("blocked"))
    chains = chains.select("path", "target", reason.alias("reason"), F.when(F.col("shut").isNull(), F.col("turn")).alias("turn"), F.lit(None).cast("string").alias("aside"))
    # cycles: the least path steps aside, so whoever goes to its place is an end
    cycles = found.where("end is null")
    cut = _jumped(cycles.select("path", F.when(F.col("target") != F.col("least"), F.col("target")).alias("next")), f"{work}/cycles", n)
    cycles = cut.select("path", F.col("turn").alias("step")).join(cycles, "path")
    cycles = cycles.select("path", "target", F.lit(None).cast("string").alias("reason"), F.col("step").alias("turn"), F.when(F.col("path") == F.col("least"), F.concat("path", F.lit(ASIDE))).alias("aside"))
    lost = claimed.select("path", "target", "reason", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("aside"))
    out = chains.unionByName(cycles).unionByName(lost)
    return out.select("path", "target", F.col("reason").isNull().alias("made"), "reason", "turn", "aside")
