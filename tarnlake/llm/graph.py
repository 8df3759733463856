"""Connected components over links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the smallest node that can be reached.

    Each round a node goes over to the first among itself and its neighbours, and links run between those
    that were gone to. The order is that of the nodes in the first round, which ends stars around their
    smallest node, and a fresh hash after that: on a path about half of the nodes are left, whatever their
    numbers, so rounds grow as the logarithm of the longest path and tables shrink with them. A hub costs
    partial aggregation on one side and a join that adaptive execution can split on the other.
    """
    spark = edges.sparkSession
    live = shared.staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), folder, f"{name}-links0")
    turn, steps = 0, []
    while not live.isEmpty():
        up = live.groupBy("a").agg(F.min(F.least(_place("a", turn), _place("b", turn)))["node"].alias("up"))
        up = shared.staged(up.withColumnRenamed("a", "node"), folder, f"{name}-up{turn}")
        steps.append(up)
        first = up.select(F.col("node").alias("a"), F.col("up").alias("x"))
        second = up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        after = live.join(first, "a").join(second, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        live = shared.staged(after, folder, f"{name}-links{turn + 1}")
        shared.unstage(spark, folder, f"{name}-links{turn}")
        turn += 1
    shared.unstage(spark, folder, f"{name}-links{turn}")
    if not steps:
        return spark.createDataFrame([], "node long, comp long")
    # from the last round back: where a node's place went on to, there the node is too
    root = steps[-1]
    for k in range(turn - 2, -1, -1):
        on = root.select(F.col("node").alias("up"), F.col("up").alias("to"))
        root = shared.staged(steps[k].join(on, "up", "left").select("node", F.coalesce("to", "up").alias("up")), folder, f"{name}-root{k}")
        shared.unstage(spark, folder, f"{name}-root{k + 1}")
        shared.unstage(spark, folder, f"{name}-up{k + 1}")
    least = root.groupBy("up").agg(F.min("node").alias("comp"))
    return root.join(least, "up").select("node", "comp")


def _place(node: str, turn: int) -> Column:
    """Where a node stands in a round's order."""
    by = F.col(node) if turn == 0 else F.xxhash64(F.col(node), F.lit(turn))
    return F.struct(by.alias("by"), F.col(node).alias("node"))
