"""Connected components of a graph of written edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, component (one of its nodes) for every node of edges (a, b).

    In each round a node goes to the first of itself and its neighbours in an order drawn for the round, and from
    there once more; the edges between what the nodes went to are the next round's graph. Whatever the numbering
    of the nodes, chains included, a round leaves a third of them or so, so that all rounds together cost little more
    than the first.
    """
    cur = scratch.write(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    loops = edges.where("a = b").select(F.col("a").alias("rid")).distinct()
    maps: list[DataFrame] = []
    while True:
        turn = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), F.col(c).alias("rid"))
        both = cur.select("a", "b").union(cur.select("b", "a"))
        best = both.groupBy("a").agg(F.min(turn("b")).alias("near")).select(F.col("a").alias("rid"), F.least("near", turn("a"))["rid"].alias("up"))
        best = scratch.write(best, "near")
        step = scratch.write(best.join(best.select(F.col("rid").alias("up"), F.col("up").alias("top")), "up").select("rid", F.col("top").alias("up")), "map")
        scratch.drop(best)
        maps.append(step)
        ends = cur.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x != y")
        rest = scratch.write(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        scratch.drop(cur)
        cur = rest
        if not cur.limit(1).count():
            break
    label = maps[-1].toDF("rid", "component")
    for step in reversed(maps[:-1]):
        label = scratch.write(step.join(label.toDF("up", "top"), "up", "left").select("rid", F.coalesce("top", "up").alias("component")), "labels")
    return label.unionByName(loops.join(label, "rid", "left_anti").withColumn("component", F.col("rid")))
