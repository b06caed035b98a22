"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagora.llm.common import stage

MAX_ROUNDS = 200


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node with an edge.

    ``edges``: (a, b), in either direction. Each round sends the label of one
    end to the other end and to that end's label, takes the smallest, and jumps
    to the label's label; long chains shrink by a factor per round. Rounds end
    when no label changes. Every round is a written table.
    """
    e = stage(edges.filter("a <> b").select(
        F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    ).select("e.a", "e.b").distinct(), "edges")
    labels = stage(e.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        sent = e.join(la, "a").join(lb, "b").filter("la < lb")
        said = sent.select(F.explode(F.array("b", "lb")).alias("node"), F.col("la").alias("label"))
        best = stage(labels.unionByName(said).groupBy("node").agg(
            F.min("label").alias("label")), "labels-hooked")
        up = best.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = stage(best.join(up, "label").select("node", F.col("up").alias("label")), "labels")
        before = labels.select("node", F.col("label").alias("was"))
        moved = after.join(before, "node").filter("label <> was").limit(1).count()
        labels = after
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
