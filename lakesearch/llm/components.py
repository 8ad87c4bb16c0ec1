"""Connected components of an edge table by contraction; links and labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize, release, spread_join


def components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long), a != b, no nulls. Returns (node, component): each node of an edge with the
    smallest node it reaches.

    Each round, every node hooks onto its smallest neighbour if that is smaller; the resulting forest is
    halved twice by pointer jumping, and the edges are contracted to the trees' (partial) roots. Edges
    inside one tree vanish. The number of rounds is logarithmic in the longest path, one or two for
    the star-like graphs of copies. A hub is no hot spot: minima are pre-aggregated before the shuffle,
    and the joins against the contraction map deal the rows of a hub to several tasks.
    """
    edge = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    labels = materialize(
        edge.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels"
    )
    while not edge.isEmpty():
        hook = materialize(edge.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"), F.count("*").alias("n")), "hook")
        degree = hook.select(F.col("node").alias("a"), "n")
        jumped = [hook.drop("n")]
        for _ in range(2):
            over = jumped[-1].select(F.col("node").alias("up"), F.col("up").alias("up2"))
            jump = spread_join(jumped[-1], over, "up", "left", ("node",)).select("node", F.coalesce("up2", "up").alias("up"))
            jumped.append(materialize(jump, "jump"))
        up = jumped[-1]
        below = spread_join(labels, up.withColumnRenamed("node", "component"), "component", "left", ("node",)).select(
            "node", F.coalesce("up", "component").alias("component")
        )
        new_labels = materialize(below, "labels")
        left = up.select(F.col("node").alias("a"), F.col("up").alias("a2"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("b2"))
        met = spread_join(edge, left, "a", salt=("b",), counts=degree)
        fans = edge.groupBy("b").agg(F.count("*").alias("n"))
        moved = spread_join(met, right, "b", "left", ("a",), fans).select(F.col("a2").alias("a"), F.coalesce("b2", "b").alias("b"))
        new_edge = materialize(
            moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
        )
        release(edge, labels, hook, *jumped[1:])
        edge, labels = new_edge, new_labels
    release(edge)
    return labels
