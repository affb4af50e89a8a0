"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm._shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); component is the smallest node that can be reached.

    In each round a node that is its own label takes the smallest neighbour, if that is smaller, all labels jump to
    their label's label, and edges move to the labels of their ends.  Edges within one label go, so a round has as
    many rows as edges are left, whatever the number of rounds; labels only join, and what they join stays joined.
    Each round is written tables, so lost executors cost at most one round.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = materialize(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("component")))
    while True:
        near = left.groupBy(F.col("b").alias("end")).agg(F.min("a").alias("m"))  # a is the smaller end
        hook = F.when(F.col("node") == F.col("component"), F.least("component", "m")).otherwise(F.col("component"))
        hooked = labels.join(near, F.col("node") == F.col("end"), "left").select("node", F.col("component").alias("old"), hook.alias("c"))
        jump = hooked.select(F.col("node").alias("at"), F.col("c").alias("next"))
        now = materialize(hooked.join(jump, F.col("c") == F.col("at")).select("node", F.col("next").alias("component"), (F.col("next") < F.col("old")).alias("moved")))
        discard(labels)
        labels = now.select("node", "component")
        if now.where("moved").isEmpty() and left.isEmpty():
            discard(left)
            return labels
        of = lambda end, new: labels.select(F.col("node").alias(end), F.col("component").alias(new))
        ends = left.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
        before, left = left, materialize(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(before)
