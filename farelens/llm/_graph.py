"""Connected components of links, in Spark, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import saved


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Each round sends every node to its smallest neighbour or itself and keeps the links between what remains, so a
    component's smallest node survives and the number of rounds is logarithmic in practice.  Rounds are written to
    the shared folder; composing them backwards gives the labels.
    """
    rest = saved(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.select("a", "b").union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"), "contract")
        steps.append(to)
        left, right = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = rest.join(left, "a").join(right, "b").where("x != y")
        # A node and its target must stay linked when the target moves on too.
        own = to.where("node != to").join(to.select(F.col("node").alias("to"), F.col("to").alias("up")), "to").where("to != up")
        pairs = moved.select("x", "y").union(own.select(F.col("to").alias("x"), F.col("up").alias("y")))
        rest = saved(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not steps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = steps.pop()
    while steps:
        up = labels.select(F.col("node").alias("to"), F.col("to").alias("top"))
        labels = steps.pop().join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"))
    return labels.select("node", F.col("to").alias("component"))
