"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge and is not its component's smallest node, the root.

    `edges` has the columns a and b. A large star links the larger neighbours of each node to its smallest neighbour, a
    small star its smaller ones; both take the minimum before the shuffle and join it back, so no task holds a hub's
    neighbours. Each round is written to the shared folder. Self links and rows with nulls are left out.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_least"))
        least = least.select("_a", F.least("_a", "_least").alias("_least"))
        large = both.where("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_least").alias("b"))
        large = materialize(large.where("a != b").distinct(), "edges")
        least = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_least"))
        small = large.join(least, F.col("a") == F.col("_a"))
        small = small.select(F.greatest("b", "_least").alias("a"), F.least("b", "_least").alias("b")).union(least)
        edges = materialize(small.where("a != b").distinct(), "edges")
