"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``v, root``: every node of ``edges(a, b)`` but the least of its component, with that least node.

    Rounds write their edges to shared storage, so no lineage grows and a lost
    executor costs one round. Minima are first combined within partitions;
    joins read written tables on both sides, so that the rows of a hub can be
    split among tasks. The number of rounds grows with the logarithm of the
    number of nodes. No edges give no rows.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct(), "edges")
    mark = _mark(current)
    for _ in range(max_rounds):
        if not mark[0]:
            return current
        both = current.select(F.col("v").alias("u"), F.col("root").alias("w")).union(current.select(F.col("root").alias("u"), F.col("v").alias("w")))
        least = materialize(both.groupBy("u").agg(F.min("w").alias("w")).select("u", F.least("u", "w").alias("low")), "least")
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("low").alias("root")).distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("v").agg(F.min("root").alias("low")), "least")
        small = large.join(least, "v").where("root <> low").select(F.col("root").alias("v"), F.col("low").alias("root"))
        current = materialize(small.union(least.select("v", F.col("low").alias("root"))).distinct(), "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            return current
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
