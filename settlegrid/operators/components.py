"""Connected components over DataFrames, by alternating large-star and small-star rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checkpoint(df: DataFrame) -> DataFrame:
    session = df.sparkSession
    sc = session.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = session.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="settlegrid-"))
    return df.checkpoint()


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``v, root``: every node of ``edges(a, b)`` but the least of its component, with that least node.

    Each round's edges are checkpointed, so lineage doesn't grow; the number of
    rounds grows with the logarithm of the number of nodes.
    """
    current = _checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct())
    mark = None
    for _ in range(max_rounds):
        found = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)")).alias("h")).first()
        if not found["n"] or found == mark:
            return current
        mark = found
        both = current.select(F.col("v").alias("u"), F.col("root").alias("w")).union(current.select(F.col("root").alias("u"), F.col("v").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("w > u").join(low, "u").select(F.col("w").alias("v"), F.col("low").alias("root")).distinct()
        low = large.groupBy("v").agg(F.min("root").alias("low"))
        small = large.join(low, "v").where("root <> low").select(F.col("root").alias("v"), F.col("low").alias("root"))
        current = _checkpoint(small.union(low.select("v", F.col("low").alias("root"))).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
