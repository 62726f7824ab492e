"""Stratified sampling, design weights and stratum aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified_sample(rows: DataFrame, strata: list[str], n: int, draw: Column, *ties: str) -> DataFrame:
    """``n`` rows of each stratum, those with the least draw; a draw made of the key repeats on every run."""
    order = Window.partitionBy(*strata).orderBy(draw, *ties)
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def design_weights(candidates: DataFrame, strata: list[str], target: int, fraction: float) -> DataFrame:
    """Per stratum ``n_candidates, est_total, n_sampled, weight, pool_exhausted``; candidates are a ``fraction`` of all."""
    counts = candidates.groupBy(*strata).agg(F.count("*").alias("n_candidates"))
    counts = counts.withColumn("est_total", F.col("n_candidates") / F.lit(fraction)).withColumn("n_sampled", F.least("n_candidates", F.lit(target).cast("long")))
    return counts.withColumn("weight", F.col("est_total") / F.col("n_sampled")).withColumn("pool_exhausted", F.col("n_candidates") < target)


def stratum_counts(rows: DataFrame, strata: list[str], done: str = "done") -> DataFrame:
    counts = rows.groupBy(*strata).agg(F.count("*").alias("n_attempted"), F.count_if(F.col(done)).alias("n_done"), F.count_if(~F.col(done)).alias("n_failed"))
    return counts.withColumn("empty_rate", F.col("n_failed") / F.col("n_attempted"))


def realised_weights(counts: DataFrame) -> DataFrame:
    """``design_weight`` from what was attempted, ``est_nonempty`` from what wasn't empty."""
    rows = counts.withColumn("design_weight", F.col("est_total") / F.col("n_attempted"))
    return rows.withColumn("est_nonempty", F.round(F.col("est_total") * (1 - F.col("empty_rate"))).cast("long"))
