"""Corpus statistics over feature columns: scores, contributions, windows, outliers, clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def uniform_baseline(k: int) -> float:
    """Share in percent that one of k equal features takes off a distance: 100 (1 - sqrt((k - 1) / k))."""
    return 100 * (1 - ((k - 1) / k) ** 0.5)


def zscores(rows: DataFrame, columns: list[str], *, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Columns less their mean over their population deviation, within ``by``; deviation 0 counts as 1.

    Means and deviations are aggregated first (one row per group) and joined, so
    no window ever holds a whole table.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    keys = by or []
    means = rows.groupBy(*keys).agg(*(mean(c).alias(f"_m_{c}") for c in columns))
    near = rows.join(F.broadcast(means), keys) if keys else rows.crossJoin(F.broadcast(means))
    spread = near.groupBy(*keys).agg(*(F.sqrt(F.sum(w * (F.col(c) - F.col(f"_m_{c}")) ** 2) / F.sum(w)).alias(f"_s_{c}") for c in columns))
    near = near.join(F.broadcast(spread), keys) if keys else near.crossJoin(F.broadcast(spread))
    scored = near.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns})
    return scored.select(*rows.columns)


def contributions(scored: DataFrame, columns: list[str], key: str, *, by: list[str], weight: str | None = None) -> DataFrame:
    """Per group and feature, by how many percent the mean pairwise distance falls when the feature is left out.

    Pairs are made within groups only; their squared differences are computed
    once, and each feature's taken off the sum.
    """
    left = scored.select(*by, F.col(key).alias("_i"), *(F.col(c).alias(f"_a_{c}") for c in columns), (F.col(weight) if weight else F.lit(1.0)).alias("_wa"))
    right = scored.select(*by, F.col(key).alias("_j"), *(F.col(c).alias(f"_b_{c}") for c in columns), (F.col(weight) if weight else F.lit(1.0)).alias("_wb"))
    pairs = left.join(right, by).where("_i < _j").select(*by, (F.col("_wa") * F.col("_wb")).alias("_w"), *(((F.col(f"_a_{c}") - F.col(f"_b_{c}")) ** 2).alias(c) for c in columns))
    pairs = pairs.withColumn("_all", total([F.col(c) for c in columns]))
    mean = lambda x: F.try_divide(F.sum(F.col("_w") * x), F.sum("_w"))
    full = mean(F.sqrt("_all"))
    return pairs.groupBy(*by).agg(*(F.try_divide(100 * (full - mean(F.sqrt(F.greatest(F.col("_all") - F.col(c), F.lit(0.0))))), full).alias(c) for c in columns))


def moving_windows(rows: DataFrame, order: str, key: str, width: int, step: int, *, group: str) -> DataFrame:
    """Rows of every full window of ``width`` ranks, started every ``step``, with ``start`` added; a row is in width / step of them."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(order, key)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    first = F.greatest(F.lit(0), F.ceil((F.col("_rn") - (width - 1)) / step))
    last = F.least(F.floor(F.col("_rn") / step), F.floor((F.col("_n") - width) / step))
    spread = ranked.where(first <= last).withColumn("_w", F.explode(F.sequence(first, last)))
    return spread.withColumn("start", F.col("_w") * step).drop("_rn", "_n", "_w")


def crossings(windows: DataFrame, x: str, density: str, dynamic: str, baseline: float, *, group: str) -> DataFrame:
    """``d_star_sparse``: first x, going up, at which density overtakes the dynamic share; ``d_star_dense``: first, going down, at which it falls under the baseline."""
    order = Window.partitionBy(group).orderBy(x)
    rows = windows.select(group, F.col(x).alias("x"), (F.col(density) - F.col(dynamic)).alias("a"), (F.col(density) - baseline).alias("b"))
    rows = rows.select("*", F.lag("x").over(order).alias("x0"), F.lag("a").over(order).alias("a0"), F.lag("b").over(order).alias("b0"))
    up = F.when((F.col("a0") < 0) & (F.col("a") >= 0), F.col("x0") + F.try_divide(0 - F.col("a0"), F.col("a") - F.col("a0")) * (F.col("x") - F.col("x0")))
    down = F.when((F.col("b") < 0) & (F.col("b0") >= 0), F.col("x") + F.try_divide(0 - F.col("b"), F.col("b0") - F.col("b")) * (F.col("x0") - F.col("x")))
    rows = rows.withColumn("up", up).withColumn("down", down)
    return rows.groupBy(group).agg(F.min_by("up", F.when(F.col("up").isNotNull(), F.col("x"))).alias("d_star_sparse"), F.max_by("down", F.when(F.col("down").isNotNull(), F.col("x"))).alias("d_star_dense"))


def average_rank(column: str, *by: str) -> Column:
    """Rank in which equal values share the mean of their places."""
    same = F.count("*").over(Window.partitionBy(*by, column))
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (same - 1) / 2


def sample_skewness(column: str) -> Column:
    """Skewness with the usual small-sample correction; null under three rows."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def adaptive_bins(rows: DataFrame, column: str, bins: int = 36, *, most_skew: float = 2.0) -> DataFrame:
    """``bin`` added: equal steps between the outer half percents, ends clipped into the first and last.

    Where the sample skewness is beyond ``most_skew`` the scale is the decimal
    logarithm, with values moved just above zero if some are not positive.
    """
    seen = rows.agg(sample_skewness(column).alias("skew"), F.min(column).alias("least")).first()
    x = F.col(column)
    if seen["skew"] is not None and abs(seen["skew"]) > most_skew:
        x = F.log10(x + F.lit(max(1e-6, 1e-6 - seen["least"])))
    scaled = rows.withColumn("_x", x)
    low, high = scaled.agg(F.percentile("_x", 0.005).alias("low"), F.percentile("_x", 0.995).alias("high")).first() or (None, None)
    if low is None:
        return rows.withColumn("bin", F.lit(None).cast("long"))
    high = high if high > low else low + 1e-9
    at = F.floor((F.col("_x") - F.lit(low)) / F.lit(high - low) * F.lit(bins))
    return scaled.withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)).cast("long")).drop("_x")


def mahalanobis(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``maha`` added: distance from the mean under the pseudo-inverse of the sample covariance.

    Only the k means and the k by k covariances come to the driver.
    """
    k = len(columns)
    found = rows.agg(*(F.avg(c) for c in columns), *(F.covar_samp(columns[i], columns[j]) for i in range(k) for j in range(i, k))).first()
    means, at, cov = found[:k], k, np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = found[at] if found[at] is not None else 0.0
            at += 1
    inverse = np.linalg.pinv(cov)
    centred = [F.col(c) - F.lit(float(m or 0.0)) for c, m in zip(columns, means)]
    square = total([float(inverse[i, j]) * centred[i] * centred[j] for i in range(k) for j in range(k)])
    return rows.withColumn("maha", F.sqrt(F.greatest(square, F.lit(0.0))))


def spread_pick(rows: DataFrame, score: str, lat: str, lon: str, n: int, apart_km: float, probe: int = 120) -> list:
    """The ``n`` best of the ``probe`` highest scores that are ``apart_km`` from each other, best first."""
    picked = []
    for row in rows.orderBy(F.col(score).desc(), lat, lon).limit(probe).collect():
        p, q = np.radians([row[lat], row[lon]])
        far = True
        for other in picked:
            a, b = np.radians([other[lat], other[lon]])
            far &= 2 * 6371 * np.arcsin(np.sqrt(np.sin((p - a) / 2) ** 2 + np.cos(p) * np.cos(a) * np.sin((q - b) / 2) ** 2)) >= apart_km
        if far:
            picked.append(row)
        if len(picked) == n:
            break
    return picked


def vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def clusters(rows: DataFrame, columns: list[str], k: int, *, weight: str | None = None, seed: int = 1, key: str = "id") -> DataFrame:
    """``cluster`` added by k-means, numbered by falling (weighted) size."""
    means = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="_c", maxIter=50)
    if weight:
        means = means.setWeightCol(weight)
    made = vectors(rows, columns)
    made = means.fit(made).transform(made).drop("features")
    sizes = made.groupBy("_c").agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("_size"), F.min(key).alias("_least"))
    numbered = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.col("_size").desc(), "_least")) - 1).select("_c", "cluster")
    return made.join(F.broadcast(numbered), "_c").drop("_c")


def best_k(rows: DataFrame, columns: list[str], ks: range, *, weight: str | None = None, seed: int = 1) -> list[tuple[int, float]]:
    """Silhouette (squared Euclidean) of each k."""
    made, out = vectors(rows, columns).cache(), []
    for k in ks:
        means = KMeans(k=k, seed=seed, maxIter=50)
        if weight:
            means = means.setWeightCol(weight)
        out.append((k, ClusteringEvaluator().evaluate(means.fit(made).transform(made))))
    made.unpersist()
    return out


def principal_axes(rows: DataFrame, columns: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """``pc1 ..`` added, each axis turned so that its largest loading is positive; and the explained shares."""
    made = vectors(rows, columns)
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(made)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.abs(loadings[:, i]).argmax(), i]) or 1.0) for i in range(k)]
    axes = {f"pc{i + 1}": total([float(signs[i] * loadings[j, i]) * F.col(c) for j, c in enumerate(columns)]) for i in range(k)}
    return rows.withColumns(axes), [float(x) for x in model.explainedVariance]


def participation(eigenvalues: np.ndarray) -> float:
    return float(eigenvalues.sum() ** 2 / (eigenvalues**2).sum())


def average_linkage_order(distance: np.ndarray) -> list[int]:
    """Leaf order of average-linkage clustering of a small distance matrix."""
    groups = {i: [i] for i in range(len(distance))}
    while len(groups) > 1:
        ids = sorted(groups)
        best = min(((distance[np.ix_(groups[a], groups[b])].mean(), a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]))
        _, a, b = best
        groups[a] = groups[a] + groups.pop(b)
    return next(iter(groups.values())) if groups else []


def bootstrap_rows(rows: DataFrame, key: str, replicates: int, *, group: str, seed: int = 0) -> DataFrame:
    """``replicate`` added: each group resampled with replacement to its own size.

    The t-th pick of a replicate is a hash of (group, replicate, t), so a rerun
    picks the same rows; the picks are an equi-join on rank.
    """
    ranked = rows.withColumn("_pick", F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    draws = ranked.select(group, F.col("_pick").alias("_t"), "_n").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.select(group, "replicate", F.pmod(F.xxhash64(F.col(group).cast("string"), "replicate", "_t", F.lit(seed)), F.col("_n")).cast("int").alias("_pick"))
    return draws.join(ranked.drop("_n"), [group, "_pick"]).drop("_pick")
