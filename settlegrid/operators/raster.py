"""Box masses of rasters: lacunarity and mass exponents, as aggregates over sparse pixels and as numpy kernels."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlegrid.functions.spatial import shifts


def gliding_masses(pixels: DataFrame, r: int, size: int) -> DataFrame:
    """``loc, r0, c0, mass`` of every box of side ``r`` that lies inside and isn't empty.

    Columns first, then rows: a pixel is dealt to ``r`` boxes twice, not to ``r`` squared.
    """
    inside = lambda c: F.sequence(F.greatest(F.lit(0), F.col(c) - (r - 1)), F.least(F.col(c), F.lit(size - r)))
    across = pixels.where(F.greatest(F.lit(0), F.col("col") - (r - 1)) <= F.least(F.col("col"), F.lit(size - r))).select("loc", "row", F.explode(inside("col")).alias("c0"))
    across = across.groupBy("loc", "row", "c0").agg(F.count("*").alias("m"))
    down = across.where(F.greatest(F.lit(0), F.col("row") - (r - 1)) <= F.least(F.col("row"), F.lit(size - r))).select("loc", "c0", "m", F.explode(inside("row")).alias("r0"))
    return down.groupBy("loc", "r0", "c0").agg(F.sum("m").alias("mass"))


def lacunarity(pixels: DataFrame, sizes: list[int], size: int) -> DataFrame:
    """``loc, r, lambda, sigma, mu, cv``: 1 + variance / mean squared of the masses of all gliding boxes, empty ones included."""
    parts = []
    for r in sizes:
        n = (size - r + 1) ** 2
        masses = gliding_masses(pixels, r, size)
        parts.append(masses.groupBy("loc").agg((F.sum("mass") / n).alias("mu"), (F.sum(F.col("mass") * F.col("mass")) / n).alias("sq")).withColumn("r", F.lit(r)))
    sums = reduce(DataFrame.unionByName, parts)
    sums = sums.withColumn("sigma", F.sqrt(F.greatest(F.col("sq") - F.col("mu") ** 2, F.lit(0.0))))
    ratio = F.when(F.col("mu") > 0, F.col("sigma") / F.col("mu"))
    return sums.select("loc", "r", F.coalesce(1 + ratio**2, F.lit(1.0)).alias("lambda"), "sigma", "mu", ratio.alias("cv"))


def box_masses(pixels: DataFrame, r: int, size: int, most_shifts: int) -> DataFrame:
    """``loc, dx, dy, mass, n``: how many boxes of the shifted grids of side ``r`` have each mass; strips at the edge are left out."""
    grid = [(dx, dy) for dx in shifts(r, most_shifts) for dy in shifts(r, most_shifts)]
    at = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in grid)))
    dealt = pixels.select("loc", "row", "col", at.alias("s")).select("loc", "s.dx", "s.dy", F.floor((F.col("row") - F.col("s.dy")) / r).alias("i"), F.floor((F.col("col") - F.col("s.dx")) / r).alias("j"))
    whole = (F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") < F.floor((size - F.col("dy")) / r)) & (F.col("j") < F.floor((size - F.col("dx")) / r))
    masses = dealt.where(whole).groupBy("loc", "dx", "dy", "i", "j").agg(F.count("*").alias("mass"))
    return masses.groupBy("loc", "dx", "dy", "mass").agg(F.count("*").alias("n"))


def partition(pixels: DataFrame, sizes: list[int], qs: list[float], size: int, most_shifts: int = 16) -> DataFrame:
    """``loc, r, q, z``: the partition sum, averaged over the shifted grids.

    Masses are shares of the whole raster. At q = 1 the sum is exp(-sum m ln m).
    """
    totals = pixels.groupBy("loc").agg(F.count("*").alias("all"))
    parts = []
    for r in sizes:
        m = box_masses(pixels, r, size, most_shifts).join(F.broadcast(totals), "loc").withColumn("m", F.col("mass") / F.col("all"))
        for q in qs:
            each = F.exp(-F.sum(F.col("n") * F.col("m") * F.ln("m"))) if q == 1 else F.sum(F.col("n") * F.exp(F.lit(float(q)) * F.ln("m")))
            z = m.groupBy("loc", "dx", "dy").agg(each.alias("z")).where("z > 0")
            parts.append(z.groupBy("loc").agg(F.avg("z").alias("z")).select("loc", F.lit(r).alias("r"), F.lit(float(q)).alias("q"), "z"))
    return reduce(DataFrame.unionByName, parts)


def mass_exponents(z: DataFrame) -> DataFrame:
    """``loc, q, tau, r2``: slope of ln z on ln r."""
    points = z.select("loc", "q", F.ln("r").alias("x"), F.ln(F.col("z") + 1e-300).alias("y"))
    return points.groupBy("loc", "q").agg(F.regr_slope("y", "x").alias("tau"), F.regr_r2("y", "x").alias("r2"))


def integral(image: np.ndarray) -> np.ndarray:
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64 if image.dtype.kind in "iub" else np.float64)
    out[1:, 1:] = image.cumsum(0, dtype=out.dtype).cumsum(1)
    return out


def lacunarity_kernel(image: np.ndarray, sizes: list[int]) -> list[tuple[int, float, float, float]]:
    """``(r, lambda, sigma, mu)`` over one raster, by its integral image; an empty raster is an error."""
    if not image.any():
        raise ValueError("the raster is empty")
    table, out = integral(image), []
    for r in sizes:
        if r > min(image.shape):
            continue
        masses = table[r:, r:] - table[:-r, r:] - table[r:, :-r] + table[:-r, :-r]
        mu, sigma = float(masses.mean()), float(masses.std())
        out.append((r, 1 + (sigma / mu) ** 2 if mu > 0 else 1.0, sigma, mu))
    return out


def partition_kernel(image: np.ndarray, sizes: list[int], qs: np.ndarray, most_shifts: int = 16) -> np.ndarray:
    """Partition sums, a row per q and a column per size; integer rasters go by histograms of masses."""
    table, total = integral(image), image.sum()
    out = np.zeros((len(qs), len(sizes)))
    one = qs == 1
    for k, r in enumerate(sizes):
        sums, used = np.zeros(len(qs)), np.zeros(len(qs))
        for dx in shifts(r, most_shifts):
            for dy in shifts(r, most_shifts):
                rows, cols = np.arange(dy, image.shape[0] + 1, r), np.arange(dx, image.shape[1] + 1, r)
                if len(rows) < 2 or len(cols) < 2:
                    continue
                corner = table[np.ix_(rows, cols)]
                boxes = (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]).ravel()
                masses, n = np.unique(boxes[boxes > 0], return_counts=True)
                if not len(masses):
                    continue
                m = masses / total
                z = (n * np.exp(qs[:, None] * np.log(m))).sum(1)
                z[one] = np.exp(-(n * m * np.log(m)).sum())
                sums, used = sums + np.where(z > 0, z, 0), used + (z > 0)
        out[:, k] = np.divide(sums, used, out=np.zeros(len(qs)), where=used > 0)
    return out


def spectrum_kernel(z: np.ndarray, sizes: list[int], qs: np.ndarray) -> dict[str, np.ndarray]:
    """``tau, r2, alpha, f_alpha`` of partition sums: fit, smooth, differentiate, one-humped hull."""
    x, y = np.log(sizes), np.log(z + 1e-300)
    away = x - x.mean()
    tau = (y * away).sum(1) / (away**2).sum()
    rest = y - y.mean(1, keepdims=True)
    spread = (rest**2).sum(1)
    r2 = np.divide((rest * away).sum(1) ** 2, (away**2).sum() * spread, out=np.ones(len(qs)), where=spread > 0)
    if len(qs) >= 5:
        padded = np.pad(tau, 2, mode="edge")
        tau = sum(w * padded[i : i + len(qs)] for i, w in enumerate((-3, 12, 17, 12, -3))) / 35
    alpha = np.gradient(tau, qs)
    f = qs * alpha - tau
    order = np.argsort(alpha, kind="stable")
    ranked, top = f[order], int(f[order].argmax())
    hull = np.r_[np.maximum.accumulate(ranked[:top]), np.maximum.accumulate(ranked[top:][::-1])[::-1]]
    out = np.empty(len(qs))
    out[order] = np.maximum(hull, 0)
    return {"tau": tau, "r2": r2, "alpha": alpha, "f_alpha": out}
