"""From curves to scalar indicators, by window functions.

A curve is a long table ``series, d, g`` (percolation), ``series, r, lambda``
(lacunarity) or ``series, q, tau`` (multifractal); windows never cross series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(order: str = "d") -> Window:
    return Window.partitionBy("series").orderBy(order)


def max_slope(curve: DataFrame) -> DataFrame:
    """``series, r_crit``: middle of the steepest step, the first of equals; the only d of a one-point curve."""
    steps = curve.select("series", "d", F.lag("d").over(_along()).alias("d0"), "g", F.lag("g").over(_along()).alias("g0"))
    slope = (F.col("g") - F.col("g0")) / (F.col("d") - F.col("d0") + 1e-20)
    steps = steps.withColumn("slope", slope).withColumn("mid", F.when(F.col("d0").isNotNull(), (F.col("d") + F.col("d0")) * 0.5))
    best = F.max_by("mid", F.when(F.col("slope").isNotNull(), F.struct("slope", -F.col("d"))))
    return steps.groupBy("series").agg(F.coalesce(best, F.max("d")).alias("r_crit"))


def first_reach(curve: DataFrame, target: float, name: str) -> DataFrame:
    """``series, name``: where g first is ``target`` or more, by interpolation from the point before.

    The last d if it never is, the first if it is from the start.
    """
    steps = curve.select("series", "d", "g", F.lag("d").over(_along()).alias("d0"), F.lag("g").over(_along()).alias("g0"))
    at = F.when(F.col("d0").isNull(), F.col("d")).otherwise(F.col("d0") + F.try_divide(target - F.col("g0"), F.col("g") - F.col("g0")) * (F.col("d") - F.col("d0")))
    found = F.min(F.when(F.col("g") >= target, F.struct("d", at.alias("at"))))["at"]
    return steps.groupBy("series").agg(F.coalesce(found, F.max("d")).alias(name))


def strict_crossing(curve: DataFrame, target: float, name: str) -> DataFrame:
    """As ``first_reach``, but the point before must be under ``target``; the first d if the last g is not under it either."""
    steps = curve.select("series", "d", "g", F.lag("d").over(_along()).alias("d0"), F.lag("g").over(_along()).alias("g0"))
    crosses = (F.col("g0") < target) & (F.col("g") >= target)
    at = F.col("d0") + F.try_divide(target - F.col("g0"), F.col("g") - F.col("g0")) * (F.col("d") - F.col("d0"))
    found = F.min(F.when(crosses, F.struct("d", at.alias("at"))))["at"]
    edge = F.when(F.max_by("g", "d") < target, F.max("d")).otherwise(F.min("d"))
    return steps.groupBy("series").agg(F.coalesce(found, edge).alias(name))


def transition_width(curve: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    both = first_reach(curve, low, "r_low").join(first_reach(curve, high, "r_high"), "series")
    return both.select("series", (F.col("r_high") - F.col("r_low")).alias("w_trans"))


def critical_slope(curve: DataFrame, r_crit: DataFrame) -> DataFrame:
    """``series, gamma``: slope at the grid point nearest to r_crit (the lower of two), central where both neighbours exist."""
    near = curve.join(r_crit, "series").select(
        "series", "d", F.abs(F.col("d") - F.col("r_crit")).alias("away"),
        F.coalesce(F.lead("g").over(_along()), F.col("g")).alias("g1"), F.coalesce(F.lag("g").over(_along()), F.col("g")).alias("g0"),
        F.coalesce(F.lead("d").over(_along()), F.col("d")).alias("d1"), F.coalesce(F.lag("d").over(_along()), F.col("d")).alias("d0"),
    )
    slope = F.when(F.col("d1") > F.col("d0"), (F.col("g1") - F.col("g0")) / (F.col("d1") - F.col("d0")))
    return near.withColumn("slope", slope).groupBy("series").agg(F.min_by("slope", F.struct("away", "d")).alias("gamma"))


def susceptibility(curve: DataFrame) -> DataFrame:
    """``series, chi_d, chi_max``: where n (1 - g) g peaks, the first of equals; n is the series' number of points."""
    n = F.count("*").over(Window.partitionBy("series"))
    chi = curve.select("series", "d", (n * (1 - F.col("g")) * F.col("g")).alias("chi"))
    best = F.max(F.struct("chi", (-F.col("d")).alias("back")))
    return chi.groupBy("series").agg(best.alias("b")).select("series", (-F.col("b.back")).alias("chi_d"), F.col("b.chi").alias("chi_max"))


def interpolate(curve: DataFrame, at: DataFrame, x: str, name: str) -> DataFrame:
    """``series, name``: g at the position in column ``x`` of ``at``, linear between points and flat beyond the ends."""
    steps = curve.select("series", "d", "g", F.lead("d").over(_along()).alias("d1"), F.lead("g").over(_along()).alias("g1"))
    met = steps.join(at, "series")
    inside = (F.col("d") <= F.col(x)) & (F.col(x) < F.col("d1"))
    value = F.col("g") + F.try_divide(F.col(x) - F.col("d"), F.col("d1") - F.col("d")) * (F.col("g1") - F.col("g"))
    edge = F.when(F.max(x) >= F.max("d"), F.max_by("g", "d")).otherwise(F.min_by("g", "d"))
    return met.groupBy("series").agg(F.coalesce(F.max(F.when(inside, value)), edge).alias(name))


def falling_envelope(curve: DataFrame) -> DataFrame:
    """Lacunarity as published: at least 1, never rising with r, the last point 1."""
    upto = _along("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clamped = curve.withColumn("lambda", F.min(F.greatest(F.col("lambda"), F.lit(1.0))).over(upto))
    return clamped.withColumn("lambda", F.when(F.lead("r").over(_along("r")).isNull(), F.lit(1.0)).otherwise(F.col("lambda")))


def log_slope(rows: DataFrame, y: str, x: str, *keys: str) -> DataFrame:
    """Least squares of ln y on ln x per key over positive points: ``slope, intercept, r2, n``; null under two points."""
    kept = rows.where((F.col(x) > 0) & (F.col(y) > 0)).withColumn("_x", F.ln(x)).withColumn("_y", F.ln(y))
    return kept.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_r2("_y", "_x").alias("r2"), F.count("*").alias("n"))


def smooth5(column: str, order: str = "q") -> Column:
    """Quadratic fit over five points, read in the middle; ends repeat their last value."""
    w = _along(order)
    first, last = F.first(column).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last(column).over(w.rowsBetween(0, Window.unboundedFollowing))
    back = lambda k: F.coalesce(F.lag(column, k).over(w), first)
    ahead = lambda k: F.coalesce(F.lead(column, k).over(w), last)
    return (-3 * back(2) + 12 * back(1) + 17 * F.col(column) + 12 * ahead(1) - 3 * ahead(2)) / 35


def gradient(y: str, x: str) -> Column:
    """Central differences on an even grid, one-sided at the ends."""
    w = _along(x)
    y0, y1 = F.coalesce(F.lag(y).over(w), F.col(y)), F.coalesce(F.lead(y).over(w), F.col(y))
    x0, x1 = F.coalesce(F.lag(x).over(w), F.col(x)), F.coalesce(F.lead(x).over(w), F.col(x))
    return F.when(x1 > x0, (y1 - y0) / (x1 - x0))


def spectrum(tau: DataFrame) -> DataFrame:
    """``series, q, tau, alpha, f_alpha`` of raw ``series, q, tau``: smoothed, differentiated, its hull made one-humped.

    Under five points nothing is smoothed. In the order of alpha, f rises to its
    first maximum and falls after it: each point takes the larger of what it has
    and what lies further from the top.
    """
    n = F.count("*").over(Window.partitionBy("series"))
    rows = tau.withColumn("_n", n).withColumn("_s", smooth5("tau")).withColumn("tau", F.when(F.col("_n") >= 5, F.col("_s")).otherwise(F.col("tau"))).drop("_n", "_s")
    rows = rows.withColumn("alpha", gradient("tau", "q")).withColumn("f", F.col("q") * F.col("alpha") - F.col("tau"))
    order = Window.partitionBy("series").orderBy("alpha", "q")
    rows = rows.withColumn("place", F.row_number().over(order))
    top = F.max(F.struct("f", (-F.col("place")).alias("back"))).over(Window.partitionBy("series"))
    rows = rows.withColumn("top", -top["back"])
    up = F.max("f").over(order.rowsBetween(Window.unboundedPreceding, 0))
    down = F.max("f").over(order.rowsBetween(0, Window.unboundedFollowing))
    hull = F.when(F.col("place") <= F.col("top"), up).otherwise(down)
    return rows.select("series", "q", "tau", "alpha", F.greatest(hull, F.lit(0.0)).alias("f_alpha"))


def dimensions(spectrum_rows: DataFrame) -> DataFrame:
    """``series, q, dim``: tau / (q - 1), and alpha at q = 1."""
    return spectrum_rows.select("series", "q", F.when(F.col("q") == 1, F.col("alpha")).otherwise(F.col("tau") / (F.col("q") - 1)).alias("dim"))


def dimension_gap(dims: DataFrame) -> DataFrame:
    """``series, delta_d``: dimension at the q nearest to 0 less that nearest to 2."""
    near = lambda q: F.min_by("dim", F.struct(F.abs(F.col("q") - q), F.col("q")))
    return dims.groupBy("series").agg((near(0) - near(2)).alias("delta_d"))


def spectrum_skewness(spectrum_rows: DataFrame) -> DataFrame:
    """``series, s_alpha``: third standardised moment of alpha with weights f(alpha) > 0; null under three points, 0 without spread."""
    kept = spectrum_rows.where("f_alpha > 0")
    own = Window.partitionBy("series")
    kept = kept.withColumn("mean", F.try_divide(F.sum(F.col("alpha") * F.col("f_alpha")).over(own), F.sum("f_alpha").over(own)))
    away = F.col("alpha") - F.col("mean")
    sums = kept.groupBy("series").agg(F.count("*").alias("n"), F.sum("f_alpha").alias("w"), F.sum(F.col("f_alpha") * away**2).alias("m2"), F.sum(F.col("f_alpha") * away**3).alias("m3"))
    sd = F.sqrt(F.col("m2") / F.col("w"))
    value = F.when(F.col("n") < 3, F.lit(None)).when(sd == 0, F.lit(0.0)).otherwise(F.col("m3") / F.col("w") / (sd * sd * sd))
    return sums.select("series", value.alias("s_alpha"))


def percolation_indicators(curve: DataFrame) -> DataFrame:
    """``series, r_crit, perc_dcrit, perc_gmax, w_trans, gamma`` of every curve."""
    crit = max_slope(curve)
    gmax = curve.groupBy("series").agg(F.max("g").alias("perc_gmax"))
    parts = [crit, strict_crossing(curve, 0.5, "perc_dcrit"), gmax, transition_width(curve), critical_slope(curve, crit)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "series", "left")
    return out
