"""Curves reduced to scalars: windows, crossings, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlegrid.operators import curves as c
from settlegrid.plans import views
from settlegrid.plans.registry import query

R = lambda column, name, n=6: F.round(column, n).alias(name)

STEPS = "steps AS (SELECT series, d, g, lag(d) OVER w AS d0, lag(g) OVER w AS g0, lead(d) OVER w AS d1, lead(g) OVER w AS g1 FROM v_curve WINDOW w AS (PARTITION BY series ORDER BY d))"
CRIT = """crit AS (SELECT series, arg_max((d + d0) * 0.5::DOUBLE, {'s': (g - g0) / (d - d0 + 1e-20::DOUBLE), 'd': -d}) AS r_crit FROM steps WHERE d0 IS NOT NULL GROUP BY series)"""


def reach_sql(target: float, name: str) -> str:
    return f"""{name} AS (SELECT series, coalesce(arg_min(CASE WHEN d0 IS NULL THEN d ELSE d0 + ({target}::DOUBLE - g0) / (g - g0) * (d - d0) END, d) FILTER (g >= {target}::DOUBLE), max(d)) AS pos FROM steps GROUP BY series)"""


STRICT = """strict AS (SELECT series, coalesce(arg_min(d0 + (0.5::DOUBLE - g0) / (g - g0) * (d - d0), d) FILTER (g0 < 0.5::DOUBLE AND g >= 0.5::DOUBLE),
    CASE WHEN arg_max(g, d) < 0.5::DOUBLE THEN max(d) ELSE min(d) END) AS perc_dcrit FROM steps GROUP BY series)"""
GAMMA = """near AS (SELECT s.series, s.d, abs(s.d - r_crit) AS away, (coalesce(g1, g) - coalesce(g0, g)) / (coalesce(d1, d) - coalesce(d0, d)) AS slope FROM steps s JOIN crit USING (series)),
    gam AS (SELECT series, arg_min(slope, {'a': away, 'd': d}) AS gamma FROM near GROUP BY series)"""


@query("w4_max_slope", views.sql(f"{STEPS}, {CRIT} SELECT series, round(r_crit, 6) AS r_crit FROM crit", "v_curve"))
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.max_slope(views.curves(spark, sf_dir)).select("series", R("r_crit", "r_crit"))


@query("w5_first_reach", views.sql(f"{STEPS}, {reach_sql(0.9, 'reach')} SELECT series, round(pos, 6) AS d90 FROM reach", "v_curve"))
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.first_reach(views.curves(spark, sf_dir), 0.9, "d90").select("series", R("d90", "d90"))


@query("w6_strict_crossing", views.sql(f"{STEPS}, {STRICT} SELECT series, round(perc_dcrit, 6) AS perc_dcrit FROM strict", "v_curve"))
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.strict_crossing(views.curves(spark, sf_dir), 0.5, "perc_dcrit").select("series", R("perc_dcrit", "perc_dcrit"))


@query("w7_transition_width", views.sql(f"{STEPS}, {reach_sql(0.1, 'lo')}, {reach_sql(0.9, 'hi')} SELECT series, round(hi.pos - lo.pos, 6) AS w_trans FROM lo JOIN hi USING (series)", "v_curve"))
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.transition_width(views.curves(spark, sf_dir)).select("series", R("w_trans", "w_trans"))


@query("w8_critical_slope", views.sql(f"{STEPS}, {CRIT}, {GAMMA} SELECT series, round(gamma, 6) AS gamma FROM gam", "v_curve"))
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = views.curves(spark, sf_dir)
    return c.critical_slope(curve, c.max_slope(curve)).select("series", R("gamma", "gamma"))


@query(
    "i8_percolation_indicators",
    views.sql(
        f"""{STEPS}, {CRIT}, {STRICT}, {GAMMA}, {reach_sql(0.1, 'lo')}, {reach_sql(0.9, 'hi')}, top AS (SELECT series, max(g) AS perc_gmax FROM v_curve GROUP BY series)
        SELECT series, round(r_crit, 6) AS r_crit, round(perc_dcrit, 6) AS perc_dcrit, round(perc_gmax, 6) AS perc_gmax, round(hi.pos - lo.pos, 6) AS w_trans, round(gamma, 6) AS gamma
        FROM crit JOIN strict USING (series) JOIN top USING (series) JOIN gam USING (series) JOIN lo USING (series) JOIN hi USING (series)""",
        "v_curve",
    ),
)
def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.percolation_indicators(views.curves(spark, sf_dir))
    return found.select("series", *(R(x, x) for x in ("r_crit", "perc_dcrit", "perc_gmax", "w_trans", "gamma")))


LAC = "lac AS (SELECT series, CAST(d AS BIGINT) AS r, 1.2::DOUBLE / (g + 0.2::DOUBLE) AS \"lambda\" FROM v_curve)"


def _lacunarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falling curves in place of measured lacunarity: 1.2 / (g + 0.2) over r = d."""
    return views.curves(spark, sf_dir).select("series", F.col("d").cast("long").alias("r"), (1.2 / (F.col("g") + 0.2)).alias("lambda"))


ENVELOPE = """env AS (SELECT series, r, CASE WHEN lead(r) OVER w IS NULL THEN 1.0::DOUBLE ELSE min(greatest("lambda", 1.0::DOUBLE)) OVER (w ROWS UNBOUNDED PRECEDING) END AS "lambda"
    FROM lac WINDOW w AS (PARTITION BY series ORDER BY r))"""


@query("w9_falling_envelope", views.sql(f"{LAC}, {ENVELOPE} SELECT series, r, round(\"lambda\", 6) AS \"lambda\" FROM env", "v_curve"))
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.falling_envelope(_lacunarity(spark, sf_dir)).select("series", "r", R("lambda", "lambda"))


@query("i2_lacunarity_decay", views.sql(f"{LAC}, {ENVELOPE} SELECT series, round(-regr_slope(ln(\"lambda\"), ln(r)), 6) AS beta, round(avg(\"lambda\"), 6) AS lacunarity_mean FROM env WHERE r > 0 AND \"lambda\" > 0 GROUP BY series", "v_curve"))
def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = c.falling_envelope(_lacunarity(spark, sf_dir))
    fit = c.log_slope(curve, "lambda", "r", "series").select("series", R(-F.col("slope"), "beta"))
    return fit.join(curve.groupBy("series").agg(R(F.avg("lambda"), "lacunarity_mean")), "series")


@query("e12_log_log_fit", views.sql("SELECT series, round(regr_slope(ln(g), ln(d)), 6) AS slope, round(regr_intercept(ln(g), ln(d)), 6) AS intercept, round(regr_r2(ln(g), ln(d)), 6) AS r2, count(*) AS n FROM v_curve WHERE g > 0 AND d > 0 GROUP BY series", "v_curve"))
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.log_slope(views.curves(spark, sf_dir), "g", "d", "series").select("series", R("slope", "slope"), R("intercept", "intercept"), R("r2", "r2"), "n")


TAU = "tau0 AS (SELECT series, (d - 1) * 0.5::DOUBLE - 1 AS q, g * 3 - 1 AS tau FROM v_curve)"


def _tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising curves in place of measured mass exponents, q from -1 by halves."""
    return views.curves(spark, sf_dir).select("series", ((F.col("d") - 1) * 0.5 - 1).alias("q"), (F.col("g") * 3 - 1).alias("tau"))


SMOOTH = """ends AS (SELECT *, first_value(tau) OVER w AS a, last_value(tau) OVER (PARTITION BY series ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z,
      lag(tau, 1) OVER w AS b1, lag(tau, 2) OVER w AS b2, lead(tau, 1) OVER w AS f1, lead(tau, 2) OVER w AS f2, count(*) OVER (PARTITION BY series) AS n
    FROM tau0 WINDOW w AS (PARTITION BY series ORDER BY q)),
  smooth AS (SELECT series, q, CASE WHEN n < 5 THEN tau ELSE (-3 * coalesce(b2, a) + 12 * coalesce(b1, a) + 17 * tau + 12 * coalesce(f1, z) - 3 * coalesce(f2, z)) / 35 END AS tau FROM ends)"""
ALPHA = """alpha AS (SELECT series, q, tau, (coalesce(lead(tau) OVER w, tau) - coalesce(lag(tau) OVER w, tau)) / (coalesce(lead(q) OVER w, q) - coalesce(lag(q) OVER w, q)) AS alpha
    FROM smooth WINDOW w AS (PARTITION BY series ORDER BY q))"""
HULL = """placed AS (SELECT *, q * alpha - tau AS f, row_number() OVER (PARTITION BY series ORDER BY alpha, q) AS place FROM alpha),
  topped AS (SELECT *, first_value(place) OVER (PARTITION BY series ORDER BY f DESC, place) AS top FROM placed),
  spec AS (SELECT series, q, tau, alpha, greatest(0.0::DOUBLE, CASE WHEN place <= top THEN max(f) OVER (PARTITION BY series ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      ELSE max(f) OVER (PARTITION BY series ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END) AS f_alpha FROM topped)"""
SPEC = f"{TAU}, {SMOOTH}, {ALPHA}, {HULL}"
DIMS = "dims AS (SELECT series, q, CASE WHEN q = 1 THEN alpha ELSE tau / (q - 1) END AS dim FROM spec)"


@query("w10_smooth", views.sql(f"{TAU}, {SMOOTH} SELECT series, q, round(tau, 6) AS tau FROM smooth", "v_curve"))
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.spectrum(_tau(spark, sf_dir)).select("series", "q", R("tau", "tau"))


@query("w11_gradient", views.sql(f"{TAU}, {SMOOTH}, {ALPHA} SELECT series, q, round(alpha, 6) AS alpha FROM alpha", "v_curve"))
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.spectrum(_tau(spark, sf_dir)).select("series", "q", R("alpha", "alpha"))


@query("w12_hull", views.sql(f"{SPEC} SELECT series, q, round(alpha, 6) AS alpha, round(f_alpha, 6) AS f_alpha FROM spec", "v_curve"))
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.spectrum(_tau(spark, sf_dir)).select("series", "q", R("alpha", "alpha"), R("f_alpha", "f_alpha"))


@query("i5_dimensions", views.sql(f"{SPEC}, {DIMS} SELECT series, q, round(dim, 6) AS dim FROM dims", "v_curve"))
def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.dimensions(c.spectrum(_tau(spark, sf_dir))).select("series", "q", R("dim", "dim"))


@query("i6_dimension_gap", views.sql(f"{SPEC}, {DIMS} SELECT series, round(arg_min(dim, {{'a': abs(q), 'q': q}}) - arg_min(dim, {{'a': abs(q - 2), 'q': q}}), 6) AS delta_d FROM dims GROUP BY series", "v_curve"))
def i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.dimension_gap(c.dimensions(c.spectrum(_tau(spark, sf_dir)))).select("series", R("delta_d", "delta_d"))


@query(
    "i7_spectrum_skewness",
    views.sql(
        f"""{SPEC}, m AS (SELECT series, sum(alpha * f_alpha) / sum(f_alpha) AS mean FROM spec WHERE f_alpha > 0 GROUP BY series),
        s AS (SELECT series, count(*) AS n, sum(f_alpha) AS w, sum(f_alpha * (alpha - mean) ** 2) AS m2, sum(f_alpha * (alpha - mean) ** 3) AS m3 FROM spec JOIN m USING (series) WHERE f_alpha > 0 GROUP BY series)
        SELECT series, round(CASE WHEN n < 3 THEN NULL WHEN m2 = 0 THEN 0 ELSE m3 / w / (m2 / w) ** 1.5::DOUBLE END, 5) AS s_alpha FROM s""",
        "v_curve",
    ),
)
def i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.spectrum_skewness(c.spectrum(_tau(spark, sf_dir))).select("series", R("s_alpha", "s_alpha", 5))


@query("w17_susceptibility", views.sql("x AS (SELECT series, d, count(*) OVER (PARTITION BY series) * (1 - g) * g AS chi FROM v_curve) SELECT series, arg_max(d, {'c': chi, 'd': -d}) AS chi_d, round(max(chi), 6) AS chi_max FROM x GROUP BY series", "v_curve"))
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.susceptibility(views.curves(spark, sf_dir)).select("series", "chi_d", R("chi_max", "chi_max"))


@query("w18_interpolate", views.sql(f"{STEPS}, {CRIT} SELECT series, round(g + (r_crit - d) / (d1 - d) * (g1 - g), 6) AS g_at FROM steps JOIN crit USING (series) WHERE d <= r_crit AND r_crit < d1", "v_curve"))
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = views.curves(spark, sf_dir)
    return c.interpolate(curve, c.max_slope(curve), "r_crit", "g_at").select("series", R("g_at", "g_at"))


@query("p19_curve_json", views.sql("SELECT series, count(*) AS n, round(sum(round(g, 6)), 4) AS g_sum FROM v_curve GROUP BY series", "v_curve"))
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves to JSON text of two arrays, rounded to six places, and back."""
    packed = views.curves(spark, sf_dir).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("d", F.round("g", 6).alias("g")))).alias("p"))
    text = packed.select("series", F.to_json(F.struct(F.col("p.d").alias("d"), F.col("p.g").alias("giant_fraction"))).alias("data"))
    back = text.select("series", F.from_json("data", "d array<double>, giant_fraction array<double>").alias("j"))
    rows = back.select("series", F.explode(F.arrays_zip(F.col("j.d").alias("d"), F.col("j.giant_fraction").alias("g"))).alias("x"))
    return rows.groupBy("series").agg(F.count("*").alias("n"), R(F.sum("x.g"), "g_sum", 4))


@query("e8_curve_reductions", views.sql(f"{SPEC}, {DIMS} SELECT series, round(max(alpha) - min(alpha), 6) AS alpha_width, round(max(dim) FILTER (q = 0), 6) AS d0, round(median(dim), 6) AS dim_median FROM spec JOIN dims USING (series, q) GROUP BY series", "v_curve"))
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = c.spectrum(_tau(spark, sf_dir))
    both = spec.join(c.dimensions(spec), ["series", "q"])
    return both.groupBy("series").agg(R(F.max("alpha") - F.min("alpha"), "alpha_width"), R(F.max(F.when(F.col("q") == 0, F.col("dim"))), "d0"), R(F.median("dim"), "dim_median"))


@query("p22_grids", "SELECT i AS step, round(CASE WHEN i = 99 THEN 2000 ELSE 1 + i * (1999.0::DOUBLE / 99) END, 6) AS threshold FROM range(100) t(i)")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    from settlegrid.functions.spatial import thresholds

    grid = F.array(*(F.lit(x) for x in thresholds()))
    return spark.range(1).select(F.posexplode(grid).alias("step", "t")).select(F.col("step").cast("long"), R("t", "threshold"))
