"""Statistics over feature vectors, each within its group where pairs or ranks are made."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from settlegrid.functions import spatial as s
from settlegrid.operators import joins as j
from settlegrid.operators import stats as st
from settlegrid.plans import views
from settlegrid.plans.registry import query

FS = list(views.FEATURES)
R = lambda column, name, n=6: F.round(column, n).alias(name)
Z_SQL = (
    "mu AS (SELECT grp, " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FS) + " FROM v_feat GROUP BY grp),"
    "z AS (SELECT id, v_feat.grp AS grp, weight, " + ", ".join(f"({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END AS {f}" for f in FS) + " FROM v_feat JOIN mu USING (grp))"
)
WZ_SQL = (
    "wm AS (SELECT grp, sum(weight) AS w, " + ", ".join(f"sum(weight * {f}) / sum(weight) AS m_{f}" for f in FS) + " FROM v_feat GROUP BY grp),"
    "ws AS (SELECT grp, " + ", ".join(f"sqrt(sum(weight * ({f} - m_{f}) ** 2) / sum(weight)) AS s_{f}" for f in FS) + " FROM v_feat JOIN wm USING (grp) GROUP BY grp),"
    "z AS (SELECT id, v_feat.grp AS grp, weight, " + ", ".join(f"({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END AS {f}" for f in FS) + " FROM v_feat JOIN wm USING (grp) JOIN ws USING (grp))"
)
PAIRS = "pairs AS (SELECT a.grp AS grp, {w} AS w, " + ", ".join(f"(a.{f} - b.{f}) ** 2 AS {f}" for f in FS) + " FROM z a JOIN z b ON a.grp = b.grp AND a.id < b.id), sums AS (SELECT *, " + " + ".join(FS) + " AS total FROM pairs)"
LOFO = "SELECT grp, " + ", ".join(f"round(100 * (sum(w * sqrt(total)) - sum(w * sqrt(greatest(total - {f}, 0)))) / sum(w * sqrt(total)), 5) AS {f}" for f in FS) + " FROM sums GROUP BY grp"


@query("e13_zscore", views.sql(f"{Z_SQL} SELECT id, " + ", ".join(f"round({f}, 6) AS {f}" for f in FS) + " FROM z", "v_feat"))
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.zscores(views.features(spark, sf_dir), FS, by=["grp"]).select("id", *(R(f, f) for f in FS))


@query("e14_weighted_zscore", views.sql(f"{WZ_SQL} SELECT id, " + ", ".join(f"round({f}, 6) AS {f}" for f in FS) + " FROM z", "v_feat"))
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.zscores(views.features(spark, sf_dir), FS, by=["grp"], weight="weight").select("id", *(R(f, f) for f in FS))


@query("e16_contributions", views.sql(f"{Z_SQL}, {PAIRS.format(w='1.0::DOUBLE')} {LOFO}", "v_feat"))
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = st.zscores(views.features(spark, sf_dir), FS, by=["grp"])
    return st.contributions(scored, FS, "id", by=["grp"]).select("grp", *(R(f, f, 5) for f in FS))


@query("d14_weighted_pairs", views.sql(f"{WZ_SQL}, {PAIRS.format(w='a.weight * b.weight')} {LOFO}", "v_feat"))
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = st.zscores(views.features(spark, sf_dir), FS, by=["grp"], weight="weight")
    return st.contributions(scored, FS, "id", by=["grp"], weight="weight").select("grp", *(R(f, f, 5) for f in FS))


@query("e17_uniform_baseline", "SELECT k, round(100 * (1 - sqrt((k - 1) / k::DOUBLE)), 9) AS baseline FROM range(2, 13) t(k)")
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*(F.lit(st.uniform_baseline(k)) for k in range(2, 13)))
    return spark.range(1).select(F.posexplode(values).alias("i", "b")).select((F.col("i") + 2).cast("long").alias("k"), R("b", "baseline", 9))


WINDOWS_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f1, id) - 1 AS rn, count(*) OVER (PARTITION BY grp) AS n FROM v_feat),
  win AS (SELECT r.*, s.start FROM r JOIN (SELECT generate_series * 5 AS start FROM generate_series(0, 20000)) s ON s.start <= r.rn AND r.rn < s.start + 20 AND s.start + 20 <= r.n)"""


@query("w3_moving_windows", views.sql(f"{WINDOWS_SQL} SELECT grp, start, count(*) AS n, round(median(f1), 6) AS d_median, round(min(f1), 6) AS d_lo, round(max(f1), 6) AS d_hi, round(avg(f2), 6) AS f2 FROM win GROUP BY grp, start", "v_feat"))
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.moving_windows(views.features(spark, sf_dir), "f1", "id", 20, 5, group="grp")
    return rows.groupBy("grp", "start").agg(F.count("*").alias("n"), R(F.median("f1"), "d_median"), R(F.min("f1"), "d_lo"), R(F.max("f1"), "d_hi"), R(F.avg("f2"), "f2"))


@query(
    "w15_crossings",
    views.sql(
        f"""{WINDOWS_SQL}, m AS (SELECT grp, median(f1) AS x, avg(f2) - avg(f3) AS a, avg(f2) AS b FROM win GROUP BY grp, start),
        l AS (SELECT *, lag(x) OVER w AS x0, lag(a) OVER w AS a0, lag(b) OVER w AS b0 FROM m WINDOW w AS (PARTITION BY grp ORDER BY x)),
        c AS (SELECT grp, x, CASE WHEN a0 < 0 AND a >= 0 THEN x0 + (0 - a0) / (a - a0) * (x - x0) END AS up, CASE WHEN b < 0 AND b0 >= 0 THEN x + (0 - b) / (b0 - b) * (x0 - x) END AS down FROM l)
        SELECT grp, round(arg_min(up, x) FILTER (up IS NOT NULL), 6) AS d_star_sparse, round(arg_max(down, x) FILTER (down IS NOT NULL), 6) AS d_star_dense FROM c GROUP BY grp""",
        "v_feat",
    ),
)
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.moving_windows(views.features(spark, sf_dir), "f1", "id", 20, 5, group="grp")
    curve = rows.groupBy("grp", "start").agg(F.median("f1").alias("x"), F.avg("f2").alias("density"), F.avg("f3").alias("dynamic"))
    return st.crossings(curve, "x", "density", "dynamic", 0.0, group="grp").select("grp", R("d_star_sparse", "d_star_sparse"), R("d_star_dense", "d_star_dense"))


@query("w13_average_rank", "SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2.0::DOUBLE AS place FROM lineitem")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", st.average_rank("l_quantity", "l_linenumber").alias("place"))


@query("w14_relabel_by_size", views.sql("c AS (SELECT grp, sum(weight) AS w FROM v_feat GROUP BY grp) SELECT grp, row_number() OVER (ORDER BY w DESC, grp) - 1 AS label FROM c", "v_feat"))
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = views.features(spark, sf_dir).groupBy("grp").agg(F.sum("weight").alias("w"))
    return sizes.select("grp", (F.row_number().over(Window.orderBy(F.col("w").desc(), "grp")) - 1).cast("long").alias("label"))


@query("e9_quantiles", views.sql("SELECT grp, round(quantile_cont(f1, 0.75), 6) AS q75, round(quantile_cont(f1, 0.005), 6) AS low, round(quantile_cont(f1, 0.995), 6) AS high FROM v_feat GROUP BY grp", "v_feat"))
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.features(spark, sf_dir).groupBy("grp").agg(*(R(F.percentile("f1", q), n) for q, n in ((0.75, "q75"), (0.005, "low"), (0.995, "high"))))


@query("e10_extreme_rows", views.sql("SELECT grp, arg_max(id, {'f': f1, 'i': id}) AS at_max, arg_min(id, {'f': f1, 'i': id}) AS at_min FROM v_feat GROUP BY grp", "v_feat"))
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.features(spark, sf_dir).groupBy("grp").agg(F.max_by("id", F.struct("f1", "id")).alias("at_max"), F.min_by("id", F.struct("f1", "id")).alias("at_min"))


@query("e11_correlations", views.sql("x AS (SELECT *, rank() OVER (ORDER BY f1) + (count(*) OVER (PARTITION BY f1) - 1) / 2.0::DOUBLE AS r1, rank() OVER (ORDER BY f2) + (count(*) OVER (PARTITION BY f2) - 1) / 2.0::DOUBLE AS r2 FROM v_feat) SELECT round(corr(ln(1 + abs(f1)), ln(1 + abs(f2))), 6) AS pearson_log, round(corr(r1, r2), 6) AS spearman FROM x", "v_feat"))
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.features(spark, sf_dir).withColumn("r1", st.average_rank("f1")).withColumn("r2", st.average_rank("f2"))
    return rows.agg(R(F.corr(F.log1p(F.abs("f1")), F.log1p(F.abs("f2"))), "pearson_log"), R(F.corr("r1", "r2"), "spearman"))


@query("e18_histogram", "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def e18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("bin")).agg(F.count("*").alias("n"))


@query("e19_cluster_profiles", views.sql(f"{Z_SQL} SELECT grp, round(sum(weight) / (SELECT sum(weight) FROM z), 6) AS share, round(median(f1), 6) AS median_f1, round(avg(f2), 6) AS mean_z2, count(*) FILTER (id % 3 = 0) AS n_class0 FROM z GROUP BY grp", "v_feat"))
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.zscores(views.features(spark, sf_dir), FS, by=["grp"])
    made = rows.groupBy("grp").agg(F.sum("weight").alias("w"), R(F.median("f1"), "median_f1"), R(F.avg("f2"), "mean_z2"), F.count_if(F.col("id") % 3 == 0).alias("n_class0"))
    return made.crossJoin(made.agg(F.sum("w").alias("all"))).select("grp", R(F.col("w") / F.col("all"), "share"), "median_f1", "mean_z2", "n_class0")


@query("e20_covariances", views.sql("SELECT grp, " + ", ".join(f"round(covar_samp(f1, {f}), 8) AS c_{f}" for f in FS) + " FROM v_feat GROUP BY grp", "v_feat"))
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.features(spark, sf_dir).groupBy("grp").agg(*(R(F.covar_samp("f1", f), f"c_{f}", 8) for f in FS))


@query("l11_outliers")
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mahalanobis distance of every row and the three features that drive it."""
    rows = st.mahalanobis(st.zscores(views.features(spark, sf_dir), FS), FS)
    return rows.select("id", R("maha", "maha", 4), s.top_drivers(tuple(FS)).alias("drivers"))


@query("p21_top_drivers", views.sql(f"{Z_SQL}, l AS (SELECT id, unnest([{', '.join(repr(f) for f in FS)}]) AS name, unnest([{', '.join(FS)}]) AS v, unnest(range(9)) AS i FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, i) AS rn FROM l) SELECT id, string_agg(name, ' ' ORDER BY rn) AS drivers FROM r WHERE rn <= 3 GROUP BY id", "v_feat"))
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.zscores(views.features(spark, sf_dir), FS, by=["grp"])
    return rows.select("id", F.regexp_replace(s.top_drivers(tuple(FS)), r"=[^ ]+", "").alias("drivers"))


@query("s3_spread_outliers")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight far-out rows at least 400 km from each other, out of the 120 furthest out."""
    rows = st.mahalanobis(st.zscores(views.features(spark, sf_dir), FS), FS)
    at = views.locations(spark, sf_dir).select(F.col("loc_id").alias("id"), "lat", "lon")
    picked = st.spread_pick(rows.join(at, "id").select("id", "lat", "lon", "maha"), "maha", "lat", "lon", 8, 400.0)
    return spark.createDataFrame([(r["id"], round(r["maha"], 4)) for r in picked], "id long, maha double")


@query("e21_spearman_geometry")
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of all features, leaf order by average linkage, and how many axes they take."""
    ranked = views.features(spark, sf_dir).withColumns({f: st.average_rank(f) for f in FS})
    pairs = [(a, b) for i, a in enumerate(FS) for b in FS[i:]]
    found = ranked.agg(*(F.corr(a, b) for a, b in pairs)).first()
    matrix = np.eye(len(FS))
    for (a, b), v in zip(pairs, found):
        matrix[FS.index(a), FS.index(b)] = matrix[FS.index(b), FS.index(a)] = v if v is not None else 0.0
    values = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    order = st.average_linkage_order(1 - np.abs(matrix))
    to90 = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.9) + 1)
    rows = [(f, order.index(i), round(float(values[i]), 6), round(st.participation(values), 6), to90) for i, f in enumerate(FS)]
    return spark.createDataFrame(rows, "feature string, leaf int, eigenvalue double, participation double, axes_to_90 int")


@query("e22_island_separation", views.sql("r AS (SELECT grp, rank() OVER (ORDER BY f1) + (count(*) OVER (PARTITION BY f1) - 1) / 2.0::DOUBLE AS r1, count(*) OVER () AS n FROM v_feat) SELECT round((avg(r1) FILTER (grp = 2) - avg(r1) FILTER (grp = 1)) / max(n), 6) AS separation FROM r", "v_feat"))
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.features(spark, sf_dir).withColumn("r1", st.average_rank("f1"))
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("r1")))
    return rows.agg(R((mean(2) - mean(1)) / F.count("*"), "separation"))


@query("e23_sample_skewness", views.sql("SELECT grp, round(skewness(f1), 6) AS skew FROM v_feat GROUP BY grp HAVING count(*) > 2", "v_feat"))
def e23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.features(spark, sf_dir).groupBy("grp").agg(R(st.sample_skewness("f1"), "skew"), F.count("*").alias("n")).where("n > 2").drop("n")


_BINS = """x AS (SELECT 'plain' AS scale, f1 AS v FROM v_feat UNION ALL SELECT 'skewed', exp(f2 * 4.0::DOUBLE / (SELECT stddev_samp(f2) FROM v_feat)) FROM v_feat),
s AS (SELECT scale, abs(skewness(v)) > 2 AS long_tail, greatest(1e-6::DOUBLE, 1e-6::DOUBLE - min(v)) AS shift FROM x GROUP BY scale),
t AS (SELECT scale, CASE WHEN long_tail THEN log10(v + shift) ELSE v END AS v FROM x JOIN s USING (scale)),
q AS (SELECT scale, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM t GROUP BY scale)
SELECT scale, CAST(least(35, greatest(0, floor((v - lo) / (hi - lo) * 36))) AS BIGINT) AS bin, count(*) AS n FROM t JOIN q USING (scale) GROUP BY 1, 2"""


@query("p17_adaptive_bins", views.sql(_BINS, "v_feat"))
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """36 bins of a feature whose scale stays linear and of one whose long tail makes it logarithmic."""
    rows = views.features(spark, sf_dir).select("f1", "f2")
    spread = rows.agg(F.stddev_samp("f2")).first()[0]
    plain, skewed = rows.select(F.col("f1").alias("v")), rows.select(F.exp(F.col("f2") * 4.0 / F.lit(spread)).alias("v"))
    both = [st.adaptive_bins(x, "v").groupBy("bin").agg(F.count("*").alias("n")).select(F.lit(name).alias("scale"), "bin", "n") for name, x in (("plain", plain), ("skewed", skewed))]
    return both[0].union(both[1])


@query("p18_composite_group", views.sql("SELECT id, CASE WHEN grp = 0 THEN id % 6 ELSE 5 + CASE WHEN grp = 1 THEN 1 ELSE 2 END END AS shown FROM v_feat", "v_feat"))
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("grp") == 0, F.col("id") % 6).when(F.col("grp") == 1, F.lit(6)).otherwise(F.lit(7))
    return views.features(spark, sf_dir).select("id", shown.cast("long").alias("shown"))


FAR_SQL = """z1 AS (SELECT *, f1 + 2 AS density FROM v_feat), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY density, id) AS rn FROM z1),
  p AS (SELECT a.grp AS grp, a.id AS i, b.id AS j, sqrt((a.f2 - b.f2) ** 2 + (a.f3 - b.f3) ** 2 + (a.f4 - b.f4) ** 2) AS dist, (a.f2 - b.f2) ** 2 / nullif((a.f2 - b.f2) ** 2 + (a.f3 - b.f3) ** 2 + (a.f4 - b.f4) ** 2, 0) AS share
    FROM r a JOIN r b ON a.grp = b.grp AND b.rn BETWEEN a.rn + 1 AND a.rn + 59 WHERE abs(a.density - b.density) / ((a.density + b.density) / 2) <= 0.02),
  q AS (SELECT *, quantile_cont(dist, 0.75) OVER (PARTITION BY grp) AS q75 FROM p)"""


@query("l10_isodensity_pairs", views.sql(f"{FAR_SQL} SELECT grp, arg_max({{'i': i, 'j': j}}, {{'s': share, 'i': i, 'j': j}}) FILTER (dist >= q75).i AS far_i, arg_min(j, {{'d': dist, 'i': i, 'j': j}}) AS near_j FROM q GROUP BY grp".replace("arg_max({'i': i, 'j': j}, {'s': share, 'i': i, 'j': j}) FILTER (dist >= q75).i", "arg_max(i, {'s': share, 'i': i, 'j': j}) FILTER (dist >= q75)"), "v_feat"))
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group, of pairs alike in density, the far one led by one feature and the nearest."""
    rows = views.features(spark, sf_dir).withColumn("density", F.col("f1") + 2)
    pairs = j.band_pairs(rows, "density", 59, 0.02, group="grp")
    parts = [(F.col(f"{f}_i") - F.col(f"{f}_j")) ** 2 for f in ("f2", "f3", "f4")]
    pairs = pairs.select(F.col("grp_i").alias("grp"), F.col("id_i").alias("i"), F.col("id_j").alias("j"), F.sqrt(st.total(parts)).alias("dist"), F.when(st.total(parts) > 0, parts[0] / st.total(parts)).alias("share"))
    cut = pairs.groupBy("grp").agg(F.percentile("dist", 0.75).alias("q75"))
    far = F.max_by("i", F.when(F.col("dist") >= F.col("q75"), F.struct("share", "i", "j")))
    return pairs.join(cut, "grp").groupBy("grp").agg(far.alias("far_i"), F.min_by("j", F.struct("dist", "i", "j")).alias("near_j"))


@query("l9_vector_assembly", views.sql("x AS (SELECT id, CASE WHEN f1 > -0.15 THEN f1 END AS f1, f2 FROM v_feat) SELECT count(*) AS n_vectors, count(*) FILTER (f1 IS NULL) AS n_missing, round(sum(f1), 6) AS sum_f1 FROM x", "v_feat"))
def l9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.features(spark, sf_dir).select("id", F.when(F.col("f1") > -0.15, F.col("f1")).alias("f1"), "f2")
    return rows.agg(F.count("*").alias("n_vectors"), F.count_if(F.col("f1").isNull()).alias("n_missing"), R(F.sum("f1"), "sum_f1"))


@query("l5_sampled_pairs", views.sql(f"k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id * 7919 % 104729, id) AS rn FROM v_feat) WHERE rn <= 20) SELECT a.grp AS grp, round(avg(sqrt((a.f1 - b.f1) ** 2 + (a.f2 - b.f2) ** 2)), 6) AS mean_dist FROM k a JOIN k b ON a.grp = b.grp AND a.id < b.id GROUP BY a.grp", "v_feat"))
def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from settlegrid.operators.sampling import stratified_sample

    some = stratified_sample(views.features(spark, sf_dir), ["grp"], 20, F.col("id") * 7919 % 104729, "id")
    a, b = (some.select("grp", F.col("id").alias(f"{x}id"), F.col("f1").alias(f"{x}1"), F.col("f2").alias(f"{x}2")) for x in "ab")
    return a.join(b, "grp").where("aid < bid").groupBy("grp").agg(R(F.avg(F.sqrt((F.col("a1") - F.col("b1")) ** 2 + (F.col("a2") - F.col("b2")) ** 2)), "mean_dist"))


@query("l4_bootstrap")
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % percentile interval of each group's mean over 100 resamples."""
    rows = st.bootstrap_rows(views.features(spark, sf_dir).select("id", "grp", "f1"), "id", 100, group="grp")
    means = rows.groupBy("grp", "replicate").agg(F.avg("f1").alias("m"))
    return means.groupBy("grp").agg(R(F.percentile("m", 0.025), "low"), R(F.percentile("m", 0.975), "high"), F.count("*").alias("replicates"))


@query("l6_clusters")
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = st.clusters(st.zscores(views.features(spark, sf_dir), FS), FS, 6, weight="weight")
    return made.groupBy("cluster").agg(F.count("*").alias("n"), R(F.sum("weight"), "weight"))


@query("l7_principal_axes")
def l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes, _ = st.principal_axes(st.zscores(views.features(spark, sf_dir), FS), FS)
    return axes.select("id", R("pc1", "pc1", 4), R("pc2", "pc2", 4))
