"""The results store, status, strata, sampling weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from settlegrid.operators import sampling as sp
from settlegrid.plans import views
from settlegrid.plans.registry import query
from settlegrid.sources import results as store

R = lambda column, name, n=6: F.round(column, n).alias(name)
LAST = "last_{w} AS (SELECT key, status, error, metric FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY processed_at DESC) AS rn FROM v_store_{w}) WHERE rn = 1)"
BOTH = f"{LAST.format(w='a')}, {LAST.format(w='b')}"


def _last(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return store.latest(views.store(spark, sf_dir, which), ["key"], F.col("processed_at").desc()).drop("processed_at")


MERGED = "merged AS (SELECT * FROM last_b UNION ALL SELECT * FROM last_a WHERE key NOT IN (SELECT key FROM last_b))"


@query("k4_upsert", views.sql(f"{BOTH}, {MERGED} SELECT key, status, error, metric FROM merged", "v_store_a", "v_store_b"))
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(_last(spark, sf_dir, "a"), _last(spark, sf_dir, "b"), ["key"])


@query("k5_mark_failed", views.sql(f"{BOTH}, f AS (SELECT key, left(error, 500) AS error FROM last_b WHERE status = 'failed') SELECT key, 'failed' AS status, error, NULL::DOUBLE AS metric FROM f UNION ALL SELECT key, status, error, metric FROM last_a WHERE key NOT IN (SELECT key FROM f)", "v_store_a", "v_store_b"))
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = _last(spark, sf_dir, "b").where("status = 'failed'").select("key", "error")
    return store.mark_failed(_last(spark, sf_dir, "a"), failures, ["key"])


@query("k6_merge_common_columns", views.sql(f"{BOTH} SELECT key, status, NULL AS error, metric FROM last_b UNION ALL SELECT key, status, error, metric FROM last_a WHERE key NOT IN (SELECT key FROM last_b)", "v_store_a", "v_store_b"))
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other store lacks ``error`` and has a column of its own: only the shared ones are taken."""
    other = _last(spark, sf_dir, "b").drop("error").withColumn("own", F.lit(1))
    return store.merge(_last(spark, sf_dir, "a"), other, ["key"])


@query("k8_status", views.sql(f"{BOTH}, {MERGED} SELECT status, count(*) AS n FROM merged GROUP BY status", "v_store_a", "v_store_b"))
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.status_counts(store.upsert(_last(spark, sf_dir, "a"), _last(spark, sf_dir, "b"), ["key"]))


@query("k9_added_column", views.sql(f"{LAST.format(w='a')}, {LAST.format(w='b')} SELECT key, metric, NULL::BIGINT AS n_buildings FROM last_a UNION ALL SELECT key, metric, key % 7 AS n_buildings FROM last_b", "v_store_a", "v_store_b"))
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written before a column existed read as NULL in it."""
    new = _last(spark, sf_dir, "b").select("key", "metric", (F.col("key") % 7).alias("n_buildings"))
    return _last(spark, sf_dir, "a").select("key", "metric").unionByName(new, allowMissingColumns=True)


@query("k12_remaining_work", views.sql(f"{BOTH}, {MERGED} SELECT c_custkey AS key FROM customer WHERE c_custkey % 500 NOT IN (SELECT key FROM merged WHERE status = 'done')", "v_store_a", "v_store_b"))
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = store.done_keys(store.upsert(_last(spark, sf_dir, "a"), _last(spark, sf_dir, "b"), ["key"]), ["key"])
    wanted = views.table(spark, sf_dir, "customer").select(F.col("c_custkey"), (F.col("c_custkey") % 500).alias("key"))
    return wanted.join(done, "key", "left_anti").select(F.col("c_custkey").alias("key"))


@query("w2_prefer_done", views.sql("u AS (SELECT * FROM v_store_a UNION ALL SELECT * FROM v_store_b) SELECT key, status, metric FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE status WHEN 'done' THEN 0 ELSE 1 END, processed_at DESC) AS rn FROM u) WHERE rn = 1", "v_store_a", "v_store_b"))
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.store(spark, sf_dir, "a").unionByName(views.store(spark, sf_dir, "b"))
    return store.latest(rows, ["key"], (F.col("status") != "done").cast("int"), F.col("processed_at").desc()).select("key", "status", "metric")


@query("a7_cache_membership", views.sql(f"{LAST.format(w='a')} SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT key FROM last_a)", "v_store_a"))
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _last(spark, sf_dir, "a").select(F.col("key").alias("c_custkey"))
    return views.table(spark, sf_dir, "customer").select("c_custkey").join(held, "c_custkey", "left_semi")


@query("a6_keyed_read", views.sql("SELECT status, error, metric FROM v_store_a WHERE key = 42", "v_store_a"))
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.store(spark, sf_dir, "a").where("key = 42").select("status", "error", "metric")


@query("a14_curve_lookup", views.sql("SELECT d, round(g, 6) AS g FROM v_curve WHERE abs(series - 7) < 1e-6", "v_curve"))
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.curves(spark, sf_dir).where(F.abs(F.col("series") - 7) < 1e-6).select("d", R("g", "g"))


@query("d11_lookup_with_misses", views.sql(f"{LAST.format(w='a')} SELECT count(*) FILTER (key IS NOT NULL) AS found, count(*) FILTER (key IS NULL) AS missing FROM customer LEFT JOIN last_a ON key = c_custkey", "v_store_a"))
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = views.table(spark, sf_dir, "customer").join(_last(spark, sf_dir, "a"), F.col("key") == F.col("c_custkey"), "left")
    return met.agg(F.count_if(F.col("key").isNotNull()).alias("found"), F.count_if(F.col("key").isNull()).alias("missing"))


@query("s6_drop_duplicates", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(views.table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("s4_sorted_distinct", "SELECT DISTINCT p_brand FROM part")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_brand").distinct().orderBy("p_brand")


@query("s5_union_all", views.sql("SELECT key, status FROM v_store_a UNION ALL SELECT key, status FROM v_store_b", "v_store_a", "v_store_b"))
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.store(spark, sf_dir, "a").unionByName(views.store(spark, sf_dir, "b")).select("key", "status")


@query("s7_except", views.sql("SELECT DISTINCT key FROM v_store_a EXCEPT SELECT key FROM v_store_b WHERE status = 'failed'", "v_store_a", "v_store_b"))
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.store(spark, sf_dir, "a").select("key").distinct().join(views.store(spark, sf_dir, "b").where("status = 'failed'"), "key", "left_anti")


@query("e1_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("e2_distinct_counts", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_cust, count(DISTINCT o_orderpriority) AS n_priority FROM orders")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_cust"), F.countDistinct("o_orderpriority").alias("n_priority"))


STRATUM = "st AS (SELECT c_mktsegment AS seg, o_orderpriority AS pri, o_orderstatus AS s, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey)"


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = views.table(spark, sf_dir, "orders").join(views.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))


@query("e3_stratum_counts", f"WITH {STRATUM} SELECT seg, pri, count(*) AS n_attempted, count(*) FILTER (s <> 'F') AS n_done, count(*) FILTER (s = 'F') AS n_failed, round(count(*) FILTER (s = 'F') / count(*)::DOUBLE, 6) AS empty_rate FROM st GROUP BY seg, pri")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.stratum_counts(_strata(spark, sf_dir).withColumn("done", F.col("s") != "F"), ["seg", "pri"]).withColumn("empty_rate", F.round("empty_rate", 6))


@query("e4_stratum_rates", f"WITH {STRATUM} SELECT seg, round(avg(CASE WHEN s = 'F' THEN 1.0::DOUBLE ELSE 0 END), 6) AS empty, round(avg(CASE WHEN p > 50000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS has_bldg, round(avg(CASE WHEN s = 'F' AND p > 50000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS unmapped, round(avg(CASE WHEN s = 'F' AND p <= 50000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS true_empty FROM st GROUP BY seg")
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty, built = F.col("s") == "F", F.col("p") > 50000
    rate = lambda c, n: R(F.avg(c.cast("double")), n)
    return _strata(spark, sf_dir).groupBy("seg").agg(rate(empty, "empty"), rate(built, "has_bldg"), rate(empty & built, "unmapped"), rate(empty & ~built, "true_empty"))


@query("e5_crosstab", f"WITH {STRATUM} SELECT seg, count(*) FILTER (s = 'F') AS \"F\", count(*) FILTER (s = 'O') AS \"O\", count(*) FILTER (s = 'P') AS \"P\" FROM st GROUP BY seg")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("seg").pivot("s", ["F", "O", "P"]).count().fillna(0)


@query("e6_first_per_group", f"WITH {STRATUM} SELECT seg, length(seg) AS k FROM st GROUP BY seg")
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("seg").agg(F.first(F.length("seg")).alias("k"))


@query("e7_value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 5")
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_type").limit(5)


@query("e27_class_distribution", "SELECT event_type AS class, count(*) AS n FROM events GROUP BY 1")
def e27(spark: SparkSession, sf_dir: str) -> DataFrame:
    from settlegrid.sources.scans import class_counts

    return class_counts(views.table(spark, sf_dir, "events").select(F.col("event_type").alias("class")))


SAMPLE_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY region, segment ORDER BY loc_id * 7919 % 104729, loc_id) AS rn, count(*) OVER (PARTITION BY region, segment) AS pool FROM v_loc)"""


@query("l1_stratified_sample", views.sql(f"{SAMPLE_SQL} SELECT loc_id FROM ranked WHERE rn <= 20", "v_loc"))
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.stratified_sample(views.locations(spark, sf_dir), ["region", "segment"], 20, F.col("loc_id") * 7919 % 104729, "loc_id").select("loc_id")


@query("l2_design_weights", views.sql(f"{SAMPLE_SQL} SELECT region, segment, count(*) AS n_candidates, count(*) * 10.0::DOUBLE AS est_total, count(*) FILTER (rn <= 60) AS n_sampled, round(count(*) * 10.0::DOUBLE / count(*) FILTER (rn <= 60), 6) AS weight, count(*) < 60 AS pool_exhausted FROM ranked GROUP BY region, segment", "v_loc"))
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sp.design_weights(views.locations(spark, sf_dir), ["region", "segment"], 60, 0.1)
    return found.withColumn("weight", F.round("weight", 6))


@query("l3_realised_weights", f"WITH {STRATUM}, c AS (SELECT seg, count(*) AS n_attempted, count(*) FILTER (s = 'F') AS n_failed FROM st GROUP BY seg) SELECT seg, round(5000.0::DOUBLE / n_attempted, 6) AS design_weight, CAST(round(5000.0::DOUBLE * (1 - n_failed / n_attempted::DOUBLE)) AS BIGINT) AS est_nonempty FROM c")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sp.stratum_counts(_strata(spark, sf_dir).withColumn("done", F.col("s") != "F"), ["seg"]).withColumn("est_total", F.lit(5000.0))
    return sp.realised_weights(counts).select("seg", R("design_weight", "design_weight"), "est_nonempty")


@query("d8_stratum_join", views.sql("w AS (SELECT region, segment, count(*) AS n FROM v_loc GROUP BY region, segment) SELECT loc_id, n FROM v_loc JOIN w USING (region, segment)", "v_loc"))
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = views.locations(spark, sf_dir)
    return at.join(at.groupBy("region", "segment").agg(F.count("*").alias("n")), ["region", "segment"]).select("loc_id", "n")


@query("d12_name_join", "SELECT a.o_orderkey, b.l_rows FROM orders a JOIN (SELECT l_orderkey, count(*) AS l_rows FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("l_rows"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey").join(rows, "o_orderkey")


@query("g12_decimate", "SELECT loc, row, col FROM (SELECT DISTINCT l_suppkey % 10 AS loc, (l_partkey * 37 + l_linenumber * 11) % 128 AS row, (l_orderkey * 29 + l_suppkey) % 128 AS col FROM lineitem WHERE l_quantity <= 5) WHERE row % 2 = 0 AND col % 2 = 0")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pixels(spark, sf_dir).where("row % 2 = 0 and col % 2 = 0")


@query("g13_raster_lookup", views.sql("p AS (SELECT loc_id, CAST(floor((lat + 60) / 120 * 128) AS BIGINT) AS row, CAST(floor((lon + 180) / 360 * 128) AS BIGINT) AS col FROM v_loc), r AS (SELECT row, col, sum(loc) AS value FROM v_pix GROUP BY row, col) SELECT loc_id, coalesce(value, -200) AS value FROM p LEFT JOIN r USING (row, col)", "v_loc", "v_pix"))
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = views.pixels(spark, sf_dir).groupBy("row", "col").agg(F.sum("loc").alias("value"))
    at = views.locations(spark, sf_dir).select("loc_id", F.floor((F.col("lat") + 60) / 120 * 128).alias("row"), F.floor((F.col("lon") + 180) / 360 * 128).alias("col"))
    return at.join(raster, ["row", "col"], "left").select("loc_id", F.coalesce("value", F.lit(-200)).alias("value"))


@query("g14_neighbourhood_mean", views.sql("r AS (SELECT row, col, count(*) AS value FROM v_pix GROUP BY row, col) SELECT a.row, a.col, round(avg(b.value), 6) AS mean FROM r a JOIN r b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col", "v_pix"))
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the 3 x 3 neighbours that have data: each pixel is dealt to its nine cells, then averaged there."""
    raster = views.pixels(spark, sf_dir).groupBy("row", "col").agg(F.count("*").alias("value"))
    around = F.explode(F.array(*(F.struct((F.col("row") + a).alias("r"), (F.col("col") + b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    means = raster.select("value", around.alias("o")).groupBy(F.col("o.r").alias("row"), F.col("o.c").alias("col")).agg(R(F.avg("value"), "mean"))
    return means.join(raster.select("row", "col"), ["row", "col"], "left_semi")


@query("g15_colour_ratio", views.sql("SELECT loc, count(*) FILTER (row % 3 = 0) AS virtual, round(count(*) FILTER (row % 3 = 0) / greatest(count(*) FILTER (row % 3 = 1), 1)::DOUBLE, 6) AS ratio FROM v_pix GROUP BY loc", "v_pix"))
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    virtual, road = F.count_if(F.col("row") % 3 == 0), F.count_if(F.col("row") % 3 == 1)
    return views.pixels(spark, sf_dir).groupBy("loc").agg(virtual.alias("virtual"), R(virtual / F.greatest(road, F.lit(1)), "ratio"))


@query("i9_densities", views.sql("SELECT floor(ymin / 10) AS band, count(*) AS n, round(count(*) / 4.0::DOUBLE, 6) AS per_km2, round(avg((xmax - xmin) * (ymax - ymin)), 9) AS mean_area FROM v_entity GROUP BY 1", "v_entity"))
def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per square kilometre of a window of two by two, and mean footprint."""
    ents = views.entities(spark, sf_dir)
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return ents.groupBy(F.floor(F.col("ymin") / 10).cast("double").alias("band")).agg(F.count("*").alias("n"), R(F.count("*") / F.lit(4.0), "per_km2"), R(F.avg(area), "mean_area", 9))


@query("s2_top_per_group", views.sql("SELECT grp, id FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY abs(f1) + abs(f2), id) AS rn FROM v_feat) WHERE rn <= 5", "v_feat"))
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("grp").orderBy(F.abs("f1") + F.abs("f2"), "id")
    return views.features(spark, sf_dir).withColumn("rn", F.row_number().over(order)).where("rn <= 5").select("grp", "id")


@query("s1_full_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 50")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = views.table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("place"))
