"""Deterministic stand-ins, over the input tables, for locations, entities, pixels, curves, features and edges.

Each view exists twice, as a DataFrame and as SQL, so that an operator and its
oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from settlegrid.tables import table

FEATURES = tuple(f"f{i}" for i in range(1, 10))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loc_id, lat, lon, region, segment``: one point per customer."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    return places.select(
        key.alias("loc_id"),
        (F.lit(-60) + (key * 37 % 12000).cast("double") / 100).alias("lat"),
        (F.lit(-180) + (key * 73 % 36000).cast("double") / 100).alias("lon"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ent_id, kind, xmin, xmax, ymin, ymax``: one small box per part, near some location."""
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    n = customer.agg(F.count("*").alias("n_loc"))
    key = F.col("c_custkey")
    placed = part.crossJoin(F.broadcast(n)).withColumn("at", F.col("p_partkey") % F.col("n_loc")).join(customer.select(key), F.col("at") == key)
    x = F.lit(-180) + (key * 73 % 36000).cast("double") / 100 + (F.col("p_partkey") % 11 - 5).cast("double") / 100
    y = F.lit(-60) + (key * 37 % 12000).cast("double") / 100 + (F.col("p_partkey") % 7 - 3).cast("double") / 100
    half = F.col("p_size").cast("double") / 1000
    return placed.select(F.col("p_partkey").alias("ent_id"), F.col("p_type").alias("kind"), (x - half).alias("xmin"), (x + half).alias("xmax"), (y - half).alias("ymin"), (y + half).alias("ymax"))


def boxes(spark: SparkSession, sf_dir: str, half: float = 0.05) -> DataFrame:
    """``loc_id, min_lon, min_lat, max_lon, max_lat`` around every location."""
    places = locations(spark, sf_dir)
    return places.select("loc_id", (F.col("lon") - half).alias("min_lon"), (F.col("lat") - half).alias("min_lat"), (F.col("lon") + half).alias("max_lon"), (F.col("lat") + half).alias("max_lat"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loc, row, col``: occupied pixels of ten rasters of 128 by 128."""
    items = table(spark, sf_dir, "lineitem").where("l_quantity <= 5")
    return items.select(
        (F.col("l_suppkey") % 10).alias("loc"),
        ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 128).alias("row"),
        ((F.col("l_orderkey") * 29 + F.col("l_suppkey")) % 128).alias("col"),
    ).distinct()


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series, d, g``: one rising curve from 0 to 1 per user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("d"), F.round(F.abs("value") * 100).cast("long").alias("v"), "ts", "event_id")
    rows = rows.withColumn("so_far", F.sum("v").over(so_far)).withColumn("all", F.sum("v").over(Window.partitionBy("user_id")))
    return rows.select(F.col("user_id").alias("series"), F.col("d").cast("double").alias("d"), (F.col("so_far").cast("double") / F.greatest(F.col("all"), F.lit(1))).alias("g"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, grp, weight, f1 .. f9``: nine columns of each embedding."""
    rows = table(spark, sf_dir, "embeddings")
    columns = [F.element_at("embedding", i + 1).cast("double").alias(f) for i, f in enumerate(FEATURES)]
    return rows.select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), (F.col("vec_id") % 7 + 1).cast("double").alias("weight"), *columns)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``u, v, length``: all lines folded into a graph of 120 nodes, shortest of parallel edges."""
    items = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_orderkey") * 31 % 120, F.col("l_partkey") * 17 % 120
    length = (F.lit(1) + (F.col("l_orderkey") * 13 + F.col("l_partkey") * 7) % 997).cast("double")
    pairs = items.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), length.alias("length")).where("u < v")
    return pairs.groupBy("u", "v").agg(F.min("length").alias("length"))


def store(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """``key, status, error, metric, processed_at``: one of two overlapping result stores, several rows per key."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0" if which == "a" else "o_orderkey % 3 <> 1")
    done = F.col("o_orderstatus") != "F"
    return orders.select(
        (F.col("o_custkey") % 500).alias("key"),
        F.when(done, "done").otherwise("failed").alias("status"),
        F.when(~done, F.concat(F.lit("no data "), F.col("o_orderpriority"))).alias("error"),
        F.when(done, F.col("o_totalprice")).alias("metric"),
        F.col("o_orderkey").alias("processed_at"),
    )


#: The same views in SQL.
SQL = {
    "v_loc": """SELECT c_custkey AS loc_id, -60 + CAST(c_custkey * 37 % 12000 AS DOUBLE) / 100 AS lat,
        -180 + CAST(c_custkey * 73 % 36000 AS DOUBLE) / 100 AS lon, r_name AS region, c_mktsegment AS segment
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_entity": """SELECT p_partkey AS ent_id, p_type AS kind, x - half AS xmin, x + half AS xmax, y - half AS ymin, y + half AS ymax FROM (
        SELECT p_partkey, p_type, CAST(p_size AS DOUBLE) / 1000 AS half,
        -180 + CAST(c_custkey * 73 % 36000 AS DOUBLE) / 100 + CAST(p_partkey % 11 - 5 AS DOUBLE) / 100 AS x,
        -60 + CAST(c_custkey * 37 % 12000 AS DOUBLE) / 100 + CAST(p_partkey % 7 - 3 AS DOUBLE) / 100 AS y
        FROM part JOIN customer ON c_custkey = p_partkey % (SELECT count(*) FROM customer))""",
    "v_box": """SELECT loc_id, lon - 0.05::DOUBLE AS min_lon, lat - 0.05::DOUBLE AS min_lat, lon + 0.05::DOUBLE AS max_lon, lat + 0.05::DOUBLE AS max_lat FROM v_loc""",
    "v_pix": """SELECT DISTINCT l_suppkey % 10 AS loc, (l_partkey * 37 + l_linenumber * 11) % 128 AS row, (l_orderkey * 29 + l_suppkey) % 128 AS col
        FROM lineitem WHERE l_quantity <= 5""",
    "v_curve": """SELECT series, CAST(d AS DOUBLE) AS d, CAST(so_far AS DOUBLE) / greatest(total, 1) AS g FROM (
        SELECT user_id AS series, row_number() OVER w AS d,
        sum(CAST(round(abs(value) * 100) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far,
        sum(CAST(round(abs(value) * 100) AS BIGINT)) OVER (PARTITION BY user_id) AS total
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "v_feat": "SELECT vec_id AS id, label AS grp, CAST(vec_id % 7 + 1 AS DOUBLE) AS weight, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(FEATURES))
    + " FROM embeddings",
    "v_edge": """SELECT u, v, min(length) AS length FROM (
        SELECT least(l_orderkey * 31 % 120, l_partkey * 17 % 120) AS u, greatest(l_orderkey * 31 % 120, l_partkey * 17 % 120) AS v,
        CAST(1 + (l_orderkey * 13 + l_partkey * 7) % 997 AS DOUBLE) AS length FROM lineitem)
        WHERE u < v GROUP BY u, v""",
} | {
    f"v_store_{w}": f"""SELECT o_custkey % 500 AS key, CASE WHEN o_orderstatus <> 'F' THEN 'done' ELSE 'failed' END AS status,
        CASE WHEN o_orderstatus = 'F' THEN 'no data ' || o_orderpriority END AS error,
        CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS metric, o_orderkey AS processed_at
        FROM orders WHERE o_orderkey % 3 <> {n}"""
    for w, n in (("a", 0), ("b", 1))
}
_NEEDS = {"v_box": ("v_loc",)}


def sql(body: str, *views: str) -> str:
    """``body``, a SELECT or further ``name AS (...)`` parts and a SELECT, behind the views it names."""
    names = []
    for view in views:
        names += [n for n in (*_NEEDS.get(view, ()), view) if n not in names]
    parts = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    return f"WITH {parts}\n{body}" if body.upper().startswith("SELECT") else f"WITH {parts},\n{body}"
