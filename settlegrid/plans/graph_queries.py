"""Graphs: snapping, shortest duplicates, statistics, percolation, path diversity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlegrid.operators import curves, network
from settlegrid.plans import views
from settlegrid.plans.registry import query

R = lambda column, name, n=6: F.round(column, n).alias(name)
THRESHOLDS = (50.0, 100.0, 200.0, 300.0, 400.0, 500.0, 700.0, 1000.0)


@query("n1_snap_nodes", views.sql("p AS (SELECT ent_id, round_even((xmin + xmax) / 2 * 10, 0) AS kx, round_even((ymin + ymax) / 2 * 10, 0) AS ky FROM v_entity), f AS (SELECT kx, ky, min(ent_id) AS first_seen FROM p GROUP BY kx, ky), n AS (SELECT *, row_number() OVER (ORDER BY first_seen) - 1 AS node FROM f) SELECT ent_id, node FROM p JOIN n USING (kx, ky)", "v_entity"))
def n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on a grid, halves to the even side; nodes are numbered by first sight."""
    from pyspark.sql import Window

    ents = views.entities(spark, sf_dir)
    snapped = ents.select("ent_id", F.rint((F.col("xmin") + F.col("xmax")) / 2 * 10).alias("kx"), F.rint((F.col("ymin") + F.col("ymax")) / 2 * 10).alias("ky"))
    first = snapped.groupBy("kx", "ky").agg(F.min("ent_id").alias("first_seen"))
    numbered = first.withColumn("node", (F.row_number().over(Window.orderBy("first_seen")) - 1).cast("long"))
    return snapped.join(numbered, ["kx", "ky"]).select("ent_id", "node")


@query("n2_shortest_parallel_edges", views.sql("SELECT u, v, length FROM v_edge", "v_edge"))
def n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.edges(spark, sf_dir)


REACH = "both_ways AS (SELECT u AS a, v AS b, length FROM v_edge UNION ALL SELECT v, u, length FROM v_edge)"


@query("e25_graph_statistics", views.sql("deg AS (SELECT n, count(*) AS k FROM (SELECT u AS n FROM v_edge UNION ALL SELECT v FROM v_edge) GROUP BY n) SELECT (SELECT count(*) FROM v_edge) AS n_edges, (SELECT count(*) FROM deg) AS n_nodes, round((SELECT avg(k) FROM deg), 6) AS mean_degree, (SELECT sum(length) FROM v_edge) AS total_length, (SELECT max(length) FROM v_edge) AS max_length", "v_edge"))
def e25(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.edges(spark, sf_dir)
    degrees = edges.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    lengths = edges.agg(F.count("*").alias("n_edges"), F.sum("length").alias("total_length"), F.max("length").alias("max_length"))
    return lengths.crossJoin(degrees.agg(F.count("*").alias("n_nodes"), R(F.avg("k"), "mean_degree")))


def percolate(edges: DataFrame, nodes: int, mode: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Percolation of each window's graph, one task per window: ``loc, d, max_cluster_size, n_clusters, giant_fraction``."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        links = list(part[["u", "v", "length"]].sort_values(["u", "v"]).itertuples(index=False, name=None))
        rows = network.percolation(links, nodes, range(0, nodes, 1 if mode == "edge" else 3), thresholds, mode)
        return pd.DataFrame(rows, columns=["d", "max_cluster_size", "n_clusters", "giant_fraction"]).assign(loc=part["loc"].iloc[0])[["loc", "d", "max_cluster_size", "n_clusters", "giant_fraction"]]

    return edges.groupBy("loc").applyInPandas(run, "loc long, d double, max_cluster_size long, n_clusters long, giant_fraction double")


COMPONENTS = f"""nodes AS (SELECT unnest(range(120)) AS a), t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in THRESHOLDS)}]) AS d), {REACH},
  reach AS (SELECT d, a AS src, a AS dst FROM t, nodes UNION SELECT r.d, r.src, e.b FROM reach r JOIN both_ways e ON e.a = r.dst AND e.length <= r.d),
  lab AS (SELECT d, src, min(dst) AS root FROM reach GROUP BY d, src), sizes AS (SELECT d, root, count(*) AS n FROM lab GROUP BY d, root)
  SELECT d, max(n) AS max_cluster_size, count(*) AS n_clusters, round(max(n) / 120.0::DOUBLE, 6) AS giant_fraction FROM sizes GROUP BY d"""


@query("n10_edge_percolation", views.sql(COMPONENTS, "v_edge").replace("WITH ", "WITH RECURSIVE ", 1))
def n10(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.edges(spark, sf_dir).withColumn("loc", F.lit(0).cast("long"))
    return percolate(edges, 120, "edge").select("d", "max_cluster_size", "n_clusters", R("giant_fraction", "giant_fraction"))


@query("e24_cluster_statistics", views.sql(COMPONENTS.replace("SELECT d, max(n) AS max_cluster_size", "SELECT d, max(n) AS largest, min(n) AS smallest").replace(", round(max(n) / 120.0::DOUBLE, 6) AS giant_fraction", ""), "v_edge").replace("WITH ", "WITH RECURSIVE ", 1))
def e24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components at all thresholds at once, each threshold's nodes numbered apart, then their sizes."""
    from settlegrid.operators.components import star_components

    at = F.posexplode(F.array(*map(F.lit, THRESHOLDS)))
    edges = views.edges(spark, sf_dir).select(at.alias("k", "d"), "u", "v", "length").where("length <= d")
    parts = star_components(edges.select((F.col("k") * 120 + F.col("u")).alias("a"), (F.col("k") * 120 + F.col("v")).alias("b")))
    nodes = spark.range(120 * len(THRESHOLDS)).withColumnRenamed("id", "v").join(parts, "v", "left")
    sizes = nodes.select(F.floor(F.col("v") / 120).cast("int").alias("k"), F.coalesce("root", "v").alias("root")).groupBy("k", "root").agg(F.count("*").alias("n"))
    d = F.element_at(F.array(*map(F.lit, THRESHOLDS)), F.col("k") + 1)
    return sizes.groupBy(d.alias("d")).agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), F.count("*").alias("n_clusters"))


@query("n7_path_percolation")
def n7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of every third node by path distance through the graph."""
    edges = views.edges(spark, sf_dir).withColumn("loc", F.lit(0).cast("long"))
    return percolate(edges, 120, "path")


@query("n12_percolation_statistics")
def n12(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = n7(spark, sf_dir).select(F.col("loc").alias("series"), "d", F.col("giant_fraction").alias("g"))
    out = curves.max_slope(curve)
    for part in (curves.first_reach(curve, 0.1, "d10"), curves.first_reach(curve, 0.5, "d50"), curves.first_reach(curve, 0.9, "d90"), curves.susceptibility(curve)):
        out = out.join(part, "series")
    return out


@query("n13_path_diversity")
def n13(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        links = list(part[["u", "v", "length"]].sort_values(["u", "v"]).itertuples(index=False, name=None))
        return pd.DataFrame([network.path_diversity(links, 120, range(0, 120, 6))])

    edges = views.edges(spark, sf_dir).withColumn("loc", F.lit(0).cast("long"))
    return edges.groupBy("loc").applyInPandas(run, "n_pairs long, n_connected long, n_paths long, diversity double, mean_distance double")


@query("e26_connected_pairs", views.sql(f"{REACH}, nodes AS (SELECT unnest(range(0, 120, 6)) AS a), reach AS (SELECT a AS src, a AS dst FROM nodes UNION SELECT r.src, e.b FROM reach r JOIN both_ways e ON e.a = r.dst) SELECT count(*) AS n_connected FROM reach JOIN nodes ON dst = a WHERE src < dst", "v_edge").replace("WITH ", "WITH RECURSIVE ", 1))
def e26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n13(spark, sf_dir).select("n_connected")


@query("g1_window_indicators")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole windows from geometry to indicators: blocks of square buildings along made-up streets, a window per supplier tenth."""
    from settlegrid.operators.windows import indicators

    return indicators(made_up_windows(spark, sf_dir), half=64.0).select("loc_key", "status", "n_buildings", R("density", "density", 4), R("r_crit", "r_crit", 3), R("d0", "d0", 4))


def made_up_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loc_key, lat, lon, id, geometry, width``: squares of 4 m at occupied pixels and a street grid, as WKB in degrees."""
    from settlegrid.operators.windows import dealt

    def run(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from settlegrid.operators.geometry import from_local, write_wkb

        loc = int(part["loc"].iloc[0])
        lat, lon = 35.0 + loc, 139.0 - loc
        square = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
        corners = part[["row", "col"]].sort_values(["row", "col"]).to_numpy()
        shapes = [square + (c - 64.0, 60.0 - r) for r, c in corners]
        shapes += [np.array([(-64.0, y), (64.0, y + 3)]) for y in (-40, 0, 40)] + [np.array([(x, -64.0), (x, 64.0)]) for x in (-30, 35)]
        sizes, every = [len(s) for s in shapes], np.concatenate(shapes)
        degrees = np.column_stack(from_local(every[:, 0], every[:, 1], lon, lat, np.repeat(np.arange(len(shapes)), sizes)))
        degrees, n = np.split(degrees, np.cumsum(sizes)[:-1]), len(corners)
        rows = [(f"b{i}", write_wkb("polygon", [p]), np.nan) for i, p in enumerate(degrees[:n])]
        rows += [(f"s{i}", write_wkb("line", p), 4.0 + i) for i, p in enumerate(degrees[n:])]
        return pd.DataFrame(rows, columns=["id", "geometry", "width"]).assign(loc_key=f"{lat:.4f}_{lon:.4f}", lat=lat, lon=lon)[["loc_key", "lat", "lon", "id", "geometry", "width"]]

    return dealt(views.pixels(spark, sf_dir), "loc").groupBy("loc").applyInPandas(run, "loc_key string, lat double, lon double, id string, geometry binary, width double")
