"""Geometry, network and image kernels as grouped or batched Python over Arrow, and what stands around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlegrid.functions import spatial as s
from settlegrid.operators import geometry as g
from settlegrid.operators import joins, network, windows
from settlegrid.plans import views
from settlegrid.plans.graph_queries import made_up_windows
from settlegrid.plans.registry import query

R = lambda column, name, n=6: F.round(column, n).alias(name)
HALF = 5.0
#: Entity boxes in metres around their own grid point: fractions of a degree times 400.
LOCAL = "loc AS (SELECT ent_id, (xmin - round(xmin)) * 12 AS x0, (xmax - round(xmin)) * 12 AS x1, (ymin - round(ymin)) * 12 AS y0, (ymax - round(ymin)) * 12 AS y1 FROM v_entity)"


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lambda c, o: (F.col(c) - F.round(o)) * 12
    return views.entities(spark, sf_dir).select("ent_id", near("xmin", "xmin").alias("x0"), near("xmax", "xmin").alias("x1"), near("ymin", "ymin").alias("y0"), near("ymax", "ymin").alias("y1"))


def _rings(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.array([(a, c), (b, c), (b, d), (a, d), (a, c)], float) for a, b, c, d in rows[["x0", "x1", "y0", "y1"]].itertuples(index=False)]


@query("g2_clip", views.sql(f"{LOCAL} SELECT ent_id, round(greatest(0, least(x1, 5) - greatest(x0, -5)) * greatest(0, least(y1, 5) - greatest(y0, -5)), 6) AS area FROM loc", "v_entity"))
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cut = [g.clip_ring(r, HALF) for r in _rings(rows)]
            yield pd.DataFrame({"ent_id": rows["ent_id"], "area": [abs(g.ring_area(r)) if len(r) else 0.0 for r in cut]})

    return _local(spark, sf_dir).mapInPandas(run, "ent_id long, area double").select("ent_id", R("area", "area"))


@query("g3_wkb", views.sql(f"{LOCAL} SELECT ent_id, 'polygon' AS kind, round((x1 - x0) * (y1 - y0), 6) AS area FROM loc UNION ALL SELECT -1, 'empty', 0.0", "v_entity"))
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes to WKB and back; a null geometry is empty."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"ent_id": rows["ent_id"], "geometry": [g.write_wkb("polygon", [r]) for r in _rings(rows)]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [g.parse_wkb(x) for x in rows["geometry"]]
            yield pd.DataFrame({"ent_id": rows["ent_id"], "kind": [k for k, _ in found], "area": [abs(g.ring_area(p[0][0])) if p else 0.0 for _, p in found]})

    made = _local(spark, sf_dir).mapInPandas(write, "ent_id long, geometry binary")
    made = made.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("ent_id"), F.lit(None).cast("binary").alias("geometry")))
    return made.mapInPandas(read, "ent_id long, kind string, area double").select("ent_id", "kind", R("area", "area"))


@query("g4_rasterise", views.sql(f"{LOCAL} SELECT ent_id, CAST(greatest(0, least(10, ceil(x1 + 4.5)) - greatest(0, ceil(x0 + 4.5))) * greatest(0, least(10, ceil(y1 + 4.5)) - greatest(0, ceil(y0 + 4.5))) AS BIGINT) AS n FROM loc", "v_entity"))
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of one metre whose centres lie in a box."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"ent_id": rows["ent_id"], "n": [int(g.fill([[r]], HALF).sum()) for r in _rings(rows)]})

    return _local(spark, sf_dir).mapInPandas(run, "ent_id long, n long")


@query("g5_burn_streets")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and greatest intensity of each made-up window's streets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, lines = windows.clip_features(rows, float(rows["lat"].iloc[0]), float(rows["lon"].iloc[0]), 64.0)
        image = g.burn_lines(lines, 64.0)
        return pd.DataFrame([(rows["loc_key"].iloc[0], int((image > 0).sum()), int(image.max()))], columns=["loc_key", "n", "most"])

    return windows.dealt(made_up_windows(spark, sf_dir), "loc_key").groupBy("loc_key").applyInPandas(run, "loc_key string, n long, most long")


@query("n5_network_build")
def n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges by kind after streets are snapped and linked and buildings attached."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        polygons, lines = windows.clip_features(rows.sort_values("id"), float(rows["lat"].iloc[0]), float(rows["lon"].iloc[0]), 64.0)
        net = network.build([(w, [tuple(p) for p in x]) for w, x in lines], [g.centroid(p[0]) for p in polygons])
        edges = net.edges()
        kinds = [e[3] for e in edges]
        found = network.statistics(edges, len(net.nodes))
        return pd.DataFrame([(rows["loc_key"].iloc[0], len(polygons), found["n_nodes"], found["n_edges"], kinds.count("virtual"), kinds.count("connection"), found["n_components"])], columns=["loc_key", "n_buildings", "n_nodes", "n_edges", "n_virtual", "n_connection", "n_components"])

    return windows.dealt(made_up_windows(spark, sf_dir), "loc_key").groupBy("loc_key").applyInPandas(run, "loc_key string, n_buildings long, n_nodes long, n_edges long, n_virtual long, n_connection long, n_components long")


@query("k10_overlay")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PNG of each made-up window."""
    from settlegrid.sources import images

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lat, lon = float(rows["lat"].iloc[0]), float(rows["lon"].iloc[0])
        polygons, lines = windows.clip_features(rows.sort_values("id"), lat, lon, 64.0)
        net = network.build([(w, [tuple(p) for p in x]) for w, x in lines], [g.centroid(p[0]) for p in polygons])
        image = images.overlay(g.burn_lines(lines, 64.0), g.fill(polygons, 64.0), net.nodes, net.edges(), 64.0)
        return pd.DataFrame([(images.image_name(lat, lon), images.png(image, {"lat": str(lat), "lon": str(lon)}))], columns=["name", "png"])

    return windows.dealt(made_up_windows(spark, sf_dir), "loc_key").groupBy("loc_key").applyInPandas(run, "name string, png binary").select("name", F.octet_length("png").alias("bytes"))


FOREST = """e AS (SELECT *, row_number() OVER (ORDER BY length, u, v) AS k FROM v_edge), w AS (SELECT k, u AS a, v AS b FROM e UNION ALL SELECT k, v, u FROM e),
  reach AS (SELECT k AS e, u AS n FROM e UNION SELECT r.e, w.b FROM reach r JOIN w ON w.a = r.n AND w.k < r.e)
  SELECT u, v, length FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.e = e.k AND reach.n = e.v)"""


@query("n8_spanning_forest", views.sql(FOREST, "v_edge").replace("WITH ", "WITH RECURSIVE ", 1))
def n8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum spanning forest of a graph, one task per graph; equal lengths go by their ends."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["length", "u", "v"])[["length", "u", "v"]].itertuples(index=False, name=None)
        return pd.DataFrame(network._forest(ordered, 120), columns=["length", "u", "v"])[["u", "v", "length"]]

    return views.edges(spark, sf_dir).withColumn("loc", F.lit(0)).groupBy("loc").applyInPandas(run, "u long, v long, length double")


@query("p3_box_predicates", views.sql("SELECT loc_id % 7 AS k, count(*) FILTER (xmin >= min_lon AND xmax <= max_lon AND ymin >= min_lat AND ymax <= max_lat) AS inside, count(*) AS touching FROM v_entity JOIN v_box ON xmax >= min_lon AND xmin <= max_lon AND ymax >= min_lat AND ymin <= max_lat GROUP BY 1", "v_entity", "v_box"))
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = joins.grid_join(views.entities(spark, sf_dir), views.boxes(spark, sf_dir), s.intersects(joins.BOX))
    return met.groupBy((F.col("loc_id") % 7).alias("k")).agg(F.count_if(s.contains(joins.BOX)).alias("inside"), F.count("*").alias("touching"))


@query("p4_nested_projection", views.sql("SELECT ent_id AS id, kind AS name, round(xmin, 6) AS x FROM v_entity WHERE ymin > 0", "v_entity"))
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = views.entities(spark, sf_dir).select("ent_id", F.struct(F.col("kind").alias("primary")).alias("names"), F.struct("xmin", "xmax", "ymin", "ymax").alias("bbox"))
    return nested.where("bbox.ymin > 0").select(F.col("ent_id").alias("id"), F.col("names.primary").alias("name"), R("bbox.xmin", "x"))


@query("g9_flatten_lines", "SELECT l_orderkey, count(*) - 1 AS pieces FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from their points; those of one point are left out."""
    points = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("line"))
    kept = points.where(F.size("line") > 1)
    pieces = kept.select("l_orderkey", F.explode(F.expr("transform(sequence(1, size(line) - 1), i -> named_struct('a', line[i - 1], 'b', line[i]))")))
    return pieces.groupBy("l_orderkey").agg(F.count("*").alias("pieces"))


@query("n9_threshold_counts", views.sql("t AS (SELECT unnest([100.0::DOUBLE, 300.0::DOUBLE, 600.0::DOUBLE]) AS d) SELECT d, count(*) AS n_edges, round(avg(length), 6) AS mean_length FROM t JOIN v_edge ON length <= d GROUP BY d", "v_edge"))
def n9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that each threshold lets through; one pass, each edge dealt to the thresholds it passes."""
    at = F.explode(F.filter(F.array(*map(F.lit, (100.0, 300.0, 600.0))), lambda d: d >= F.col("length")))
    return views.edges(spark, sf_dir).select("length", at.alias("d")).groupBy("d").agg(F.count("*").alias("n_edges"), R(F.avg("length"), "mean_length"))


@query("i10_strided_lacunarity", views.sql("c AS (SELECT loc, row // 8 AS i, col // 8 AS j, count(*) AS n FROM v_pix GROUP BY 1, 2, 3), x AS (SELECT loc, sum(n)::DOUBLE / 256 AS mu, sum(n * n)::DOUBLE / 256 AS sq FROM c GROUP BY loc) SELECT loc, round(1 + (sq - mu * mu) / (mu * mu), 6) AS \"lambda\" FROM x", "v_pix"))
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lacunarity over boxes of 8 set side by side instead of gliding."""
    masses = views.pixels(spark, sf_dir).groupBy("loc", F.floor(F.col("row") / 8).alias("i"), F.floor(F.col("col") / 8).alias("j")).agg(F.count("*").alias("n"))
    sums = masses.groupBy("loc").agg((F.sum("n") / 256).alias("mu"), (F.sum(F.col("n") * F.col("n")) / 256).alias("sq"))
    return sums.select("loc", R(1 + (F.col("sq") - F.col("mu") ** 2) / F.col("mu") ** 2, "lambda"))


@query("e15_weighted_skewness", views.sql("m AS (SELECT grp, sum(weight) AS w, sum(weight * f1) / sum(weight) AS mean FROM v_feat GROUP BY grp) SELECT grp, round(sum(weight * (f1 - mean) ** 3) / any_value(w) / (sum(weight * (f1 - mean) ** 2) / any_value(w)) ** 1.5::DOUBLE, 5) AS skew FROM v_feat JOIN m USING (grp) GROUP BY grp", "v_feat"))
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from settlegrid.operators.curves import spectrum_skewness

    rows = views.features(spark, sf_dir).select(F.col("grp").alias("series"), F.col("f1").alias("alpha"), F.col("weight").alias("f_alpha"))
    return spectrum_skewness(rows).select(F.col("series").alias("grp"), R("s_alpha", "skew", 5))
