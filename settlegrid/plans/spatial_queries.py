"""Boxes, keys, classes, spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from settlegrid.functions import spatial as s
from settlegrid.operators import joins as j
from settlegrid.plans import views
from settlegrid.plans.registry import query

R = lambda column, name, n=6: F.round(column, n).alias(name)
BOX_SQL = """m AS (SELECT loc_id, lat, lon, 111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * radians(lat)) + 1.175::DOUBLE * cos(4 * radians(lat)) AS per_lat,
    111412.84::DOUBLE * cos(radians(lat)) - 93.5::DOUBLE * cos(3 * radians(lat)) AS per_lon FROM v_loc)"""


@query("p1_box_around", views.sql(f"{BOX_SQL} SELECT loc_id, round(lon - 1000 / per_lon, 6) AS min_lon, round(lat - 1000 / per_lat, 6) AS min_lat, round(lon + 1000 / per_lon, 6) AS max_lon, round(lat + 1000 / per_lat, 6) AS max_lat FROM m", "v_loc"))
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = s.box_around(F.col("lat"), F.col("lon"), 1000.0)
    return views.locations(spark, sf_dir).select("loc_id", *(R(c, n) for n, c in around.items()))


@query("p2_loc_key", views.sql("SELECT loc_id, printf('%.4f_%.4f', lat, lon) AS loc_key FROM v_loc", "v_loc"))
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.locations(spark, sf_dir).select("loc_id", s.loc_key(F.col("lat"), F.col("lon")).alias("loc_key"))


@query("p5_road_width", "SELECT p_partkey AS id, CASE p_type WHEN 'motorway' THEN 20.0 WHEN 'trunk' THEN 15.0 WHEN 'primary' THEN 12.0 WHEN 'residential' THEN 6.0 ELSE 5.0 END::DOUBLE * 1 AS width, CASE p_size % 8 WHEN 0 THEN 20.0 WHEN 1 THEN 15.0 WHEN 2 THEN 12.0 WHEN 3 THEN 10.0 WHEN 4 THEN 8.0 WHEN 5 THEN 6.0 WHEN 6 THEN 4.0 ELSE 5.0 END::DOUBLE AS by_class FROM part")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in (*s.ROAD_WIDTHS, "path")))
    part = views.table(spark, sf_dir, "part").withColumn("class", F.element_at(kinds, F.col("p_size") % 8 + 1))
    return part.select(F.col("p_partkey").alias("id"), s.road_width(F.col("p_type")).alias("width"), s.road_width(F.col("class")).alias("by_class"))


CELLS = "FROM v_box, unnest(generate_series(CAST(floor(min_lon) AS BIGINT) - 1, CAST(floor(max_lon) AS BIGINT) + 1)) x(cell_x), unnest(generate_series(CAST(floor(min_lat) AS BIGINT) - 1, CAST(floor(max_lat) AS BIGINT) + 1)) y(cell_y)"


@query("p6_box_cells", views.sql(f"SELECT loc_id, cell_x, cell_y {CELLS}", "v_box"))
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.box_cells(views.boxes(spark, sf_dir)).select("loc_id", F.col("cell_x").cast("long"), F.col("cell_y").cast("long"))


@query("p7_entity_cell", views.sql("SELECT ent_id, CAST(floor((xmin + xmax) / 2) AS BIGINT) AS cell_x, CAST(floor((ymin + ymax) / 2) AS BIGINT) AS cell_y FROM v_entity", "v_entity"))
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (s.cell_of(F.col(a), F.col(b)).cast("long").alias(n) for a, b, n in (("xmin", "xmax", "cell_x"), ("ymin", "ymax", "cell_y")))
    return views.entities(spark, sf_dir).select("ent_id", x, y)


INSIDE = "xmin >= min_lon AND xmax <= max_lon AND ymin >= min_lat AND ymax <= max_lat"
TOUCH = "xmax >= min_lon AND xmin <= max_lon AND ymax >= min_lat AND ymin <= max_lat"


@query("d2_grid_join", views.sql(f"SELECT ent_id, loc_id FROM v_entity JOIN v_box ON {INSIDE}", "v_entity", "v_box"))
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.grid_join(views.entities(spark, sf_dir), views.boxes(spark, sf_dir), s.contains(j.BOX)).select("ent_id", "loc_id")


@query("a2_intersecting", views.sql(f"SELECT ent_id, loc_id FROM v_entity JOIN v_box ON {TOUCH}", "v_entity", "v_box"))
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.grid_join(views.entities(spark, sf_dir), views.boxes(spark, sf_dir), s.intersects(j.BOX)).select("ent_id", "loc_id")


@query("d1_static_join", views.sql(f"SELECT ent_id, loc_id FROM v_entity JOIN v_box ON {INSIDE}", "v_entity", "v_box"))
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boxes, in blocks of so many that are broadcast; the cut into blocks is by range of their ids."""
    return j.static_join_in_blocks(views.entities(spark, sf_dir), views.boxes(spark, sf_dir), s.contains(j.BOX), "loc_id").select("ent_id", "loc_id")


@query("a1_contained_scan", "SELECT p_partkey AS ent_id, p_type AS kind FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice >= 950 AND p_retailprice <= 1400")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan whose range predicates reach the Parquet reader and whose columns are pruned."""
    part = views.table(spark, sf_dir, "part").where("p_size between 10 and 20 and p_retailprice >= 950 and p_retailprice <= 1400")
    return part.select(F.col("p_partkey").alias("ent_id"), F.col("p_type").alias("kind"))


@query("d3_spatial_dedupe", views.sql(f"r AS (SELECT ent_id, loc_id, row_number() OVER (PARTITION BY ent_id ORDER BY loc_id) AS rn FROM v_entity LEFT JOIN v_box ON {TOUCH}) SELECT ent_id, loc_id FROM r WHERE rn = 1", "v_entity", "v_box"))
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents = views.entities(spark, sf_dir)
    met = j.grid_join(ents, views.boxes(spark, sf_dir), s.intersects(j.BOX)).select("ent_id", "loc_id")
    first = j.first_per_key(met, ["ent_id"], "loc_id")
    return ents.select("ent_id").join(first, "ent_id", "left")


@query("w1_row_number_dedupe", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    return j.first_per_key(orders, ["o_custkey"], F.col("o_totalprice").desc(), "o_orderkey").select("o_custkey", "o_orderkey")


NEAR_SQL = """p AS (SELECT ent_id AS id, (xmin + xmax) / 2 * 100 AS x, (ymin + ymax) / 2 * 100 AS y FROM v_entity)
    SELECT a.id AS i, b.id AS j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS dist FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) <= 15 AND abs(a.y - b.y) <= 15 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 15"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.entities(spark, sf_dir).select(F.col("ent_id").alias("id"), ((F.col("xmin") + F.col("xmax")) / 2 * 100).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2 * 100).alias("y"))


@query("d4_distance_join", views.sql(NEAR_SQL, "v_entity"))
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.within_distance(_points(spark, sf_dir), 15.0).select("i", "j", R("dist", "dist"))


SEG_SQL = """p AS (SELECT ent_id AS id, (xmin + xmax) / 2 * 100 AS x, (ymin + ymax) / 2 * 100 AS y FROM v_entity),
    s AS (SELECT loc_id AS seg, lon * 100 AS x1, lat * 100 AS y1, lon * 100 + loc_id % 9 AS x2, lat * 100 + loc_id % 5 AS y2 FROM v_loc),
    t AS (SELECT *, CASE WHEN (x2 - x1) ** 2 + (y2 - y1) ** 2 > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) ELSE 0.0::DOUBLE END AS k
      FROM p JOIN s ON abs(x - x1) <= 40 AND abs(y - y1) <= 40),
    d AS (SELECT id, seg, x1 + k * (x2 - x1) AS px, y1 + k * (y2 - y1) AS py, x, y FROM t),
    e AS (SELECT id, seg, px, py, sqrt((x - px) ** 2 + (y - py) ** 2) AS dist FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, seg) AS rn FROM e WHERE dist <= 20)
    SELECT id, seg, round(dist, 6) AS dist FROM r WHERE rn = 1"""


@query("d5_nearest_segment", views.sql(SEG_SQL, "v_entity", "v_loc"))
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = views.locations(spark, sf_dir)
    segments = at.select(F.col("loc_id").alias("seg"), (F.col("lon") * 100).alias("x1"), (F.col("lat") * 100).alias("y1"), (F.col("lon") * 100 + F.col("loc_id") % 9).alias("x2"), (F.col("lat") * 100 + F.col("loc_id") % 5).alias("y2"))
    return j.nearest_segment(_points(spark, sf_dir), segments, 20.0).select("id", "seg", R("dist", "dist"))


@query("g10_project_on_line", views.sql(SEG_SQL.replace("round(dist, 6) AS dist", "round(px, 6) AS px, round(py, 6) AS py"), "v_entity", "v_loc"))
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = views.locations(spark, sf_dir)
    segments = at.select(F.col("loc_id").alias("seg"), (F.col("lon") * 100).alias("x1"), (F.col("lat") * 100).alias("y1"), (F.col("lon") * 100 + F.col("loc_id") % 9).alias("x2"), (F.col("lat") * 100 + F.col("loc_id") % 5).alias("y2"))
    return j.nearest_segment(_points(spark, sf_dir), segments, 20.0).select("id", "seg", R("px", "px"), R("py", "py"))


RINGS = "rings AS (SELECT 'c' || k AS country, x1, y1, x2, y2 FROM (VALUES (1, -60.0::DOUBLE, -40.0::DOUBLE, 40.0::DOUBLE, -45.5::DOUBLE), (1, 40.0::DOUBLE, -45.5::DOUBLE, 10.5::DOUBLE, 35.25::DOUBLE), (1, 10.5::DOUBLE, 35.25::DOUBLE, -60.0::DOUBLE, -40.0::DOUBLE), (2, 0.3::DOUBLE, 0.1::DOUBLE, 90.2::DOUBLE, 5.7::DOUBLE), (2, 90.2::DOUBLE, 5.7::DOUBLE, 60.4::DOUBLE, 50.9::DOUBLE), (2, 60.4::DOUBLE, 50.9::DOUBLE, 20.6::DOUBLE, 44.8::DOUBLE), (2, 20.6::DOUBLE, 44.8::DOUBLE, 0.3::DOUBLE, 0.1::DOUBLE)) t(k, x1, y1, x2, y2))"


@query("g11_point_in_polygon", views.sql(f"{RINGS} SELECT loc_id AS id, country FROM v_loc JOIN rings ON ((y1 > lat) <> (y2 > lat)) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY loc_id, country HAVING count(*) % 2 = 1", "v_loc"))
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [("c1", -60.0, -40.0, 40.0, -45.5), ("c1", 40.0, -45.5, 10.5, 35.25), ("c1", 10.5, 35.25, -60.0, -40.0), ("c2", 0.3, 0.1, 90.2, 5.7), ("c2", 90.2, 5.7, 60.4, 50.9), ("c2", 60.4, 50.9, 20.6, 44.8), ("c2", 20.6, 44.8, 0.3, 0.1)]
    rings = spark.createDataFrame(edges, "country string, x1 double, y1 double, x2 double, y2 double")
    points = views.locations(spark, sf_dir).select(F.col("loc_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return j.point_in_polygon(points, rings)


PAIR_SQL = """z AS (SELECT *, f1 + 2 AS density FROM v_feat), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY density, id) AS rn FROM z)
    SELECT a.id AS id_i, b.id AS id_j, round((a.density + b.density) / 2, 6) AS density FROM r a JOIN r b ON a.grp = b.grp AND b.rn BETWEEN a.rn + 1 AND a.rn + 59
    WHERE abs(a.density - b.density) / ((a.density + b.density) / 2) <= 0.02"""


@query("d9_band_pairs", views.sql(PAIR_SQL, "v_feat"))
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.features(spark, sf_dir).select("id", "grp", (F.col("f1") + 2).alias("density"))
    return j.band_pairs(rows, "density", 59, 0.02, group="grp").select("id_i", "id_j", R((F.col("density_i") + F.col("density_j")) / 2, "density"))


@query("d10_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select("c_custkey").join(views.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("d13_semi_join", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return views.table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey").join(failed, "c_custkey", "left_semi")


@query("d7_checked_left_join", "SELECT o_orderkey, c_mktsegment, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS covered FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join to a side whose key is unique; a repeated key fails the job rather than the result."""
    customer = views.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    unique = customer.groupBy("c_custkey").agg(F.count("*").alias("n"), F.first("c_mktsegment").alias("c_mktsegment"))
    unique = unique.withColumn("ok", F.when(F.col("n") > 1, F.raise_error(F.lit("the key is not unique")).cast("int")).otherwise(1)).where("ok = 1")
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(unique, "c_custkey", "left").select("o_orderkey", "c_mktsegment", F.coalesce("ok", F.lit(0)).alias("covered"))


@query("d15_cache_routing", "SELECT o_orderkey, 'cache' AS source FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT o_orderkey, 'remote' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = views.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("held"))
    orders = views.table(spark, sf_dir, "orders").join(held, "o_custkey", "left")
    return orders.select("o_orderkey", F.when(F.col("held"), "cache").otherwise("remote").alias("source"))


@query("p13_density_band", views.sql("SELECT id, CASE WHEN abs(f1) / 5 < 0.0135 THEN 'sparse' WHEN abs(f1) / 5 < 0.061 THEN 'mid' ELSE 'dense' END AS band FROM v_feat", "v_feat"))
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.features(spark, sf_dir).select("id", s.density_band(F.abs("f1") / 5).alias("band"))


@query("p14_slug", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]+', '_', 'g') || '_' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS slug FROM part")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return views.table(spark, sf_dir, "part").select("p_partkey", F.concat(s.slug(F.col("p_name")), F.lit("_"), n.cast("string")).alias("slug"))


@query("p15_logs", views.sql("SELECT id, round(ln(greatest(f1, 1e-9::DOUBLE)), 6) AS ln_f1, round(log10(greatest(f2, 1e-12::DOUBLE)), 6) AS log_f2, round(ln(1 + abs(f3)), 6) AS log1p_f3 FROM v_feat", "v_feat"))
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.features(spark, sf_dir).select("id", R(s.log_clamped(F.col("f1"), 1e-9), "ln_f1"), R(F.log10(F.greatest("f2", F.lit(1e-12))), "log_f2"), R(F.log1p(F.abs("f3")), "log1p_f3"))


@query("p16_describe", views.sql("SELECT id, CASE WHEN 5 * f1 > 0.7 THEN 'dense' WHEN 5 * f1 < -0.4 THEN 'sparse' ELSE 'middling' END || ' ' || CASE WHEN 5 * f7 > 0.5 THEN 'abrupt' WHEN 5 * f6 > 0.5 THEN 'gradual' WHEN 5 * f4 > 0.5 THEN 'split' ELSE 'plain' END AS name FROM v_feat", "v_feat"))
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = {"density": 5 * F.col("f1"), "gamma": 5 * F.col("f7"), "w_trans": 5 * F.col("f6"), "r_crit": 5 * F.col("f4")}
    return views.features(spark, sf_dir).select("id", s.describe(z).alias("name"))


@query("p20_haversine", views.sql("SELECT a.loc_id, round(2 * 6371.0::DOUBLE * asin(sqrt(sin((radians(b.lat) - radians(a.lat)) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin((radians(b.lon) - radians(a.lon)) / 2) ** 2)), 4) AS km FROM v_loc a JOIN v_loc b ON b.loc_id = a.loc_id + 1", "v_loc"))
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.locations(spark, sf_dir)
    b = a.select((F.col("loc_id") - 1).alias("loc_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "loc_id").select("loc_id", R(s.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), "km", 4))


@query("p8_rounded_key_join", views.sql("SELECT a.loc_id FROM v_loc a JOIN v_loc b ON round(a.lat, 6) = round(b.lat + 1e-9::DOUBLE, 6) AND round(a.lon, 6) = round(b.lon, 6)", "v_loc"))
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.locations(spark, sf_dir)
    keyed = lambda df, d: df.select("loc_id", F.round(F.col("lat") + d, 6).alias("klat"), F.round("lon", 6).alias("klon"))
    return keyed(a, 0.0).join(keyed(a, 1e-9).drop("loc_id"), ["klat", "klon"]).select("loc_id")


@query("p9_range_slice", views.sql("SELECT loc_id FROM (SELECT loc_id, row_number() OVER (ORDER BY lat, lon, loc_id) - 1 AS i FROM v_loc) WHERE i >= 20 AND i < 45", "v_loc"))
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = views.locations(spark, sf_dir).orderBy("lat", "lon", "loc_id").limit(45).offset(20)
    return ordered.select("loc_id")


@query("p10_threshold_filters", views.sql("SELECT id FROM v_feat WHERE f1 >= 0.003 AND f1 <= 0.05 AND f2 > -0.1 AND f3 IS NOT NULL", "v_feat"))
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.features(spark, sf_dir).where(F.col("f1").between(0.003, 0.05) & (F.col("f2") > -0.1) & F.col("f3").isNotNull()).select("id")


@query("p11_dropna", views.sql("x AS (SELECT id, CASE WHEN f1 > 0 THEN f1 END AS a, CASE WHEN f2 > 0 THEN f2 END AS b FROM v_feat) SELECT id, round(a, 6) AS a, round(b, 6) AS b FROM x WHERE a IS NOT NULL AND b IS NOT NULL", "v_feat"))
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.features(spark, sf_dir).select("id", F.when(F.col("f1") > 0, F.round("f1", 6)).alias("a"), F.when(F.col("f2") > 0, F.round("f2", 6)).alias("b"))
    return rows.dropna(subset=["a", "b"])


@query("p12_code_labels", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'southern' WHEN 2 THEN 'eastern' WHEN 3 THEN 'western' ELSE 'unknown' END AS label FROM nation")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for pair in ((0, "southern"), (2, "eastern"), (3, "western")) for x in pair])
    return views.table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.try_element_at(labels, F.col("n_regionkey")), F.lit("unknown")).alias("label"))


@query("g7_areas_lengths", views.sql("SELECT kind, round(avg((xmax - xmin) * (ymax - ymin)), 9) AS mean_area, round(median((xmax - xmin) * (ymax - ymin)), 9) AS median_area, round(sum(2 * (xmax - xmin + ymax - ymin)), 6) AS length FROM v_entity GROUP BY kind", "v_entity"))
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shoelace area and length of rings, here the corners of each entity's box."""
    from settlegrid.functions.geometry import ring_area, ring_length

    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    rows = views.entities(spark, sf_dir).withColumn("ring", ring).select("kind", ring_area("ring").alias("area"), ring_length("ring").alias("length"))
    return rows.groupBy("kind").agg(R(F.avg("area"), "mean_area", 9), R(F.median("area"), "median_area", 9), R(F.sum("length"), "length"))


@query("g8_centroid", views.sql("SELECT ent_id, round((xmin + xmax) / 2, 6) AS x, round((ymin + ymax) / 2, 6) AS y FROM v_entity", "v_entity"))
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from settlegrid.functions.geometry import ring_centroid

    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    x, y = ring_centroid("ring")
    return views.entities(spark, sf_dir).withColumn("ring", ring).select("ent_id", R(x, "x"), R(y, "y"))
