"""Stores, caches, streams, statistics that have no SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from settlegrid import cli
from settlegrid.functions.spatial import intersects
from settlegrid.operators import joins, stats
from settlegrid.operators.components import star_components
from settlegrid.plans import graph_queries
from settlegrid.sources import scans
from settlegrid.sources.results import ResultStore, done_keys
from settlegrid.streaming.resume import extract_new_files, windowed_counts

KEYS = ["lat", "lon"]
SCHEMA = "lat double, lon double, status string, error string, density double, perc_dcrit double, curve array<double>"


def test_store_round_trip(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), KEYS, SCHEMA)
    row = spark.createDataFrame([(35.0, 139.0, "done", 0.05, 42.0, [0.1, 1.0])], "lat double, lon double, status string, density double, perc_dcrit double, curve array<double>")
    store.upsert(row)
    store.upsert(row.withColumn("density", F.lit(float("nan"))))
    store.mark_failed(spark.createDataFrame([(36.0, 140.0, "x" * 900)], "lat double, lon double, error string"))
    rows = {r.lat: r for r in store.read().collect()}
    assert len(rows) == 2 and rows[35.0].curve == [0.1, 1.0] and rows[35.0].density is None
    assert len(rows[36.0].error) == 500 and rows[36.0].density is None
    assert [tuple(r) for r in done_keys(store.read(), KEYS).collect()] == [(35.0, 139.0)]
    store.mark_failed(spark.createDataFrame([(35.0, 139.0, "again")], "lat double, lon double, error string"))
    assert store.done_keys().count() == 0
    assert store.merge(row.withColumn("other", F.lit(1))) == (2, 2)
    assert {r.status for r in store.read().where("lat = 35").collect()} == {"done"}


def features(spark, n):
    rows = [(i, i * 0.01, i * 0.01 + 0.002, 0.5, 0.502, "road") for i in range(n)]
    flat = spark.createDataFrame(rows, "id long, xmin double, xmax double, ymin double, ymax double, subtype string")
    return flat.select("id", F.struct("xmin", "xmax", "ymin", "ymax").alias("bbox"), "subtype", F.lit("primary").alias("class"), F.lit(None).cast("string").alias("subclass"), F.struct(F.lit("n").alias("primary")).alias("names"), F.lit(b"").alias("geometry"), F.lit(1.0).alias("height"), F.lit(2).alias("num_floors"))


def test_scans_and_resumable_cache(spark, tmp_path):
    path = str(tmp_path / "features")
    features(spark, 100).repartition(5).write.parquet(path)
    window = (0.101, 0.4, 0.301, 0.6)
    assert scans.buildings(spark, path, window).count() == 19
    roads = scans.roads(spark, path, window)
    assert roads.count() == 21 and {r.width for r in roads.collect()} == {12.0}
    assert "PushedFilters: [" in roads._jdf.queryExecution().explainString(roads.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    boxes = spark.createDataFrame([("a", *window), ("b", 0.7, 0.4, 0.8, 0.6)], "loc_key string, min_lon double, min_lat double, max_lon double, max_lat double")
    job = scans.ChunkedExtract(spark, str(tmp_path / "cache"), chunk_files=2)
    assert job.run(path, boxes, inside=False) == 3 and job.run(path, boxes, inside=False) == 0
    cache = spark.read.parquet(str(tmp_path / "cache/final"))
    assert scans.read_cache(cache, boxes.where("loc_key = 'a'")).count() == 21
    assert scans.locations_from_text(spark, "lat,lon,name\n1,2,NA\n", "csv").first()["name"] == "NA"
    assert scans.locations_from_text(spark, '{"locations": [{"coords": [1, 2]}]}', "json").first()["lon"] == 2


def test_static_and_grid_joins_agree(spark):
    rows = features(spark, 300).select("id", "bbox.*")
    boxes = spark.createDataFrame([(i, i * 0.3 - 0.1, 0.4, i * 0.3 + 0.05, 0.6) for i in range(9)], "box long, min_lon double, min_lat double, max_lon double, max_lat double")
    pairs = lambda join: sorted((r["id"], r["box"]) for r in join(rows, boxes, intersects(joins.BOX)).collect())
    assert pairs(joins.static_join) == pairs(joins.grid_join) == pairs(joins.window_join)


def test_streams(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(10).write.parquet(path)
    copy = lambda: extract_new_files(spark, path, "id long", out, mark, lambda df: df.where("id % 2 = 0"))
    copy()
    spark.range(10, 20).write.mode("append").parquet(path)
    copy()
    copy()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(0, 20, 2))
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.event_type, r.n, r.total) for r in windowed_counts(events).collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_statistics_without_sql(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(200, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.5]])
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    centred = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", centred, np.linalg.pinv(np.cov(x.T)), centred))
    assert np.allclose([r.maha for r in stats.mahalanobis(rows, ["a", "b", "c"]).orderBy("id").collect()], want)
    axes, shares = stats.principal_axes(rows, ["a", "b", "c"])
    assert shares[0] > shares[1] and abs(axes.corr("pc1", "pc2")) < 1e-6
    far = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(np.r_[draw.normal(0, 0.1, 60), draw.normal(9, 0.1, 30), draw.normal(-9, 0.1, 10)])], "id long, a double, b double")
    sizes = stats.clusters(far, ["a", "b"], 3).groupBy("cluster").count().orderBy("cluster").collect()
    assert [r["count"] for r in sizes] == [60, 30, 10]
    assert max(stats.best_k(far, ["a", "b"], range(2, 5)), key=lambda s: s[1])[0] == 3
    assert abs(stats.uniform_baseline(9) - 5.719095841793664) < 1e-12
    boot = stats.bootstrap_rows(far.withColumn("g", F.lit(1)), "id", 5, group="g")
    assert [r["count"] for r in boot.groupBy("replicate").count().collect()] == [100] * 5
    assert stats.average_linkage_order(np.array([[0, 9, 1], [9, 0, 9], [1, 9, 0.0]])) == [0, 2, 1]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 1), (5, 5), *[(i, i + 1) for i in range(20, 60)]], "a long, b long")
    got = {r.v: r.root for r in star_components(edges).collect()}
    assert got == {2: 1, 3: 1, 9: 8} | {i: 20 for i in range(21, 61)}


def test_whole_windows_through_the_command_line(spark, tmp_path):
    made = graph_queries.made_up_windows(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame([("0.0000_0.0000", 0.0, 0.0, "x", b"", 1.0)], made.schema)
    made.unionByName(odd).write.parquet(str(tmp_path / "features"))
    store, other = str(tmp_path / "store"), str(tmp_path / "other")
    run = ["run", "--features", str(tmp_path / "features"), "--half", "64"]
    assert cli.main([*run, "--store", store], spark) == 1
    rows = {r.loc_key: r for r in ResultStore(spark, store, ["loc_key"], cli.SCHEMA).read().collect()}
    assert rows["0.0000_0.0000"].status == "failed"
    done = [r for r in rows.values() if r.status == "done"]
    assert done and all(r.curve_lambda == sorted(r.curve_lambda, reverse=True) and r.curve_lambda[-1] == 1 for r in done)
    assert all(r.curve_g == sorted(r.curve_g) and 0 < r.density < 0.2 for r in done)
    assert cli.main(["merge", "--other", store, "--store", other], spark) == 0
    assert cli.main(["status", "--store", other], spark) == 0
    assert cli.main(["export", "--csv", str(tmp_path / "csv"), "--store", other], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == len(rows)


def test_wide_entities_meet_by_grid_and_statically(spark):
    from pyspark.sql import functions as F

    from settlegrid.operators.joins import grid_join, static_join

    entities = spark.createDataFrame([(1, 0.1, 0.1, 7.9, 3.2), (2, 2.5, 1.5, 2.6, 1.6), (3, -3.5, -2.0, 2.0, 1.0), (4, 9.0, 9.0, 9.0, 9.0)], "ent_id int, xmin double, ymin double, xmax double, ymax double")
    boxes = spark.createDataFrame([(i, x, y, x + 0.5, y + 0.5) for i, (x, y) in enumerate([(0.0, 0.0), (2.4, 1.4), (5.0, 3.0), (-3.6, -2.2), (2.0, 1.0), (7.9, 3.2), (8.9, 8.9), (9.0, 9.0)])], "loc_id int, min_lon double, min_lat double, max_lon double, max_lat double")
    touch = (F.col("xmax") >= F.col("min_lon")) & (F.col("xmin") <= F.col("max_lon")) & (F.col("ymax") >= F.col("min_lat")) & (F.col("ymin") <= F.col("max_lat"))
    rows = [sorted((r.ent_id, r.loc_id) for r in join(entities, boxes, touch).collect()) for join in (static_join, grid_join)]
    assert rows[0] == rows[1] and len(rows[0]) > 6


def test_a_lost_pointer_is_an_error_and_not_an_empty_store(spark, tmp_path):
    import shutil

    import pytest

    from settlegrid.sources.results import ResultStore

    store = ResultStore(spark, str(tmp_path / "s"), ["k"], "k int, status string, error string")
    assert store.read().count() == 0
    for k in (1, 2):
        store.upsert(spark.createDataFrame([(k, "done", None)], "k int, status string, error string"))
    assert store.read().count() == 2
    shutil.rmtree(tmp_path / "s" / "_pointers")
    with pytest.raises(RuntimeError):
        store.upsert(spark.createDataFrame([(3, "done", None)], "k int, status string, error string"))


def test_unreadable_geometry_is_empty():
    from settlegrid.operators.geometry import parse_wkb

    assert parse_wkb(b"\x01\x03\x00") == ("empty", []) and parse_wkb(b"\x01") == ("empty", []) and parse_wkb(None) == ("empty", [])


def test_lists_and_settings_in_yaml():
    from settlegrid.config import DEFAULTS, settings

    changed = settings("analysis:\n  percolation:\n    d_steps: 7\ncanvas: {half_size_m: 500}\n")
    assert changed["analysis"]["percolation"]["d_steps"] == 7 and changed["analysis"]["percolation"]["d_max"] == 2000
    assert changed["canvas"]["half_size_m"] == 500 and DEFAULTS["canvas"]["half_size_m"] == 1000
    assert settings() == DEFAULTS == settings("")
    with pytest.raises(ValueError):
        settings("- 1\n")


def test_yaml_locations(spark):
    made = scans.locations_from_text(spark, "locations:\n- {name: NA, lat: 1, lon: 2}\n- {coords: [3, 4]}\n", "yaml").collect()
    assert [tuple(r) for r in made] == [(1.0, 2.0, "NA"), (3.0, 4.0, None)]
    assert scans.locations_from_text(spark, "", "yaml").count() == 0


def test_cache_is_read_from_its_table_else_its_listed_chunks(spark, tmp_path):
    cache = str(tmp_path / "cache")
    assert scans.cache_source(spark, cache) is None
    for n in range(2):
        spark.range(n + 1).write.parquet(f"{cache}/chunk_{n:04d}")
    assert scans.cache_source(spark, cache) is None
    spark.createDataFrame([(0, 1)], "chunk int, rows long").write.json(f"{cache}/manifest")
    assert scans.cache_source(spark, cache).count() == 1
    spark.range(9).write.parquet(f"{cache}/final")
    assert scans.cache_source(spark, cache).count() == 9
