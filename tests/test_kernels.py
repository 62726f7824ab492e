"""Kernels against worked values, brute force and each other."""

import heapq
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest

from settlegrid.functions.spatial import geometric_sizes, shifts, thresholds
from settlegrid.operators import curves, geometry, network, raster
from settlegrid.sources import images

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_grids():
    assert geometric_sizes(2, 2000, 20) == [2, 4, 5, 8, 12, 17, 25, 36, 52, 75, 109, 156, 225, 324, 467, 671, 966, 1390, 2000]
    assert shifts(25)[:5] == [0, 1, 3, 4, 6] and shifts(25)[-1] == 24 and shifts(1) == [0]
    assert np.allclose([(a + b) / 2 for a, b in zip(thresholds(), thresholds()[1:4])], [11.096, 31.288, 51.480], atol=1e-3)


def test_lacunarity_and_dimensions_of_noise():
    image = (np.random.default_rng(42).random((128, 128)) < 0.05).astype(np.uint8)
    found = raster.lacunarity_kernel(image, geometric_sizes(2, 128, 12))
    assert all(x[1] > 0 for x in found)
    beta = -np.polyfit(np.log([x[0] for x in found]), np.log([max(x[1], 1) for x in found]), 1)[0]
    assert math.isfinite(beta)
    qs, sizes = np.arange(-5, 5.5, 0.5), geometric_sizes(2, 64, 10)
    spec = raster.spectrum_kernel(raster.partition_kernel(image, sizes, qs), sizes, qs)
    assert 1.0 < -spec["tau"][np.abs(qs).argmin()] <= 2.05
    with pytest.raises(ValueError):
        raster.lacunarity_kernel(np.zeros((8, 8), np.uint8), [2])


def test_integer_and_real_rasters_agree():
    image = (np.random.default_rng(7).random((256, 256)) < 0.05).astype(np.uint8)
    qs, sizes = np.linspace(-5, 5, 11), geometric_sizes(2, 128, 10)
    one, two = (raster.spectrum_kernel(raster.partition_kernel(x, sizes, qs, 4), sizes, qs) for x in (image, image * 0.5))
    assert all(np.abs(one[k] - two[k]).max() < 1e-9 for k in ("alpha", "tau", "f_alpha"))


def test_full_raster_keeps_the_smoothed_entropy_term():
    qs, sizes = np.arange(-2, 4.5, 0.5), [2, 4, 8, 16, 32]
    spec = raster.spectrum_kernel(raster.partition_kernel(np.ones((64, 64), np.uint8), sizes, qs, 1), sizes, qs)
    assert np.allclose([spec["tau"][np.abs(qs - q).argmin()] for q in (0, 1, 2)], [-1.8286, -0.9714, 2.1714], atol=1e-4)


def test_aggregates_equal_kernels(spark):
    image = (np.random.default_rng(3).random((32, 32)) < 0.1).astype(np.uint8)
    rows = [(0, int(r), int(c)) for r, c in zip(*np.nonzero(image))]
    pixels = spark.createDataFrame(rows, "loc long, row long, col long")
    want = {r: lam for r, lam, _, _ in raster.lacunarity_kernel(image, [2, 5, 32])}
    got = {x["r"]: x["lambda"] for x in raster.lacunarity(pixels, [2, 5, 32], 32).collect()}
    assert got.keys() == want.keys() and all(abs(got[r] - want[r]) < 1e-9 for r in want)
    z = raster.partition_kernel(image, [2, 5, 8], np.array([0.0, 1.0, 2.5]), 3)
    for x in raster.partition(pixels, [2, 5, 8], [0.0, 1.0, 2.5], 32, 3).collect():
        assert abs(x["z"] - z[[0.0, 1.0, 2.5].index(x["q"]), [2, 5, 8].index(x["r"])]) < 1e-9


def test_spectrum_windows_equal_kernel(spark):
    qs = np.arange(-3, 3.5, 0.5)
    tau = np.cumsum(np.random.default_rng(4).random(len(qs)))
    sizes = [2, 4, 8]
    z = np.exp(np.outer(tau, np.log(sizes)))
    want = raster.spectrum_kernel(z, sizes, qs)
    rows = spark.createDataFrame([(0, float(q), float(t)) for q, t in zip(qs, tau)], "series long, q double, tau double")
    got = sorted(curves.spectrum(rows).collect(), key=lambda x: x["q"])
    for k in ("tau", "alpha", "f_alpha"):
        assert np.allclose([x[k] for x in got], want[k], atol=1e-9)


TWO = [(0, 1, 5.0), (2, 3, 5.0), (1, 2, 145.0)]


def test_two_clusters():
    curve = network.percolation(TWO, 4, [0, 1, 2, 3], [1, 5, 144, 145, 200])
    assert [(c[2], c[3]) for c in curve] == [(4, 0.25), (2, 0.5), (2, 0.5), (1, 1.0), (1, 1.0)]
    assert network.percolation(TWO, 4, [0, 1, 2, 3], [1, 5, 145], "edge")[1][1:] == (2, 2, 0.5)
    with pytest.raises(ValueError):
        network.percolation([], 0, [], [1])


def test_r_crit_of_a_known_curve(spark):
    rows = spark.createDataFrame([(0, float(d), g) for d, g in zip((0, 10, 20, 30, 40), (0.0, 0.05, 0.10, 0.90, 0.95))], "series long, d double, g double")
    assert curves.max_slope(rows).first()["r_crit"] == 25.0


def test_forest_has_the_components_of_all_pairs():
    draw = random.Random(2)
    for _ in range(25):
        n = draw.randrange(4, 30)
        edges = [(a, b, float(draw.randrange(1, 60))) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.15]
        terminals = sorted(draw.sample(range(n), draw.randrange(1, n)))
        around = {i: [] for i in range(n)}
        for a, b, w in edges:
            around[a].append((b, w))
            around[b].append((a, w))
        pairs = []
        for i, s in enumerate(terminals):
            away, heap = {s: 0.0}, [(0.0, s)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > away[v]:
                    continue
                for u, w in around[v]:
                    if d + w < away.get(u, math.inf):
                        away[u] = d + w
                        heapq.heappush(heap, (d + w, u))
            pairs += [(away[t], i, j) for j, t in enumerate(terminals) if j > i and t in away]
        steps = [x + 0.5 for x in range(0, 200, 3)]
        assert network.sweep(network.distance_forest(edges, n, terminals), len(terminals), steps) == network.sweep(pairs, len(terminals), steps)


def test_network_rules():
    assert network.build([], [(0, 0)]).nodes == []
    g = network.build([(6.0, [(0, 0), (100, 0)]), (6.0, [(108, 0), (200, 0)]), (6.0, [(108, 0), (108, 50)])], [(40, 10), (40, 12), (0.4, 5)], reach=4.0)
    kinds = [n[2] for n in g.nodes]
    assert kinds.count("building") == 3
    links = {(round(g.nodes[a][0]), round(g.nodes[b][0])): (round(w, 6), k) for a, b, w, k in g.edges()}
    assert (8.0, "connection") in links.values()
    street = [i for i, n in enumerate(g.nodes) if n[2] == "road" and n[0] == 40 and n[1] == 0]
    assert len(street) == 1 and len(g.links[street[0]]) == 4
    assert (40.0, "road") in links.values() and (60.0, "road") in links.values()
    far = network.build([(1.0, [(0, 0), (10, 0)]), (1.0, [(13, 0), (20, 0)])], [], reach=1.0)
    assert len(far.edges()) == 2
    assert network.build([(1, [(0.5, 0), (1.5, 0), (2.5, 0)])], []).nodes[0][:2] == (0.0, 0.0)


def test_simple_paths():
    square = [(0, 1, 1.0), (1, 3, 1.0), (0, 2, 1.0), (2, 3, 1.1), (0, 3, 9.0)]
    assert network.simple_paths(square, 4, 0, 3) == (2, 2.0)
    assert network.simple_paths(square, 4, 0, 3, tolerance=1.0) == (1, 2.0)
    assert network.simple_paths(square, 5, 0, 4)[0] == 0
    assert network.path_diversity(square, 5, [0, 3, 4])["n_connected"] == 1


def test_local_frame_and_back():
    lon, lat = np.array([139.0, 139.01, 138.992, 139.0]), np.array([35.0, 35.004, 34.991, 35.009])
    x, y = geometry.to_local(lon, lat, 139.0, 35.0)
    assert abs(x[0]) < 1e-9 and abs(y[0]) < 1e-9
    assert abs(y[3] - 998.5) < 1.0 and abs(x[3]) < 1e-6 and abs(x[1] - 912.9) < 1.0
    back = geometry.from_local(x, y, 139.0, 35.0)
    assert np.allclose(back[0], lon, atol=1e-10) and np.allclose(back[1], lat, atol=1e-10)


def test_shapes():
    ring = np.array([(-5, -5), (15, -5), (15, 5), (-5, 5), (-5, -5)], float)
    cut = geometry.clip_ring(ring, 10.0)
    assert geometry.ring_area(cut) == 150 and geometry.centroid(cut) == (2.5, 0.0)
    assert not len(geometry.clip_ring(ring + 100, 10.0))
    parts = geometry.clip_line(np.array([(-20, 0), (0, 0), (20, 0), (20, 5), (-20, 5)], float), 10.0)
    assert [p.tolist() for p in parts] == [[[-10, 0], [0, 0], [10, 0]], [[10, 5], [-10, 5]]]
    kind, got = geometry.parse_wkb(geometry.write_wkb("polygon", [ring]))
    assert kind == "polygon" and np.array_equal(got[0][0], ring)
    line = geometry.write_wkb("line", ring[:2])
    multi = struct.pack("<BII", 1, 5, 2) + line + line
    assert [len(p) for p in geometry.parse_wkb(multi)[1]] == [2, 2] and geometry.parse_wkb(None) == ("empty", [])
    image = geometry.fill([[ring]], 10.0)
    assert image.shape == (20, 20) and image.sum() == 150 and image[5:15, 5:].all()
    hole = geometry.fill([[ring, np.array([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], float)]], 10.0)
    assert hole.sum() == 146
    band = geometry.burn_lines([(4.0, np.array([(-6.0, 0), (6.0, 0)])), (8.0, np.array([(0.0, -3), (0.0, 3)]))], 10.0)
    assert (band > 0).sum() == 12 * 4 + 8 * 6 - 8 * 4 and band.max() == 255


def test_overlay_image():
    b, r = np.zeros((100, 100), np.uint8), np.zeros((100, 100), np.uint8)
    b[40:45, 40:45], r[50, :] = 1, 200
    image = images.overlay(r, b, [(-8, 8, "building"), (0, 0, "road")], [(0, 1, 10.0, "virtual")], 50.0)
    assert (image[40:46, 40:46] == images.DOT).all(-1).any() and (image[50, 0] == images.ROAD).all()
    data = images.png(image, {"n": "1"})
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and images.image_name(35, 139) == "35.0000_139.0000.png"
    at = data.index(b"IDAT")
    size = struct.unpack(">I", data[at - 4 : at])[0]
    rows = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), np.uint8).reshape(100, 301)
    assert np.array_equal(rows[:, 1:].reshape(100, 100, 3), image)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_made_up_windows_hold_every_pixel_and_all_shifts(spark):
    from settlegrid.operators.windows import window_indicators
    from settlegrid.plans import graph_queries, views

    rows = graph_queries.made_up_windows(spark, SF_DIR).toPandas()
    built = rows[rows["id"].str.startswith("b")].groupby("lat").size().to_dict()
    pixels = views.pixels(spark, SF_DIR).toPandas()
    assert built == {35.0 + loc: n for loc, n in pixels.groupby("loc").size().items()}
    got = {r.loc_key: r for r in graph_queries.g1(spark, SF_DIR).collect()}
    key = min(got)
    want = window_indicators(rows[rows["loc_key"] == key].sort_values("id"), 64.0, most_shifts=16)
    assert got[key].d0 == round(want["d0"], 4) and got[key].n_buildings == want["n_buildings"]


def test_shapes_converted_together_are_as_each_alone():
    draw = np.random.default_rng(8)
    shapes = [draw.uniform(-70, 70, (n, 2)) for n in draw.integers(2, 9, 200)]
    group, every = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes]), np.concatenate(shapes)
    lon, lat = geometry.from_local(every[:, 0], every[:, 1], 136.0, 38.0, group)
    x, y = geometry.to_local(lon, lat, 136.0, 38.0, group)
    for i, shape in enumerate(shapes):
        own = geometry.from_local(shape[:, 0], shape[:, 1], 136.0, 38.0)
        assert np.array_equal(own, (lon[group == i], lat[group == i]))
        assert np.array_equal(geometry.to_local(*own, 136.0, 38.0), (x[group == i], y[group == i]))
    assert np.abs(x - every[:, 0]).max() < 1e-6 and np.abs(y - every[:, 1]).max() < 1e-6


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_a_window_is_converted_at_once_and_windows_are_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from settlegrid.operators import windows
    from settlegrid.plans import graph_queries

    made = graph_queries.made_up_windows(spark, SF_DIR)
    assert made.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    assert graph_queries.g1(spark, SF_DIR).select(F.spark_partition_id().alias("task")).distinct().count() > 1
    rows = made.where("loc_key = '38.0000_136.0000'").toPandas()
    calls, convert = [], geometry.to_local
    monkeypatch.setattr(geometry, "to_local", lambda *a: calls.append(len(a[0])) or convert(*a))
    polygons, lines = windows.clip_features(rows, 38.0, 136.0, 64.0)
    assert len(calls) == 1 and len(polygons) == len(rows) - 5 and len(lines) == 5


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_street_windows_are_many_tasks(spark):
    from pyspark.sql import functions as F

    from settlegrid.plans import kernel_queries

    burnt = kernel_queries.g5(spark, SF_DIR).select("n", F.spark_partition_id().alias("task")).collect()
    assert {r.n for r in burnt} == {3615} and len({r.task for r in burnt}) > 1


def test_dots_of_many_buildings_cost_their_own_pixels():
    import time

    draw = np.random.default_rng(6)
    nodes = [(float(x), float(y), "building") for x, y in [*draw.uniform(-520, 520, (3000, 2)), (-500, 500), (500, -500), (0, 0), (-502.5, 3)]]
    blank = np.zeros((1000, 1000), np.uint8)
    began = time.process_time()
    image = images.overlay(blank, blank, nodes, [], 500.0)
    assert time.process_time() - began < 4
    few = images.overlay(blank[:100, :100], blank[:100, :100], nodes[::20], [], 500.0)
    y, x = np.mgrid[:100, :100]
    near = [(x - (a + 500) / 10) ** 2 + (y - (500 - b) / 10) ** 2 <= 2.5**2 for a, b, _ in nodes[::20]]
    assert np.array_equal((few == images.DOT).all(-1), np.any(near, 0)) and (image[0, 0] == images.DOT).all()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_overlay_windows_are_many_tasks(spark):
    from pyspark.sql import functions as F

    from settlegrid.plans import kernel_queries

    assert kernel_queries.k10(spark, SF_DIR).select(F.spark_partition_id().alias("task")).distinct().count() > 1


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_networks_are_many_tasks(spark):
    from pyspark.sql import functions as F

    from settlegrid.plans import kernel_queries

    assert kernel_queries.n5(spark, SF_DIR).select(F.spark_partition_id().alias("task")).distinct().count() > 1
