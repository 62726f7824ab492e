"""Rasters as sparse pixels: occupancy, prefix sums, lacunarity, mass exponents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from settlegrid.operators import raster as r
from settlegrid.plans import views
from settlegrid.plans.registry import query

R = lambda column, name, n=6: F.round(column, n).alias(name)
SIZE = 128


@query("g6_combined_occupancy", "SELECT l_suppkey % 10 AS loc, count(DISTINCT ((l_partkey * 37 + l_linenumber * 11) % 128) * 128 + (l_orderkey * 29 + l_suppkey) % 128) AS n FROM lineitem WHERE l_quantity <= 8 GROUP BY 1")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel is occupied if any layer has it: union of layers, then distinct."""
    items = views.table(spark, sf_dir, "lineitem")
    layer = lambda df: df.select((F.col("l_suppkey") % 10).alias("loc"), ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 128).alias("row"), ((F.col("l_orderkey") * 29 + F.col("l_suppkey")) % 128).alias("col"))
    both = layer(items.where("l_quantity <= 5")).unionByName(layer(items.where("l_quantity > 5 and l_quantity <= 8"))).distinct()
    return both.groupBy("loc").agg(F.count("*").alias("n"))


@query("g16_density", views.sql("SELECT loc, count(*) / 16384.0::DOUBLE AS density FROM v_pix GROUP BY loc", "v_pix"))
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pixels(spark, sf_dir).groupBy("loc").agg((F.count("*") / F.lit(float(SIZE * SIZE))).alias("density"))


@query(
    "w16_prefix_sum",
    views.sql(
        """g AS (SELECT l.loc, a.i, b.j FROM (SELECT DISTINCT loc FROM v_pix) l, (SELECT unnest(range(16)) AS i) a, (SELECT unnest(range(16)) AS j) b),
        c AS (SELECT loc, row // 8 AS i, col // 8 AS j, count(*) AS n FROM v_pix GROUP BY 1, 2, 3), f AS (SELECT g.loc, g.i, g.j, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (loc, i, j)),
        h AS (SELECT loc, i, j, sum(n) OVER (PARTITION BY loc, i ORDER BY j) AS n FROM f) SELECT loc, i, j, CAST(sum(n) OVER (PARTITION BY loc, j ORDER BY i) AS BIGINT) AS total FROM h""",
        "v_pix",
    ),
)
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integral image of counts in cells of 8 pixels: running sums along rows, then along columns."""
    pix = views.pixels(spark, sf_dir)
    cells = pix.groupBy("loc", F.floor(F.col("row") / 8).alias("i"), F.floor(F.col("col") / 8).alias("j")).agg(F.count("*").alias("n"))
    span = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))
    grid = pix.select("loc").distinct().select("loc", span.alias("i")).select("loc", "i", span.alias("j"))
    full = grid.join(cells, ["loc", "i", "j"], "left").fillna(0, ["n"])
    along = full.withColumn("n", F.sum("n").over(Window.partitionBy("loc", "i").orderBy("j")))
    return along.select("loc", "i", "j", F.sum("n").over(Window.partitionBy("loc", "j").orderBy("i")).alias("total"))


def _glide_sql(size: int) -> str:
    return f"""a{size} AS (SELECT loc, row, c0, count(*) AS m FROM (SELECT loc, row, unnest(generate_series(greatest(0, col - {size - 1}), least(col, {SIZE - size}))) AS c0 FROM v_pix) GROUP BY ALL),
    b{size} AS (SELECT loc, r0, c0, sum(m) AS mass FROM (SELECT loc, c0, m, unnest(generate_series(greatest(0, row - {size - 1}), least(row, {SIZE - size}))) AS r0 FROM a{size}) GROUP BY loc, r0, c0),
    s{size} AS (SELECT loc, {size} AS r, sum(mass)::DOUBLE / {(SIZE - size + 1) ** 2} AS mu, sum(mass * mass)::DOUBLE / {(SIZE - size + 1) ** 2} AS sq FROM b{size} GROUP BY loc)"""


@query("i1_lacunarity", views.sql(", ".join(map(_glide_sql, (2, 4, 8, 16))) + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM s{n}" for n in (2, 4, 8, 16)) + ') SELECT loc, r, round(1 + (sq - mu * mu) / (mu * mu), 6) AS "lambda", round(mu, 6) AS mu FROM u', "v_pix"))
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.lacunarity(views.pixels(spark, sf_dir), [2, 4, 8, 16], SIZE).select("loc", "r", R("lambda", "lambda"), R("mu", "mu"))


def _boxes_sql(size: int) -> str:
    from settlegrid.functions.spatial import shifts

    at = ", ".join(map(str, shifts(size, 4)))
    return f"""h{size} AS (SELECT loc, x.dx, y.dy, (row - dy) // {size} AS i, (col - dx) // {size} AS j FROM v_pix, (SELECT unnest([{at}]) AS dx) x, (SELECT unnest([{at}]) AS dy) y WHERE row >= dy AND col >= dx),
    m{size} AS (SELECT h.loc, dx, dy, count(*)::DOUBLE / any_value(t.n) AS m FROM h{size} h JOIN tot t USING (loc) WHERE i < ({SIZE} - dy) // {size} AND j < ({SIZE} - dx) // {size} GROUP BY h.loc, dx, dy, i, j),
    z{size} AS (SELECT loc, {size} AS r, dx, dy, sum(m ** 0.0::DOUBLE) AS z0, exp(-sum(m * ln(m))) AS z1, sum(m ** 2.0::DOUBLE) AS z2 FROM m{size} GROUP BY loc, dx, dy)"""


SIZES = (2, 4, 8, 16, 32)
PARTITION = "tot AS (SELECT loc, count(*) AS n FROM v_pix GROUP BY loc), " + ", ".join(map(_boxes_sql, SIZES)) + ", zs AS (" + " UNION ALL ".join(f"SELECT loc, r, {q}.0::DOUBLE AS q, avg(z{q}) AS z FROM z{n} GROUP BY loc, r" for n in SIZES for q in (0, 1, 2)) + ")"


@query("i3_partition_sums", views.sql(f"{PARTITION} SELECT loc, r, q, round(z, 6) AS z FROM zs", "v_pix"))
def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.partition(views.pixels(spark, sf_dir), list(SIZES), [0.0, 1.0, 2.0], SIZE, 4).select("loc", "r", "q", R("z", "z"))


@query("i4_mass_exponents", views.sql(f"{PARTITION} SELECT loc, q, round(regr_slope(ln(z), ln(r)), 6) AS tau, round(regr_r2(ln(z), ln(r)), 6) AS r2 FROM zs GROUP BY loc, q", "v_pix"))
def i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.mass_exponents(r.partition(views.pixels(spark, sf_dir), list(SIZES), [0.0, 1.0, 2.0], SIZE, 4)).select("loc", "q", R("tau", "tau"), R("r2", "r2"))
