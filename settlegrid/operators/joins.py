"""Spatial and ordered joins that Catalyst would otherwise plan as nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlegrid.functions.spatial import cells_over

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
#: Up to this many boxes a broadcast nested loop is cheaper than spreading boxes over cells.
STATIC_BOXES = 200


def box_cells(boxes: DataFrame) -> DataFrame:
    """Boxes once per unit cell they may meet, ``cell_x, cell_y`` added."""
    spread = boxes.withColumn("cell_x", F.explode(cells_over(F.col("min_lon"), F.col("max_lon"))))
    return spread.withColumn("cell_y", F.explode(cells_over(F.col("min_lat"), F.col("max_lat"))))


def static_join(entities: DataFrame, boxes: DataFrame, condition: Column) -> DataFrame:
    """Entities against a few boxes. The envelope of all boxes is a literal filter that reaches the scan."""
    seen = boxes.agg(F.min("min_lon"), F.min("min_lat"), F.max("max_lon"), F.max("max_lat"), F.count("*")).first()
    if not seen[4]:
        return entities.join(boxes, F.lit(False))
    if seen[4] > STATIC_BOXES:
        raise ValueError(f"{seen[4]} boxes are too many to broadcast; use grid_join")
    near = entities.where((F.col("xmax") >= seen[0]) & (F.col("ymax") >= seen[1]) & (F.col("xmin") <= seen[2]) & (F.col("ymin") <= seen[3]))
    return near.join(F.broadcast(boxes), condition)


def static_join_in_blocks(entities: DataFrame, boxes: DataFrame, condition: Column, key: str) -> DataFrame:
    """``static_join`` for any number of boxes: the boxes, cut by their distinct ``key``, take turns in blocks of ``STATIC_BOXES``.

    One scan of the entities a block, so for many boxes ``grid_join`` is the better way to the same rows.
    """
    keys = [r[0] for r in boxes.select(key).orderBy(key).toLocalIterator()]
    blocks = [boxes.where(F.col(key).between(keys[i], keys[min(i + STATIC_BOXES, len(keys)) - 1])) for i in range(0, len(keys), STATIC_BOXES)]
    found = entities.join(boxes, F.lit(False))
    for block in blocks:
        found = found.unionByName(static_join(entities, block, condition))
    return found


def grid_join(entities: DataFrame, boxes: DataFrame, condition: Column) -> DataFrame:
    """The same rows through an equi-join: an entity, however wide, has all cells that it covers, boxes theirs and a halo.

    A pair whose boxes meet does so in the cell of its south-west corner, the
    greater of the two least coordinates; only there it counts, so no pair comes twice.
    """
    floor = lambda c: F.floor(F.col(c)).cast("int")
    placed = entities.withColumn("cell_x", F.explode(F.sequence(floor("xmin"), floor("xmax")))).withColumn("cell_y", F.explode(F.sequence(floor("ymin"), floor("ymax"))))
    once = (F.col("cell_x") == F.floor(F.greatest("xmin", "min_lon"))) & (F.col("cell_y") == F.floor(F.greatest("ymin", "min_lat")))
    return placed.join(box_cells(boxes), ["cell_x", "cell_y"]).where(once & condition).drop("cell_x", "cell_y")


def window_join(entities: DataFrame, boxes: DataFrame, condition: Column) -> DataFrame:
    """Static for up to ``STATIC_BOXES`` boxes, by grid beyond."""
    few = len(boxes.limit(STATIC_BOXES + 1).select(F.lit(1)).collect()) <= STATIC_BOXES
    return (static_join if few else grid_join)(entities, boxes, condition)


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in an order that the caller makes total."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def within_distance(points: DataFrame, distance: float, *, key: str = "id") -> DataFrame:
    """Unordered pairs of points closer than ``distance``: ``i, j, dist``, each once with i < j.

    Points are hashed to squares of that side; each meets its own square and the
    eight around it, so no more than neighbours are ever compared.
    """
    at = points.select(F.col(key).alias("id"), "x", "y", F.floor(F.col("x") / distance).cast("long").alias("cx"), F.floor(F.col("y") / distance).cast("long").alias("cy"))
    around = F.explode(F.array(*(F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    spread = at.select(F.col("id").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), around.alias("c")).select("j", "x2", "y2", "c.cx", "c.cy")
    dist = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    return at.join(spread, ["cx", "cy"]).where(F.col("id") < F.col("j")).select(F.col("id").alias("i"), "j", dist.alias("dist")).where(F.col("dist") <= distance)


def nearest_segment(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """For each point its nearest segment within ``reach``: ``id, seg, dist, px, py``; ties go to the least ``seg``.

    Segments (``seg, x1, y1, x2, y2``) lie in every square their box touches; a
    point looks into its square and those around it.
    """
    square = lambda c: F.floor(F.col(c) / reach).cast("long")
    lo = lambda a, b: F.floor(F.least(a, b) / reach).cast("long") - 1
    hi = lambda a, b: F.floor(F.greatest(a, b) / reach).cast("long") + 1
    spread = segments.withColumn("cx", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2")))).withColumn("cy", F.explode(F.sequence(lo("y1", "y2"), hi("y1", "y2"))))
    met = points.withColumn("cx", square("x")).withColumn("cy", square("y")).join(spread, ["cx", "cy"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / size))).otherwise(F.lit(0.0))
    met = met.withColumn("px", F.col("x1") + t * dx).withColumn("py", F.col("y1") + t * dy)
    met = met.withColumn("dist", F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)).where(F.col("dist") <= reach)
    best = met.groupBy("id").agg(F.min(F.struct("dist", "seg", "px", "py")).alias("best"))
    return best.select("id", "best.seg", "best.dist", "best.px", "best.py")


def band_pairs(rows: DataFrame, by: str, reach: int, relative: float, *, group: str | None = None, key: str = "id") -> DataFrame:
    """Pairs of rows at most ``reach`` ranks apart in the order of ``by`` and ``relative`` of their mean apart.

    Columns of the two come as ``<name>_i`` and ``<name>_j``. Ranks fall into
    blocks of ``reach``, which makes the rank range an equi-join of each block with itself and the next.
    """
    order = Window.orderBy(by, key) if group is None else Window.partitionBy(group).orderBy(by, key)
    ranked = rows.withColumn("rn", F.row_number().over(order)).withColumn("block", F.floor(F.col("rn") / reach).cast("long"))
    left = ranked.select(*(F.col(c).alias(f"{c}_i") for c in ranked.columns))
    right = ranked.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") - 1)))
    right = right.select(*(F.col(c).alias(f"{c}_j") for c in ranked.columns))
    same = F.col("block_i") == F.col("block_j")
    if group is not None:
        same = same & (F.col(f"{group}_i") == F.col(f"{group}_j"))
    gap = F.col("rn_j") - F.col("rn_i")
    near = F.try_divide(F.abs(F.col(f"{by}_i") - F.col(f"{by}_j")), (F.col(f"{by}_i") + F.col(f"{by}_j")) / 2) <= relative
    return left.join(right, same & (gap >= 1) & (gap <= reach) & near).drop("block_i", "block_j")


def point_in_polygon(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Pairs ``id, country`` of points inside polygons, by crossing counts over their edges.

    ``rings`` has ``country, x1, y1, x2, y2``, an edge per row. Points meet only the
    edges in the unit strip of their y, an equi-join.
    """
    low, high = F.floor(F.least("y1", "y2")).cast("int"), F.floor(F.greatest("y1", "y2")).cast("int")
    strips = rings.withColumn("strip", F.explode(F.sequence(low, high)))
    met = points.withColumn("strip", F.floor("y").cast("int")).join(strips, "strip")
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    counted = met.where(crosses).groupBy("id", "country").agg(F.count("*").alias("n"))
    return counted.where("n % 2 = 1").select("id", "country")
