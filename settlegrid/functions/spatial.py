"""Scalar functions over points, boxes, keys and classes, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths in metres of road classes, and of any other: fixed values.
ROAD_WIDTHS = {"motorway": 20.0, "trunk": 15.0, "primary": 12.0, "secondary": 10.0, "tertiary": 8.0, "residential": 6.0, "service": 4.0}
ROAD_WIDTH_ELSE = 5.0


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Length of a degree of latitude and of longitude, as series in the latitude."""
    phi = F.radians(lat)
    return F.lit(111132.92) - 559.82 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi), 111412.84 * F.cos(phi) - 93.5 * F.cos(3 * phi)


def box_around(lat: Column, lon: Column, half_m: float) -> dict[str, Column]:
    per_lat, per_lon = metres_per_degree(lat)
    return {"min_lon": lon - half_m / per_lon, "min_lat": lat - half_m / per_lat, "max_lon": lon + half_m / per_lon, "max_lat": lat + half_m / per_lat}


def loc_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f_%.4f", lat, lon)


def contains(box: tuple[str, str, str, str], xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> Column:
    """The entity's box lies inside the window ``(min_lon, min_lat, max_lon, max_lat)``."""
    a, b, c, d = map(F.col, box)
    return (F.col(xmin) >= a) & (F.col(xmax) <= c) & (F.col(ymin) >= b) & (F.col(ymax) <= d)


def intersects(box: tuple[str, str, str, str], xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> Column:
    a, b, c, d = map(F.col, box)
    return (F.col(xmax) >= a) & (F.col(xmin) <= c) & (F.col(ymax) >= b) & (F.col(ymin) <= d)


def cells_over(low: Column, high: Column, halo: int = 1) -> Column:
    """Unit cells from the one of ``low`` to the one of ``high``, with a halo."""
    return F.sequence(F.floor(low).cast("int") - halo, F.floor(high).cast("int") + halo)


def cell_of(low: Column, high: Column) -> Column:
    return F.floor((low + high) / 2).cast("int")


def road_width(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROAD_WIDTHS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(ROAD_WIDTH_ELSE))


def density_band(d: Column) -> Column:
    return F.when(d < 0.0135, "sparse").when(d < 0.061, "mid").otherwise("dense")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]+", "_")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.sin((q - p) / 2) ** 2 + F.cos(p) * F.cos(q) * F.sin((F.radians(lon2) - F.radians(lon1)) / 2) ** 2
    return 2 * radius * F.asin(F.sqrt(a))


def log_clamped(x: Column, least: float) -> Column:
    return F.ln(F.greatest(x, F.lit(least)))


def top_drivers(names: tuple[str, ...], k: int = 3) -> Column:
    """The ``k`` z-scores of largest magnitude as ``name=+1.2sd``, ties in the order of ``names``."""
    each = F.array(*(F.struct(-F.abs(F.col(n)), F.lit(i), F.format_string(f"{n}=%+.1fsd", F.col(n)).alias("says")) for i, n in enumerate(names)))
    return F.array_join(F.transform(F.slice(F.array_sort(each), 1, k), lambda s: s["says"]), " ")


def describe(z: dict[str, Column]) -> Column:
    """Name of a profile of z-scores: its density word and its connection word."""
    dense = F.when(z["density"] > 0.7, "dense").when(z["density"] < -0.4, "sparse").otherwise("middling")
    joined = F.when(z["gamma"] > 0.5, "abrupt").when(z["w_trans"] > 0.5, "gradual").when(z["r_crit"] > 0.5, "split").otherwise("plain")
    return F.concat_ws(" ", dense, joined)


def geometric_sizes(low: int, high: int, steps: int) -> list[int]:
    """Distinct whole box sizes, evenly spaced in log2."""
    span = math.log2(high) - math.log2(low)
    found = [int(2 ** (math.log2(low) + span * i / (steps - 1)) + 1e-9) for i in range(steps)]
    return sorted(set(found))


def thresholds(low: float = 1.0, high: float = 2000.0, steps: int = 100) -> list[float]:
    return [low + i * ((high - low) / (steps - 1)) for i in range(steps - 1)] + [high]


def shifts(r: int, most: int = 16) -> list[int]:
    n = min(r, most)
    return [0] if n == 1 else [int((r - 1) * i / (n - 1)) for i in range(n)]
