"""Every indicator of every window, from its features: one grouped-map task per window.

Only geometry is shuffled; a raster lives and dies within its window's task. A
window's cost grows with its buildings, so windows should be many more than tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from settlegrid.functions.spatial import geometric_sizes, thresholds
from settlegrid.operators import geometry as g
from settlegrid.operators import network, raster

SCHEMA = "loc_key string, status string, error string, n_buildings long, n_building_nodes long, density double, count_density double, footprint_mean double, footprint_median double, road_density double, lacunarity_mean double, lacunarity_slope double, d0 double, d1 double, d2 double, delta_d double, mfa_alpha_width double, s_alpha double, r_crit double, perc_dcrit double, perc_gmax double, w_trans double, gamma double, curve_d array<double>, curve_g array<double>, curve_r array<long>, curve_lambda array<double>"


#: Least number of partitions that windows are dealt to.
DEALS = 64


def dealt(features: DataFrame, key: str) -> DataFrame:
    """``features`` by ``key`` in a fixed number of partitions: a window costs time, not bytes, so adaptive execution, which merges small partitions, would put many in one task."""
    return features.repartition(max(DEALS, int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def clip_features(rows: pd.DataFrame, lat: float, lon: float, half: float) -> tuple[list, list]:
    """Polygons (lists of rings) and ``(width, line)`` of a window in its local frame."""
    shapes = [(kind, part, width) for data, width in zip(rows["geometry"], rows["width"]) for kind, parts in [g.parse_wkb(data)] for part in parts if kind == "polygon" or (kind == "line" and len(part) > 1)]
    # All points of the window at once, each ring and each line a group.
    given = [points for kind, part, _ in shapes for points in (part if kind == "polygon" else [part])]
    sizes = [len(points) for points in given]
    every = np.concatenate([np.empty((0, 2)), *given])
    local = np.column_stack(g.to_local(every[:, 0], every[:, 1], lon, lat, np.repeat(np.arange(len(given)), sizes)))
    found = iter(np.split(local, np.cumsum(sizes)[:-1]) if given else [])
    polygons, lines = [], []
    for kind, part, width in shapes:
        if kind == "polygon":
            rings = [r for r in [g.clip_ring(next(found), half) for _ in part] if len(r)]
            if rings:
                polygons.append(rings)
        else:
            lines += [(float(width) if width == width else 5.0, x) for x in g.clip_line(next(found), half)]
    return polygons, lines


def _curve_scalars(d: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """The percolation scalars of one curve, as ``operators.curves`` defines them."""
    reach = lambda t: d[-1] if not (y >= t).any() else d[0] if y[0] >= t else np.interp(0, *_bracket(d, y, t))
    slopes = np.diff(y) / (np.diff(d) + 1e-20)
    r_crit = float((d[slopes.argmax()] + d[slopes.argmax() + 1]) * 0.5)
    crossing = np.flatnonzero((y[:-1] < 0.5) & (y[1:] >= 0.5))
    if len(crossing):
        i = crossing[0]
        dcrit = d[i] + (0.5 - y[i]) / (y[i + 1] - y[i]) * (d[i + 1] - d[i])
    else:
        dcrit = d[-1] if y[-1] < 0.5 else d[0]
    near = int(np.abs(d - r_crit).argmin())
    a, b = max(near - 1, 0), min(near + 1, len(d) - 1)
    return {"r_crit": r_crit, "perc_dcrit": float(dcrit), "perc_gmax": float(y.max()), "w_trans": float(reach(0.9) - reach(0.1)), "gamma": float((y[b] - y[a]) / (d[b] - d[a]))}


def _bracket(d: np.ndarray, y: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    i = int((y >= t).argmax())
    return np.array([y[i - 1] - t, y[i] - t]), np.array([d[i - 1], d[i]])


def window_indicators(rows: pd.DataFrame, half: float, step: float = 1.0, qs: np.ndarray | None = None, most_shifts: int = 16) -> dict:
    """All indicators of one window's features (``lat, lon, geometry, width``); raises where one is undefined."""
    polygons, lines = clip_features(rows, float(rows["lat"].iloc[0]), float(rows["lon"].iloc[0]), half)
    if not polygons and not lines:
        raise ValueError("no features in the window")
    built = g.fill(polygons, half, step)
    both = ((built > 0) | (g.burn_lines(lines, half, step) > 0)).astype(np.uint8)
    homes = [g.centroid(p[0]) for p in polygons]
    net = network.build([(w, [tuple(p) for p in line]) for w, line in lines], homes)
    top = min(built.shape)
    lac = raster.lacunarity_kernel(built, [r for r in geometric_sizes(2, top, 20)])
    lam = np.minimum.accumulate(np.maximum([x[1] for x in lac], 1.0))
    lam[-1] = 1.0
    sizes = np.array([x[0] for x in lac])
    qs = np.arange(-10, 10.25, 0.5) if qs is None else qs
    mfa_sizes = [r for r in geometric_sizes(2, top, 20) if r <= top // 2]
    spec = raster.spectrum_kernel(raster.partition_kernel(both, mfa_sizes, qs, most_shifts), mfa_sizes, qs)
    dim = lambda q: float(spec["alpha"][np.abs(qs - 1).argmin()] if q == 1 else spec["tau"][np.abs(qs - q).argmin()] / (q - 1))
    keep = spec["f_alpha"] > 0
    a, f = spec["alpha"][keep], spec["f_alpha"][keep]
    mean = np.average(a, weights=f) if keep.sum() > 2 else np.nan
    sd = np.sqrt(np.average((a - mean) ** 2, weights=f)) if keep.sum() > 2 else np.nan
    terminals = [i for i, n in enumerate(net.nodes) if n[2] == "building"]
    curve = network.percolation(net.edges(), len(net.nodes), terminals, thresholds())
    d, y = np.array([c[0] for c in curve]), np.array([c[3] for c in curve])
    area = (2 * half / 1000) ** 2
    footprints = [abs(g.ring_area(p[0])) - sum(abs(g.ring_area(h)) for h in p[1:]) for p in polygons]
    return {
        "n_buildings": len(polygons), "n_building_nodes": len(terminals), "density": float(built.mean()), "count_density": len(polygons) / area,
        "footprint_mean": float(np.mean(footprints)), "footprint_median": float(np.median(footprints)), "road_density": sum(float(np.hypot(*np.diff(x, axis=0).T).sum()) for _, x in lines) / area,
        "lacunarity_mean": float(lam.mean()), "lacunarity_slope": float(-np.polyfit(np.log(sizes), np.log(lam), 1)[0]), "d0": dim(0), "d1": dim(1), "d2": dim(2), "delta_d": dim(0) - dim(2),
        "mfa_alpha_width": float(np.ptp(spec["alpha"])), "s_alpha": 0.0 if sd == 0 else float(np.average(((a - mean) / sd) ** 3, weights=f)) if sd == sd else np.nan,
        **_curve_scalars(d, y), "curve_d": d.tolist(), "curve_g": y.tolist(), "curve_r": sizes.tolist(), "curve_lambda": lam.tolist(),
    }


def indicators(features: DataFrame, half: float = 1000.0, step: float = 1.0, most_shifts: int = 16) -> DataFrame:
    """One row per ``loc_key`` of ``features(loc_key, lat, lon, geometry, width)``; a window that fails says why and stops no other."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = dict.fromkeys(names) | {"loc_key": rows["loc_key"].iloc[0], "status": "done"}
        try:
            out |= window_indicators(rows.sort_values("id"), half, step, most_shifts=most_shifts)
        except Exception as error:
            out |= {"status": "failed", "error": f"{type(error).__name__}: {error}"[:500]}
        return pd.DataFrame([out], columns=names)

    return dealt(features, "loc_key").groupBy("loc_key").applyInPandas(run, SCHEMA)
