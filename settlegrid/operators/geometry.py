"""Geometry kernels in numpy: WKB, azimuthal equidistant frames, clipping, rasterising."""

from __future__ import annotations

import math
import struct

import numpy as np

#: WGS84 semi-axis and flattening: fixed values.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
POLE = AXIS * (1 - FLATTENING)

Ring = np.ndarray


def parse_wkb(data: bytes | None) -> tuple[str, list]:
    """Kind and parts: ``polygon`` with lists of rings, ``line`` with point arrays, ``point``; ``empty`` for null, others and what can't be read.

    Multi-part kinds and collections give the parts of the kind they start with.
    """
    if not data:
        return "empty", []
    try:
        kind, parts, _ = _read(data, 0)
    except (struct.error, IndexError, ValueError, KeyError):
        return "empty", []
    return kind, parts


def _read(data: bytes, at: int) -> tuple[str, list, int]:
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    width = 2 + (code // 1000 in (1, 3) or bool(code & 0x80000000)) + (code // 1000 in (2, 3) or bool(code & 0x40000000))
    if code & 0x20000000:
        at += 4
    code = (code & 0xFF) % 1000

    def points(n: int, at: int) -> tuple[np.ndarray, int]:
        found = np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)[:, :2].astype(float)
        return found, at + 8 * n * width

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if code == 1:
        p, at = points(1, at)
        return "point", [p[0]], at
    if code == 2:
        n, at = count(at)
        p, at = points(n, at)
        return ("line", [p], at) if n else ("empty", [], at)
    if code == 3:
        n, at = count(at)
        rings = []
        for _ in range(n):
            k, at = count(at)
            p, at = points(k, at)
            rings.append(p)
        return ("polygon", [rings], at) if rings else ("empty", [], at)
    if code in (4, 5, 6, 7):
        n, at = count(at)
        kind, parts = "empty", []
        for _ in range(n):
            k, more, at = _read(data, at)
            if kind in ("empty", k) and k != "empty":
                kind, parts = k, parts + more
        return kind, parts, at
    raise ValueError(f"WKB kind {code} is not read")


def write_wkb(kind: str, points: list) -> bytes:
    """A line of points or a polygon of rings."""
    pack = lambda p: struct.pack("<I", len(p)) + np.asarray(p, "<f8").tobytes()
    if kind == "line":
        return struct.pack("<BI", 1, 2) + pack(points)
    return struct.pack("<BII", 1, 3, len(points)) + b"".join(map(pack, points))


def _open(settled: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which points belong to a group that has a point not settled."""
    return np.bincount(group[~settled], minlength=int(group.max()) + 1)[group] > 0


def to_local(lon: np.ndarray, lat: np.ndarray, lon0: float, lat0: float, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north in the azimuthal equidistant frame of a point: geodesic length and azimuth, by Vincenty's inverse series.

    Points are iterated until all of their ``group`` (whole numbers from 0; null: all are one) settle, so shapes
    converted together get the values that each gets alone.
    """
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    shape = np.broadcast_shapes(lon.shape, lat.shape)
    lon, lat = np.broadcast_to(lon, shape).ravel(), np.broadcast_to(lat, shape).ravel()
    if not lon.size:
        return np.empty(shape), np.empty(shape)
    group = np.zeros(lon.size, np.int64) if group is None else group
    u1, u2 = math.atan((1 - FLATTENING) * math.tan(math.radians(lat0))), np.arctan((1 - FLATTENING) * np.tan(np.radians(lat)))
    wide = np.radians((lon - lon0 + 180) % 360 - 180)
    s1, c1, s2, c2 = math.sin(u1), math.cos(u1), np.sin(u2), np.cos(u2)
    lam, at = wide.copy(), np.arange(lon.size)
    ss, cs, sigma, ca2, cm = np.empty((5, lon.size))
    for _ in range(60):
        sl, cl, s2_at, c2_at = np.sin(lam[at]), np.cos(lam[at]), s2[at], c2[at]
        ss_at = np.hypot(c2_at * sl, c1 * s2_at - s1 * c2_at * cl)
        cs_at = s1 * s2_at + c1 * c2_at * cl
        sigma_at = np.arctan2(ss_at, cs_at)
        sa = np.divide(c1 * c2_at * sl, ss_at, out=np.zeros_like(ss_at), where=ss_at > 0)
        ca2_at = 1 - sa**2
        cm_at = np.where(ca2_at > 1e-15, cs_at - 2 * s1 * s2_at / np.where(ca2_at > 1e-15, ca2_at, 1), 0.0)
        k = FLATTENING / 16 * ca2_at * (4 + FLATTENING * (4 - 3 * ca2_at))
        new = wide[at] + (1 - k) * FLATTENING * sa * (sigma_at + k * ss_at * (cm_at + k * cs_at * (2 * cm_at**2 - 1)))
        settled = np.abs(new - lam[at]) < 1e-13
        lam[at], ss[at], cs[at], sigma[at], ca2[at], cm[at] = new, ss_at, cs_at, sigma_at, ca2_at, cm_at
        at = at[_open(settled, group[at])]
        if not at.size:
            break
    usq = ca2 * (AXIS**2 - POLE**2) / POLE**2
    a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
    b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
    delta = b * ss * (cm + b / 4 * (cs * (2 * cm**2 - 1) - b / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
    length = POLE * a * (sigma - delta)
    azimuth = np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
    return (length * np.sin(azimuth)).reshape(shape), (length * np.cos(azimuth)).reshape(shape)


def from_local(x: np.ndarray, y: np.ndarray, lon0: float, lat0: float, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``to_local``, by fixed-point steps in degrees; for windows of some tens of kilometres.

    A group is left as soon as a step no longer changes it: all later steps would be the same.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    shape = np.broadcast_shapes(x.shape, y.shape)
    x, y = np.broadcast_to(x, shape).ravel(), np.broadcast_to(y, shape).ravel()
    if not x.size:
        return np.empty(shape), np.empty(shape)
    group = np.zeros(x.size, np.int64) if group is None else group
    per_lat, per_lon = 111132.92, 111412.84 * math.cos(math.radians(lat0))
    lon, lat, at = lon0 + x / per_lon, lat0 + y / per_lat, np.arange(x.size)
    for _ in range(30):
        gx, gy = to_local(lon[at], lat[at], lon0, lat0, group[at])
        east, north = lon[at] + (x[at] - gx) / per_lon, lat[at] + (y[at] - gy) / per_lat
        same = (east == lon[at]) & (north == lat[at])
        near = np.hypot(x[at] - gx, y[at] - gy) < 1e-9
        lon[at], lat[at] = east, north
        at = at[_open(near, group[at]) & _open(same, group[at])]
        if not at.size:
            break
    return lon.reshape(shape), lat.reshape(shape)


def clip_ring(ring: Ring, half: float) -> Ring:
    """The part of a ring inside the square of side ``2 half`` around the origin, side after side (Sutherland and Hodgman)."""
    out = np.asarray(ring, float)
    if len(out) > 1 and np.array_equal(out[0], out[-1]):
        out = out[:-1]
    inside = len(out) and np.abs(out).max() <= half
    for axis, sign in ((0, 1), (0, -1), (1, 1), (1, -1)):
        if inside or not len(out):
            break
        depth = half - sign * out[:, axis]
        nxt, depth_next = np.roll(out, -1, 0), np.roll(depth, -1)
        kept = []
        for p, q, d, e in zip(out, nxt, depth, depth_next):
            if d >= 0:
                kept.append(p)
            if (d >= 0) != (e >= 0):
                kept.append(p + (q - p) * (d / (d - e)))
        out = np.array(kept).reshape(len(kept), 2)
    return np.vstack([out, out[:1]]) if len(out) > 2 else np.empty((0, 2))


def clip_line(line: np.ndarray, half: float) -> list[np.ndarray]:
    """The parts of a line inside the square (Liang and Barsky); parts of one point are left out."""
    parts, current = [], []
    for p, q in zip(line, line[1:]):
        d, low, high = q - p, 0.0, 1.0
        for axis in (0, 1):
            for t, n in ((-d[axis], p[axis] + half), (d[axis], half - p[axis])):
                if t == 0:
                    low = low if n >= 0 else 2.0
                elif t < 0:
                    low = max(low, n / t)
                else:
                    high = min(high, n / t)
        if low > high:
            parts, current = parts + [current], []
            continue
        a, b = p + low * d, p + high * d
        if current and not np.allclose(current[-1], a):
            parts, current = parts + [current], []
        current = (current or [a]) + [b]
        if high < 1:
            parts, current = parts + [current], []
    return [np.array(x) for x in [*parts, current] if len(x) > 1 and np.ptp(np.array(x), axis=0).any()]


def ring_area(ring: Ring) -> float:
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def centroid(ring: Ring) -> tuple[float, float]:
    x, y = (ring - ring[0]).T
    cross = x[:-1] * y[1:] - x[1:] * y[:-1]
    if cross.sum() == 0:
        return tuple(ring[:-1].mean(0)) if len(ring) > 1 else tuple(ring[0])
    return float(ring[0, 0] + ((x[:-1] + x[1:]) * cross).sum() / (3 * cross.sum())), float(ring[0, 1] + ((y[:-1] + y[1:]) * cross).sum() / (3 * cross.sum()))


def fill(rings: list[list[Ring]], half: float, step: float = 1.0) -> np.ndarray:
    """0/1 raster of polygons, row 0 in the north: a pixel counts if its centre is inside by the even-odd rule."""
    size = int(2 * half / step)
    out = np.zeros((size, size), np.uint8)
    centre = -half + (np.arange(size) + 0.5) * step
    for polygon in rings:
        edges = np.vstack([np.hstack([r[:-1], r[1:]]) for r in polygon if len(r) > 3] or [np.empty((0, 4))])
        if not len(edges):
            continue
        low, high = edges[:, [1, 3]].min(), edges[:, [1, 3]].max()
        for row in range(max(0, int((half - high) / step) - 1), min(size, int((half - low) / step) + 2)):
            y = half - (row + 0.5) * step
            x1, y1, x2, y2 = edges[(edges[:, 1] > y) != (edges[:, 3] > y)].T
            cuts = np.sort(x1 + (y - y1) / (y2 - y1) * (x2 - x1))
            for a, b in zip(cuts[::2], cuts[1::2]):
                out[row, np.searchsorted(centre, a, "left") : np.searchsorted(centre, b, "left")] = 1
    return out


def burn_lines(lines: list[tuple[float, np.ndarray]], half: float, step: float = 1.0) -> np.ndarray:
    """Lines as flat-ended bands of their width; intensity 50 to 255 by width, added where bands overlap, at most 255."""
    size = int(2 * half / step)
    out = np.zeros((size, size), np.int64)
    widest = max((w for w, _ in lines), default=1.0)
    for width, points in lines:
        mark = np.zeros((size, size), bool)
        for p, q in zip(points, points[1:]):
            length = math.dist(p, q)
            if not length:
                continue
            c0, c1 = (int(np.clip(np.floor((f(p[0], q[0]) + s * width / 2 + half) / step) + s, 0, size)) for f, s in ((min, -1), (max, 1)))
            r0, r1 = (int(np.clip(np.floor((half - f(p[1], q[1]) + s * width / 2) / step) + s, 0, size)) for f, s in ((max, -1), (min, 1)))
            x, y = -half + (np.arange(c0, c1) + 0.5) * step, half - (np.arange(r0, r1) + 0.5) * step
            ux, uy = (q[0] - p[0]) / length, (q[1] - p[1]) / length
            along = (x[None, :] - p[0]) * ux + (y[:, None] - p[1]) * uy
            across = np.abs((x[None, :] - p[0]) * uy - (y[:, None] - p[1]) * ux)
            mark[r0:r1, c0:c1] |= (along >= 0) & (along <= length) & (across <= width / 2)
        out += mark * max(50, int(min(255, width / widest * 255)))
    return np.minimum(out, 255).astype(np.uint8)
