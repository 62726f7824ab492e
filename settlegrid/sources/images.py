"""Overlay images of a window as PNG bytes, with the standard library only."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Colours of the layers: fixed values.
ROAD, BUILDING, EDGE, VIRTUAL, DOT = (208, 208, 208), (105, 105, 105), (0, 90, 230), (120, 190, 255), (230, 30, 30)


def png(image: np.ndarray, notes: dict[str, str] | None = None) -> bytes:
    """An RGB array as PNG, with text notes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width = image.shape[:2]
    rows = np.hstack([np.zeros((height, 1), np.uint8), image.reshape(height, width * 3)]).tobytes()
    text = b"".join(chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1", "replace")) for k, v in (notes or {}).items())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + text + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def overlay(roads: np.ndarray, buildings: np.ndarray, nodes: list, edges: list, half: float) -> np.ndarray:
    """Roads under buildings under edges (street edges two pixels wide, virtual ones one) under building dots."""
    image = np.full((*roads.shape, 3), 255, np.uint8)
    image[roads > 0] = ROAD
    image[buildings > 0] = BUILDING
    scale = roads.shape[0] / (2 * half)
    at = lambda n: ((nodes[n][0] + half) * scale, (half - nodes[n][1]) * scale)
    for virtual in (False, True):
        for a, b, _, kind in edges:
            if (kind == "virtual") == virtual:
                _stroke(image, at(a), at(b), 1 if virtual else 2, VIRTUAL if virtual else EDGE)
    height, width = image.shape[:2]
    for n, node in enumerate(nodes):
        if node[2] == "building":
            cx, cy = at(n)
            # Only the pixels around the dot: a mask of the whole image for each building costs buildings times pixels.
            (left, right), (top, bottom) = ((max(0, int(c) - 4), min(size, int(c) + 5)) for c, size in ((cx, width), (cy, height)))
            if left < right and top < bottom:
                y, x = np.ogrid[top:bottom, left:right]
                image[top:bottom, left:right][(x - cx) ** 2 + (y - cy) ** 2 <= 2.5**2] = DOT
    return image


def _stroke(image: np.ndarray, p: tuple, q: tuple, width: int, colour: tuple) -> None:
    n = int(max(abs(q[0] - p[0]), abs(q[1] - p[1]))) + 2
    xs, ys = np.linspace(p[0], q[0], n).astype(int), np.linspace(p[1], q[1], n).astype(int)
    for k in range(width):
        ok = (xs + k >= 0) & (xs + k < image.shape[1]) & (ys >= 0) & (ys < image.shape[0])
        image[ys[ok], xs[ok] + k] = colour


def image_name(lat: float, lon: float) -> str:
    return f"{lat:.4f}_{lon:.4f}.png"
