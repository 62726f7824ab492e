"""Measures of rings and lines held as arrays of ``struct<x, y>``, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(ring: str, each: str) -> str:
    """Sum of ``each`` over the steps p -> q of a ring, moved so that its first point is the origin."""
    return f"aggregate(sequence(1, size({ring}) - 1), 0.0D, (s, i) -> s + {each})".replace("PX", f"({ring}[i - 1].x - {ring}[0].x)").replace("PY", f"({ring}[i - 1].y - {ring}[0].y)").replace("QX", f"({ring}[i].x - {ring}[0].x)").replace("QY", f"({ring}[i].y - {ring}[0].y)")


def ring_area(ring: str) -> Column:
    return F.expr(f"abs({_steps(ring, 'PX * QY - QX * PY')}) / 2")


def ring_length(ring: str) -> Column:
    return F.expr(_steps(ring, "sqrt((QX - PX) * (QX - PX) + (QY - PY) * (QY - PY))"))


def ring_centroid(ring: str) -> tuple[Column, Column]:
    """Area-weighted centroid; the first point for a ring without area."""
    twice = _steps(ring, "PX * QY - QX * PY")
    x, y = (_steps(ring, f"(P{c} + Q{c}) * (PX * QY - QX * PY)") for c in "XY")
    return tuple(F.expr(f"if({twice} = 0, {ring}[0].{c}, {ring}[0].{c} + {v} / (3 * {twice}))") for c, v in (("x", x), ("y", y)))
