"""Distances between points and axis-aligned square blocks, as Column expressions.

A block is (bx, by, w): its low corner and width. Differences are multiplied,
not raised to a power, so whole-numbered coordinates give exact sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance of two points."""
    return norm(x1 - x2, y1 - y2)


def _gap(x: Column, low: Column, w: Column) -> Column:
    return F.greatest(low - x, x - (low + w), F.lit(0.0))


def _reach(x: Column, low: Column, w: Column) -> Column:
    return F.greatest(F.abs(x - low), F.abs(low + w - x))


def min_dist_point(x: Column, y: Column, bx: Column, by: Column, w: Column) -> Column:
    """Distance from a point to the nearest point of a block; 0 inside."""
    return norm(_gap(x, bx, w), _gap(y, by, w))


def max_dist_point(x: Column, y: Column, bx: Column, by: Column, w: Column) -> Column:
    """Distance from a point to the farthest corner of a block."""
    return norm(_reach(x, bx, w), _reach(y, by, w))


def min_dist_block(ax: Column, ay: Column, aw: Column, bx: Column, by: Column, bw: Column) -> Column:
    """Least distance of any two points of two blocks."""
    gap = lambda a, wa, b, wb: F.greatest(a - (b + wb), b - (a + wa), F.lit(0.0))
    return norm(gap(ax, aw, bx, bw), gap(ay, aw, by, bw))


def max_dist_block(ax: Column, ay: Column, aw: Column, bx: Column, by: Column, bw: Column) -> Column:
    """Largest distance of any two points of two blocks."""
    reach = lambda a, wa, b, wb: F.greatest(F.abs(a - (b + wb)), F.abs(b - (a + wa)))
    return norm(reach(ax, aw, bx, bw), reach(ay, aw, by, bw))


def overlaps(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Whether two closed rectangles share a point."""
    return (ax <= bx + bw) & (bx <= ax + aw) & (ay <= by + bh) & (by <= ay + ah)


def cell(x: Column, level: Column | int, world: float) -> Column:
    """Index of x among the 2**level cells of [0, world); a point on a border belongs to the lower cell."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.greatest(F.ceil(x / (F.lit(float(world)) / F.pow(F.lit(2.0), level))) - 1, F.lit(0)).cast("long")
