"""Points stored by place, so that a query reads only what lies near it.

A layout is a folder with two tables: the points, sorted along a Z-curve over the
finest cells of their quadtree and cut into files by ranges of it, with the place
on the curve as a column; and the leaves of the tree with their counts. A select
takes its reach from the counts and turns it into a few ranges of the curve, and
into ranges of the coordinates. These are plain filters on columns, which Spark
pushes into the Parquet scan; as files hold ranges, files and row groups that
can't have such places are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import tables

#: The column with a point's place on the curve.
PLACE = "z_place"
#: Ranges of the curve in one filter, and cells an axis that a reach is cut into to find them.
RANGES, CELLS = 32, 16
#: Levels at most: 2 * 20 bits of a place, as many as numbers of leaves have.
DEEPEST = 20


def _interleaved(v: Column) -> Column:
    """The bits of a number under 2**20 with a zero before each."""
    v = v.cast("long")
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
    return v


def place(ix: Column, iy: Column) -> Column:
    """The place of a cell on the curve: its parts are next to each other on every level."""
    return _interleaved(ix).bitwiseOR(F.shiftleft(_interleaved(iy), 1))


def _filled(leaves: DataFrame, ring: Column, held: int, low: float, k: int) -> tuple[int, float, float]:
    """(points held, where the last ring begins, where it ends) when rings from near to far hold k points."""
    high = low
    rows = leaves.groupBy(ring.alias("ring")).agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()
    for r in sorted(rows, key=lambda r: r["ring"]):
        held, low, high = held + r["n"], high, max(high, r["far"])
        if held >= k:
            break
    return held, low, high


@dataclass(frozen=True)
class Layout:
    """A stored layout: its tables, the names of its columns, and the box and levels of its tree."""

    points: DataFrame
    leaves: DataFrame
    x: str
    y: str
    box: tuple[float, float, float]
    levels: int

    def _from(self, at: tuple[float, float], leaves: DataFrame) -> tuple[Column, Column]:
        """How far a leaf is from a point, and how far its farthest corner."""
        px, py, block = F.lit(float(at[0])), F.lit(float(at[1])), (F.col("bx"), F.col("by"), F.col("w"))
        return g.min_dist_point(px, py, *block), g.max_dist_point(px, py, *block)

    def size(self) -> int:
        return self.leaves.agg(F.sum("n")).first()[0] or 0

    def reach(self, at: tuple[float, float], k: int) -> float:
        """How far the k nearest points are at most, from the counts alone.

        Leaves are summed over rings of about equal ratio, and those of the ring
        that the kth point is in over rings of equal width. So some thousand rows
        come to the driver at most, whatever the tree.
        """
        _, far = self._from(at, self.leaves)
        leaves = self.leaves.select("n", far.alias("far"))
        held, low, high = _filled(leaves, F.round(F.log2(F.greatest("far", F.lit(1e-9))) * 32), 0, 0.0, k)
        if held < k:
            return high * (1 + 1e-12)
        inside = leaves.where((F.col("far") > low) & (F.col("far") <= high))
        before = leaves.where(F.col("far") <= low).agg(F.sum("n")).first()[0] or 0
        return _filled(inside, F.ceil((F.col("far") - low) / (high - low) * 512), before, low, k)[2] * (1 + 1e-12)

    def ranges(self, at: tuple[float, float], reach: float, beyond: float = -1.0) -> list[tuple[int, int]]:
        """Ranges of the curve with all points that are no farther than reach, and farther than beyond.

        Leaves are taken together by cells of about a sixteenth of the reach, so
        these are at most some thousand; the smallest gaps between them are then
        closed until RANGES are left.
        """
        near, far = self._from(at, self.leaves)
        level = 0
        while level < self.levels and self.box[2] / 2**level > reach / CELLS:
            level += 1
        shift = F.greatest(F.lit(0), F.col("level").cast("int") - level)
        up = self.leaves.where((near <= reach) & (far > beyond)).select(F.expr("least(cast(level as int), " + str(level) + ")").alias("l"), F.call_function("shiftright", "ix", shift).alias("ix"), F.call_function("shiftright", "iy", shift).alias("iy")).distinct()
        depth = F.lit(2) * (F.lit(self.levels) - F.col("l"))
        low = F.call_function("shiftleft", place(F.col("ix"), F.col("iy")), depth.cast("int"))
        found = sorted((r["low"], r["low"] + r["width"] - 1) for r in up.select(low.alias("low"), F.call_function("shiftleft", F.lit(1).cast("long"), depth.cast("int")).alias("width")).collect())
        merged: list[list[int]] = []
        for a, b in found:
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        while len(merged) > RANGES:
            i = min(range(1, len(merged)), key=lambda i: merged[i][0] - merged[i - 1][1])
            merged[i - 1 : i + 1] = [[merged[i - 1][0], merged[i][1]]]
        return [(a, b) for a, b in merged]

    def within(self, at: tuple[float, float], reach: float, beyond: float = -1.0) -> DataFrame:
        """The points no farther than reach, and farther than beyond, with d; only ranges of the curve around them are read."""
        found = self.ranges(at, reach, beyond)
        slack = reach * 1e-9 + self.box[2] * 1e-12
        box = [F.col(c).between(float(v) - reach - slack, float(v) + reach + slack) for c, v in ((self.x, at[0]), (self.y, at[1]))]
        on = F.lit(False)
        for a, b in found:
            on = on | F.col(PLACE).between(a, b)
        rows = self.points.where(on & box[0] & box[1]).drop(PLACE)
        d = g.distance(F.col(self.x), F.col(self.y), F.lit(float(at[0])), F.lit(float(at[1])))
        return rows.withColumn("d", d).where((F.col("d") <= reach) & (F.col("d") > beyond))


def write(points: DataFrame, path: str, x: str, y: str, capacity: int = 64) -> None:
    """Save points as a layout. Rows without both coordinates have no place and stay out.

    The tree is as deep as the densest place needs to get under the capacity, up
    to DEEPEST levels. The world of the tree is the box of the points.
    """
    from ..operators import join, quadtree  # these read tables of this package

    if PLACE in points.columns or "d" in points.columns:
        raise ValueError(f"points may not have columns {PLACE} or d")
    spark = points.sparkSession
    side = join.Side(points, x, x, y).located()
    low_x, low_y, world = box = join.bounds(side)
    moved = side.df.withColumns({"_mx": F.col(x) - low_x, "_my": F.col(y) - low_y})
    levels = min(DEEPEST, tables.levels_for(side.df.count(), capacity))
    while levels < DEEPEST and _densest(moved, levels, world) > capacity:
        levels = min(DEEPEST, levels + 4)
    tree = quadtree.leaves(moved, "_mx", "_my", capacity, levels, world, deepest=levels).withColumns({"bx": F.col("bx") + low_x, "by": F.col("by") + low_y})
    tree.write.mode("overwrite").parquet(f"{path}/leaves")
    cell = lambda c: g.cell(F.col(c), levels, world)
    placed = moved.withColumn(PLACE, place(cell("_mx"), cell("_my"))).drop("_mx", "_my")
    placed.repartitionByRange(PLACE).sortWithinPartitions(PLACE).write.mode("overwrite").parquet(f"{path}/points")
    spark.createDataFrame([(x, y, float(low_x), float(low_y), float(world), levels)], "x string, y string, low_x double, low_y double, world double, levels int").write.mode("overwrite").parquet(f"{path}/about")


def _densest(moved: DataFrame, levels: int, world: float) -> int:
    at = [g.cell(F.col(c), levels, world) for c in ("_mx", "_my")]
    return moved.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def read(spark: SparkSession, path: str) -> Layout:
    """A layout as write() saved it."""
    about = spark.read.parquet(f"{path}/about").first()
    return Layout(spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/leaves"), about["x"], about["y"], (about["low_x"], about["low_y"], about["world"]), about["levels"])


def nearest(stored: Layout, k: int, at: tuple[float, float], key: str, ties: str = "break") -> DataFrame:
    """The k nearest points with d, as select.nearest(), from the ranges of the layout within reach. No points give no rows."""
    near = stored.within(at, stored.reach(at, k))
    first = near.orderBy("d", key).limit(k)
    if ties == "break":
        return first
    last = first.agg(F.max("d").alias("_d"))  # one row
    return near.join(F.broadcast(last), F.col("d") <= F.col("_d")).drop("_d")


def p_knn_first(stored: Layout, keys: DataFrame, k: int, at: tuple[float, float], key: str, ties: str = "break") -> DataFrame:
    """Level P: the k nearest, then those that qualify."""
    return nearest(stored, k, at, key, ties).join(keys, key, "left_semi")


def q_knn_first(stored: Layout, keys: DataFrame, k: int, at: tuple[float, float], key: str) -> DataFrame:
    """Level Q: ring by ring, each read once, until k points qualify; what qualified nearer is kept.

    A ring is what the next 4k, 16k, ... points take by the counts.
    """
    from ..operators.join import _cut

    looked, seen, total, found = 4 * k, -1.0, stored.size(), None
    while True:
        reach = stored.reach(at, looked)
        ring = _cut(stored.within(at, reach, seen).join(keys, key, "left_semi"))
        found = ring if found is None else found.unionByName(ring)
        if looked >= total or found.limit(k).count() == k:
            return found.orderBy("d", key).limit(k)
        looked, seen = 4 * looked, reach
