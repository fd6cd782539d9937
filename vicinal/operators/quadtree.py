"""Point quadtrees as tables of leaves.

A cell (level, ix, iy) is a leaf if it holds 1 to capacity points and its parent
more than capacity; at the last level any cell under such a parent is one. The
shape doesn't depend on the order of insertion, so counts per cell give it.
Cells of FIRST_LEVELS levels are counted over all points. Those that are still
over capacity, at most 4**FIRST_LEVELS of them, have their points counted in the
cells of the deepest level too, so that a cluster is divided as far as numbers of
leaves allow. Coarser levels are counted from finer ones.

Points beyond the world have no leaf: placed() counts them and assign() can give
them a null one. Points without both coordinates count as unplaced. Points may
have any other columns but those named `_fx`, `_fy` or like the leaf's; repeated
points are points each; without points there are no leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.tables import WORLD

#: The levels counted over all points, the deepest that a crowded cell is divided to, and points of a block before it is split.
FIRST_LEVELS, DEEPEST, CAPACITY = 8, 20, 64


def _within(x: str, y: str, world: float) -> Column:
    return F.coalesce((F.col(x) >= 0) & (F.col(x) < world) & (F.col(y) >= 0) & (F.col(y) < world), F.lit(False))


def inside(points: DataFrame, x: str, y: str, world: float = WORLD) -> DataFrame:
    """The points within the half-open world box."""
    return points.where(_within(x, y, world))


def placed(points: DataFrame, x: str, y: str, world: float = WORLD) -> DataFrame:
    """One row (n_inside, n_outside, n_unplaced): points in the world, beyond it, and without both coordinates."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    kind = F.when(~(known(x) & known(y)), 2).when(_within(x, y, world), 0).otherwise(1)
    return points.select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == i).alias(name) for i, name in enumerate(("n_inside", "n_outside", "n_unplaced"))])


def _coarser(finest: DataFrame, first: int, last: int) -> DataFrame:
    """(level, ix, iy, n) of the levels from first to last, from counts of the last."""
    up = finest.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level"), "ix", "iy", "n")
    shift = F.expr(f"shiftright(ix, {last} - level)"), F.expr(f"shiftright(iy, {last} - level)")
    return up.select("level", shift[0].alias("ix"), shift[1].alias("iy"), "n").groupBy("level", "ix", "iy").agg(F.sum("n").alias("n"))


def cells(points: DataFrame, x: str, y: str, capacity: int = CAPACITY, levels: int = FIRST_LEVELS, world: float = WORLD, deepest: int = DEEPEST) -> DataFrame:
    """(level, ix, iy, n) of all cells that hold points, down to `levels`; under cells that are then over capacity, down to `deepest`."""
    at = lambda level: (g.cell(F.col(x), level, world).alias("ix"), g.cell(F.col(y), level, world).alias("iy"))
    points = inside(points, x, y, world)
    finest = points.groupBy(*at(levels)).agg(F.count(F.lit(1)).alias("n"))
    every = _coarser(finest, 0, levels)
    if deepest <= levels:
        return every
    crowded = finest.where(F.col("n") > capacity).select(F.col("ix").alias("px"), F.col("iy").alias("py"))
    if levels <= FIRST_LEVELS:
        crowded = F.broadcast(crowded)  # 4**levels rows at most
    deep = points.select(*at(deepest)).withColumns({"px": F.shiftright("ix", deepest - levels), "py": F.shiftright("iy", deepest - levels)})
    deep = deep.join(crowded, ["px", "py"], "left_semi").groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    return every.unionByName(_coarser(deep, levels + 1, deepest))


def leaves(points: DataFrame, x: str, y: str, capacity: int = CAPACITY, levels: int = FIRST_LEVELS, world: float = WORLD, deepest: int = DEEPEST) -> DataFrame:
    """(leaf, level, ix, iy, n, bx, by, w) of the non-empty leaves; leaf numbers all cells of all levels.

    Only at the deepest level a leaf may hold more than capacity: points that lie
    within a world / 2**deepest of each other.
    """
    every, last = cells(points, x, y, capacity, levels, world, deepest), max(levels, deepest)
    parents = every.where((F.col("level") < last) & (F.col("n") > capacity)).select((F.col("level") + 1).alias("level"), F.col("ix").alias("px"), F.col("iy").alias("py"))
    below = every.withColumns({"px": F.floor(F.col("ix") / 2).cast("long"), "py": F.floor(F.col("iy") / 2).cast("long")})
    small = (F.col("n") <= capacity) | (F.col("level") == last)
    found = below.where((F.col("level") > 0) & small).join(parents, ["level", "px", "py"], "left_semi").unionByName(below.where((F.col("level") == 0) & small))
    side = F.lit(float(world)) / F.pow(F.lit(2.0), F.col("level"))
    return found.select(leaf_id(F.col("level"), F.col("ix"), F.col("iy")).alias("leaf"), "level", "ix", "iy", "n", (F.col("ix") * side).alias("bx"), (F.col("iy") * side).alias("by"), side.alias("w"))


def leaf_id(level: Column, ix: Column, iy: Column) -> Column:
    """A number for a cell: level, then row, then column."""
    return level.cast("long") * (1 << 40) + iy * (1 << 20) + ix


def assign(points: DataFrame, tree: DataFrame, x: str, y: str, world: float = WORLD, name: str = "leaf", outside: bool = False) -> DataFrame:
    """Points with their leaf. Points in no leaf are left out, or with `outside` have a null one.

    Each point is looked up by its finest cell, which the leaves are spread over:
    an equi-join with one match at most. Points in cells with leaves below
    FIRST_LEVELS are looked up at the deepest level, the others not.
    """
    keyed = points.where(_within(x, y, world))
    down = DEEPEST - FIRST_LEVELS
    deep = tree.where(F.col("level") > FIRST_LEVELS).select(*[F.expr(f"shiftright({c}, cast(level as int) - {FIRST_LEVELS})").alias(f"_f{c[1]}") for c in ("ix", "iy")]).distinct()
    deep = F.broadcast(deep)  # 4**FIRST_LEVELS rows at most
    at = lambda df, level: df.withColumns({"_fx": g.cell(F.col(x), level, world), "_fy": g.cell(F.col(y), level, world)})
    how = "left" if outside else "inner"
    first = _looked_up(at(keyed, FIRST_LEVELS).join(deep, ["_fx", "_fy"], "left_anti"), tree, 0, FIRST_LEVELS, name, how)
    under = at(keyed, FIRST_LEVELS).join(deep, ["_fx", "_fy"], "left_semi").drop("_fx", "_fy")
    found = first.unionByName(_looked_up(at(under, FIRST_LEVELS + down), tree, FIRST_LEVELS + 1, DEEPEST, name, how))
    return found.unionByName(points.where(~_within(x, y, world)).withColumn(name, F.lit(None).cast("long"))) if outside else found


def _looked_up(keyed: DataFrame, tree: DataFrame, first: int, last: int, name: str, how: str) -> DataFrame:
    """Points with cells _fx, _fy of the last level, with the leaf of the levels from first that they are in."""
    fine = tree.select(F.col("leaf").alias(name), F.col("level").cast("int").alias("level"), "ix", "iy")
    own = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("_fx", last - level).alias("ix"), F.shiftright("_fy", last - level).alias("iy")) for level in range(first, last + 1)])
    # the finest cells first: one row a cell, not a point
    places = keyed.select("_fx", "_fy").distinct().withColumn("c", F.explode(own)).select("_fx", "_fy", "c.level", "c.ix", "c.iy").join(fine, ["level", "ix", "iy"]).select("_fx", "_fy", name)
    return keyed.join(places, ["_fx", "_fy"], how).drop("_fx", "_fy")


def overlapping(tree: DataFrame, x: float, y: float, width: float, height: float) -> DataFrame:
    """Leaves that share a point with a rectangle."""
    return tree.where(g.overlaps(F.col("bx"), F.col("by"), F.col("w"), F.col("w"), F.lit(float(x)), F.lit(float(y)), F.lit(float(width)), F.lit(float(height))))
