"""Localities, catalogs and cost estimates over the leaves of quadtrees.

Leaves are points divided by the capacity; these operators are statistics over
leaves, for planning. A block only meets the leaves that its scan can come to.

The locality of a block for k: take inner leaves in order of (least distance,
largest distance, number) until they hold k points, let M be the largest distance
met; the locality is all leaves whose least distance is at most M. A catalog says
for every range of k how many leaves that is, and how many points they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.tables import WORLD
from . import quadtree
from .join import Side, _cut, in_place, pruned

MAX_K = 10_000


def within(blocks: DataFrame, inner: DataFrame, levels: int = quadtree.DEEPEST, world: float = WORLD) -> DataFrame:
    """(block, ax, ay, aw, radius, other, n, bx, by, w, near, far): every inner leaf no farther than a block's radius.

    A block looks at the cells of about its radius around it, at most four an
    axis; leaves are met by the cells over them, or, where they are larger, by
    the cells that they are. All joins are equi-joins.
    """
    reach = F.greatest(F.least("radius", F.lit(2.0 * world)), F.col("aw"), F.lit(world / 2**levels))
    at = F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(F.log2(F.lit(float(world)) / reach)))).cast("int")
    wide = blocks.withColumn("at", at).withColumn("cw", F.lit(float(world)) / F.pow(F.lit(2.0), F.col("at")))
    last = F.expr("shiftleft(1L, at) - 1")
    low = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col("radius")) / F.col("cw")) - 1, F.lit(0)), last)
    high = lambda c: F.least(F.greatest(F.floor((F.col(c) + F.col("aw") + F.col("radius")) / F.col("cw")), F.lit(0)), last)
    around = wide.withColumn("cx", F.explode(F.sequence(low("ax"), high("ax")))).withColumn("cy", F.explode(F.sequence(low("ay"), high("ay"))))
    keep = ["block", "ax", "ay", "aw", "radius"]
    around = around.select(*keep, "at", F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"))
    leaf = inner.select(F.col("leaf").alias("other"), "level", "ix", "iy", "n", "bx", "by", "w")
    over = F.explode(F.sequence(F.lit(0), F.col("level").cast("int"))).alias("at")
    under = leaf.select("other", "level", "ix", "iy", "n", "bx", "by", "w", over).withColumns({"cx": F.expr("shiftright(ix, cast(level as int) - at)"), "cy": F.expr("shiftright(iy, cast(level as int) - at)")})
    columns = [*keep, "other", "n", "bx", "by", "w"]
    small = around.join(under, ["at", "cx", "cy"]).select(*columns)
    up = around.select(*keep, "at", "cx", "cy", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).where(F.col("level") < F.col("at"))
    up = up.select(*keep, "level", F.expr("shiftright(cx, at - level)").alias("ix"), F.expr("shiftright(cy, at - level)").alias("iy")).distinct()
    large = up.join(leaf.withColumn("level", F.col("level").cast("int")), ["level", "ix", "iy"]).select(*columns)
    a, b = (F.col("ax"), F.col("ay"), F.col("aw")), (F.col("bx"), F.col("by"), F.col("w"))
    met = small.unionByName(large).withColumns({"near": g.min_dist_block(*a, *b), "far": g.max_dist_block(*a, *b)})
    # a leaf lies under one cell that the block looks at, or is large and kept once a level
    return met.where(F.col("near") <= F.col("radius"))


def _pairs(outer: DataFrame, inner: DataFrame, k: int, levels: int = quadtree.DEEPEST, world: float = WORLD) -> DataFrame:
    """(block, other, n, near, far): the inner leaves that a scan for k points from each outer leaf can come to.

    A cell over a block's centre with k points bounds how far the scan goes, to
    its farthest corner; the largest distance of the leaves up to there bounds
    the locality. Where the table has fewer than k points, all leaves are near.
    """
    outer, inner = _cut(outer), _cut(inner)  # leaves are read several times
    up = F.explode(F.sequence(F.lit(0), F.col("level").cast("int"))).alias("at")
    cells = inner.select(up, "level", "ix", "iy", "n").select("at", F.expr("shiftright(ix, cast(level as int) - at)").alias("cx"), F.expr("shiftright(iy, cast(level as int) - at)").alias("cy"), "n")
    enough = cells.groupBy("at", "cx", "cy").agg(F.sum("n").alias("n")).where(F.col("n") >= k).drop("n")
    blocks = outer.select(F.col("leaf").alias("block"), F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("w").alias("aw"))
    side = F.lit(float(world)) / F.pow(F.lit(2.0), F.col("at"))
    centre = lambda c: F.floor((F.col(c) + F.col("aw") / 2) / side).cast("long")
    chain = blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns({"cx": centre("ax"), "cy": centre("ay")})
    reach = g.max_dist_block(F.col("ax"), F.col("ay"), F.col("aw"), F.col("cx") * side, F.col("cy") * side, side)
    first = chain.join(enough, ["at", "cx", "cy"]).groupBy("block").agg(F.min(reach).alias("radius"))
    blocks = blocks.join(first, "block", "left").withColumn("radius", F.coalesce("radius", F.lit(4.0 * world)))
    most = within(_cut(blocks), inner, levels, world).groupBy("block").agg(F.max("far").alias("radius"))
    return within(_cut(blocks.drop("radius").join(most, "block")), inner, levels, world).select("block", "other", "n", "near", "far")


def _scan(pairs: DataFrame, by: str = "block") -> DataFrame:
    order = Window.partitionBy(by).orderBy("near", "far", "other").rowsBetween(Window.unboundedPreceding, 0)
    return pairs.withColumns({"held": F.sum("n").over(order), "reach": F.max("far").over(order)})


def block_costs(outer: DataFrame, inner: DataFrame, k: int) -> DataFrame:
    """(block, n_blocks, n_points): the locality of every outer leaf."""
    scan = _scan(_pairs(outer, inner, k))
    own = Window.partitionBy("block")
    reach = F.coalesce(F.min(F.when(F.col("held") >= k, F.col("reach"))).over(own), F.max("reach").over(own))
    near = scan.withColumn("m", reach).where(F.col("near") <= F.col("m"))
    return near.groupBy("block").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n").alias("n_points"))


def join_cost(outer: DataFrame, inner: DataFrame, k: int) -> DataFrame:
    """One row: leaves read in all by a join of every outer leaf with its locality."""
    return block_costs(outer, inner, k).agg(F.sum("n_blocks").alias("cost"))


def every_nth(leaves: DataFrame, step: int) -> DataFrame:
    """Every step-th leaf in order of number, counted by ranges of numbers."""
    return in_place(leaves, "leaf")[0].where(F.col("_place") % step == 0).drop("_place")


def join_cost_sampled(outer: DataFrame, inner: DataFrame, k: int, step: int) -> DataFrame:
    """The mean cost of every step-th outer leaf times the number of them all."""
    total = outer.agg(F.count(F.lit(1)).alias("n_leaves"))  # one row
    part = block_costs(every_nth(outer, step), inner, k).agg(F.sum("n_blocks").alias("sum_blocks"), F.count(F.lit(1)).alias("n_sampled"))
    return part.join(F.broadcast(total), F.lit(True)).select((F.col("sum_blocks") * F.col("n_leaves") / F.col("n_sampled")).alias("cost"))


def catalog(outer: DataFrame, inner: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """(block, start_k, end_k, n_blocks, n_points): the locality for every k from 1 to max_k, an interval for each reach."""
    scan = _scan(_pairs(outer, inner, max_k))
    steps = scan.groupBy("block", "reach").agg(F.max("held").alias("end_k"))
    own = Window.partitionBy("block").orderBy("reach")
    steps = steps.withColumns({"start_k": F.coalesce(F.lag("end_k").over(own), F.lit(0)) + 1, "_last": F.lead("end_k").over(own).isNull()})
    steps = steps.where(F.col("start_k") <= max_k).withColumn("end_k", F.when(F.col("_last") | (F.col("end_k") > max_k), F.lit(max_k)).otherwise(F.col("end_k")))
    counted = _cumulative(scan, "near")
    return _at(steps, counted, "reach")


def _cumulative(scan: DataFrame, name: str) -> DataFrame:
    """(block, v, blocks, points): how much lies up to each least distance."""
    per = scan.groupBy("block", F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("p"))
    order = Window.partitionBy("block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("block", "v", F.sum("c").over(order).alias("blocks"), F.sum("p").over(order).alias("points"))


def _at(steps: DataFrame, counted: DataFrame, reach: str) -> DataFrame:
    """The counts at each step's reach: both sorted by distance, the last count up to it."""
    both = steps.select("block", F.col(reach).alias("v"), "start_k", "end_k", F.lit(None).cast("long").alias("blocks"), F.lit(None).cast("long").alias("points"), F.lit(1).alias("kind")).unionByName(
        counted.select("block", "v", F.lit(None).cast("long").alias("start_k"), F.lit(None).cast("long").alias("end_k"), "blocks", "points", F.lit(0).alias("kind"))
    )
    order = Window.partitionBy("block").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({"n_blocks": F.last("blocks", ignorenulls=True).over(order), "n_points": F.last("points", ignorenulls=True).over(order)})
    return filled.where(F.col("kind") == 1).select("block", "start_k", F.col("end_k").cast("long").alias("end_k"), "n_blocks", "n_points")


def lookup(entries: DataFrame, k: int) -> DataFrame:
    """Each block's entry for k; past the last k, the last entry."""
    last = Window.partitionBy("block")
    at = F.least(F.lit(k), F.max("end_k").over(last))
    return entries.withColumn("_k", at).where(F.col("_k").between(F.col("start_k"), F.col("end_k"))).drop("_k")


def merge_max(entries: DataFrame, value: str = "n_blocks", by: str | None = None) -> DataFrame:
    """(start_k, end_k, value): the largest of all blocks' catalogs for every k, equal neighbours joined; with `by`, of each group.

    Values of a block grow with k and its catalog goes up to the last k, as
    localities do; so the largest at k is the largest that began by then, a
    running maximum over the first values of k, of which there are at most as
    many as the largest k.
    """
    group = [by] if by else []
    at = entries.groupBy(*group, F.col("start_k").alias("k")).agg(F.max(value).alias("v"), F.max("end_k").alias("e"))
    order = Window.partitionBy(*group).orderBy("k")
    ends = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    run = at.select(*group, "k", F.max("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(value), ends.alias("_end"))
    first = run.withColumn("_before", F.lag(value).over(order)).where(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    return first.select(*group, F.col("k").alias("start_k"), F.coalesce(F.lead("k").over(order) - 1, F.col("_end")).alias("end_k"), value)


def merge_sum(entries: DataFrame, value: str = "n_blocks") -> DataFrame:
    """(start_k, end_k, value): the sum of all blocks' catalogs for every k, by running sums of the steps."""
    steps = entries.select(F.col("start_k").alias("k"), F.col(value).alias("v")).unionByName(entries.select((F.col("end_k") + 1).alias("k"), (-F.col(value)).alias("v")))
    at = steps.groupBy("k").agg(F.sum("v").alias("v"))
    order = Window.orderBy("k")
    run = at.select(F.col("k").alias("start_k"), (F.lead("k").over(order) - 1).alias("end_k"), F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(value))
    return run.where(F.col("end_k").isNotNull())


def merged_sampled(outer: DataFrame, inner: DataFrame, step: int, max_k: int = MAX_K) -> DataFrame:
    """The sum catalog of every step-th outer leaf, scaled to all of them (whole numbers)."""
    sampled = every_nth(outer, step)
    counts = outer.agg(F.count(F.lit(1)).alias("all_n"))
    part = sampled.agg(F.count(F.lit(1)).alias("part_n"))
    ratio = counts.join(F.broadcast(part), F.lit(True))  # one row
    return merge_sum(catalog(sampled, inner, max_k)).join(F.broadcast(ratio), F.lit(True)).select("start_k", "end_k", F.floor(F.col("n_blocks") * F.col("all_n") / F.col("part_n")).alias("n_blocks"))


def grid(parts: int, world: float) -> Column:
    """Cells of a parts x parts grid as structs (cell, gx, gy, gw); whole-number width, rows first."""
    width = float(int(world) // parts)
    return F.transform(F.sequence(F.lit(0), F.lit(parts * parts - 1)), lambda i: F.struct(i.cast("long").alias("cell"), ((i % parts) * width).alias("gx"), (F.floor(i / parts) * width).alias("gy"), F.lit(width).alias("gw")))


def grid_cells(spark: SparkSession, parts: int, world: float) -> DataFrame:
    """The cells of a grid as blocks (leaf, bx, by, w)."""
    return spark.range(1).select(F.explode(grid(parts, world)).alias("c")).select(F.col("c.cell").alias("leaf"), F.col("c.gx").alias("bx"), F.col("c.gy").alias("by"), F.col("c.gw").alias("w"))


def virtual_grid(spark: SparkSession, inner: DataFrame, parts: int, world: float, max_k: int = MAX_K) -> DataFrame:
    """A catalog for every cell of a grid over the inner leaves."""
    return catalog(grid_cells(spark, parts, world), inner, max_k)


def virtual_grid_cost(spark: SparkSession, outer: DataFrame, inner: DataFrame, k: int, parts: int, world: float) -> DataFrame:
    """Join cost from the grid: each outer leaf costs its first cell's locality, by the ratio of their diagonals."""
    width = float(int(world) // parts)
    # the first cell, by rows, that shares a point with the leaf: closed boxes, so the one whose high edge is the leaf's low edge
    first = lambda low: F.greatest(F.ceil(low / width) - 1, F.lit(0)).cast("long")
    seen = outer.where((first(F.col("bx")) < parts) & (first(F.col("by")) < parts)).select("w", (first(F.col("by")) * parts + first(F.col("bx"))).alias("block"))
    weight = seen.groupBy("block").agg(F.sum(F.col("w") / width).alias("share"))
    return block_costs(grid_cells(spark, parts, world), inner, k).join(weight, "block").agg(F.sum(F.col("n_blocks") * F.col("share")).alias("cost"))


def nearest_distances(pivots: DataFrame, points: DataFrame, x: str, y: str, k: int) -> DataFrame:
    """(block, px, py, d): the distances of the k nearest points from pivots (block, px, py), each point's own."""
    inner = points.select(F.lit(0).alias("_any"), F.col(x).cast("double").alias("_at_x"), F.col(y).cast("double").alias("_at_y"))
    return pruned(Side(pivots.select("block", "px", "py"), "block", "px", "py"), Side(inner, "_any", "_at_x", "_at_y"), k).select("block", "px", "py", "d")


def leaves_met(distances: DataFrame, inner: DataFrame) -> DataFrame:
    """(block, near): the leaves no farther from a pivot than its farthest distance, met by the numbers of cells."""
    blocks = distances.groupBy("block", F.col("px").alias("ax"), F.col("py").alias("ay")).agg(F.max("d").alias("radius"))
    return within(_cut(blocks.withColumn("aw", F.lit(0.0))), inner).select("block", "near")


def pivot_catalog(pivots: DataFrame, inner: DataFrame, points: DataFrame, x: str, y: str, max_k: int = MAX_K) -> DataFrame:
    """(block, start_k, end_k, n_blocks): leaves that distance browsing reads for k, from pivots (block, px, py).

    For the kth distance d, those are the leaves with a least distance of at
    most d. Points go with leaves in distance order, so the kth point has met
    them; equal counts in a row make an interval. A pivot's max_k nearest come
    from the counts of cells and its leaves by cell numbers: what is gone through
    grows with pivots and max_k, not with pivots times points.
    """
    inner = _cut(inner)
    found = _cut(nearest_distances(pivots, points, x, y, max_k))
    far = found.select("block", F.col("d").alias("v"), F.lit(1).alias("kind"))
    near = leaves_met(found, inner).select("block", F.col("near").alias("v"), F.lit(0).alias("kind"))
    order = Window.partitionBy("block").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = far.unionByName(near).withColumns({"k": F.sum("kind").over(order), "n_blocks": F.sum(1 - F.col("kind")).over(order)}).where(F.col("kind") == 1)
    steps = run.groupBy("block", "n_blocks").agg(F.min("k").alias("start_k"), F.max("k").alias("end_k"))
    last = F.lead("start_k").over(Window.partitionBy("block").orderBy("start_k")).isNull()
    return steps.select("block", "start_k", F.when(last, F.lit(max_k)).otherwise(F.col("end_k")).cast("long").alias("end_k"), "n_blocks")


def corner_catalog(tree: DataFrame, inner: DataFrame, points: DataFrame, x: str, y: str, max_k: int = MAX_K, world: float = WORLD) -> DataFrame:
    """(block, start_k, end_k, n_blocks) for every leaf: the most leaves read from any of its corners, for every k.

    Corners that leaves share are gone through once.
    """
    fine = lambda c: F.round(F.col(c) * (2.0**quadtree.DEEPEST / world)).cast("long")
    corners = _cut(corner_pivots(tree).withColumn("place", fine("px") * (1 << (quadtree.DEEPEST + 1)) + fine("py")))
    places = corners.groupBy(F.col("place").alias("block")).agg(F.min("px").alias("px"), F.min("py").alias("py"))
    entries = pivot_catalog(places, inner, points, x, y, max_k).withColumnRenamed("block", "place")
    return merge_max(corners.select("block", "place").join(entries, "place"), by="block")


def select_cost(points: DataFrame, inner: DataFrame, at: tuple[float, float], k: int, x: str, y: str) -> DataFrame:
    """One row: leaves that distance browsing reads for the k nearest of a point."""
    px, py = F.lit(float(at[0])), F.lit(float(at[1]))
    kth = points.select(g.distance(F.col(x), F.col(y), px, py).alias("d")).orderBy("d").limit(k).agg(F.max("d").alias("_d"))  # one row
    near = g.min_dist_point(px, py, F.col("bx"), F.col("by"), F.col("w"))
    return inner.join(F.broadcast(kth), near <= F.col("_d")).agg(F.count(F.lit(1)).alias("cost"))


def enclosing(tree: DataFrame, at: tuple[float, float]) -> DataFrame:
    """The leaf that holds a point: half-open below, as points on a border belong to the lower cell."""
    px, py = float(at[0]), float(at[1])
    low = lambda p, b: (F.col(b) < p) | ((F.col(b) == 0) & (F.lit(p) == 0))
    return tree.where(low(px, "bx") & low(py, "by") & (F.col("bx") + F.col("w") >= px) & (F.col("by") + F.col("w") >= py))


def center_pivots(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("leaf").alias("block"), (F.col("bx") + F.col("w") / 2).alias("px"), (F.col("by") + F.col("w") / 2).alias("py"))


def corner_pivots(tree: DataFrame) -> DataFrame:
    """Four rows for every leaf, with corner from 0 to 3."""
    corners = F.array(*[F.struct(F.lit(i).alias("corner"), (F.col("bx") + F.col("w") * (i % 2)).alias("px"), (F.col("by") + F.col("w") * (i // 2)).alias("py")) for i in range(4)])
    return tree.select(F.col("leaf").alias("block"), F.explode(corners).alias("c")).select("block", "c.corner", "c.px", "c.py")


def pivot_costs(pivots: DataFrame, inner: DataFrame, points: DataFrame, k: int, x: str, y: str) -> DataFrame:
    """(pivot, n_blocks): the leaves that browsing reads for k from the pivots (pivot, px, py) of one leaf.

    These are five rows at most, which every task gets; for the pivots of many
    leaves look k up in a pivot_catalog().
    """
    far = points.join(F.broadcast(pivots), F.lit(True)).select("pivot", g.distance(F.col(x), F.col(y), F.col("px"), F.col("py")).alias("d"))
    rank = F.row_number().over(Window.partitionBy("pivot").orderBy("d"))
    kth = far.where(F.col("d").isNotNull() & ~F.isnan("d")).withColumn("_r", rank).where(F.col("_r") <= k).groupBy("pivot").agg(F.max("d").alias("kth"))
    near = g.min_dist_point(F.col("px"), F.col("py"), F.col("bx"), F.col("by"), F.col("w"))
    return inner.join(F.broadcast(pivots.join(kth, "pivot")), near <= F.col("kth")).groupBy("pivot").agg(F.count(F.lit(1)).alias("n_blocks"))


def select_cost_center(points: DataFrame, inner: DataFrame, at: tuple[float, float], k: int, x: str, y: str) -> DataFrame:
    """The cost at the centre of the leaf that holds the point."""
    pivots = center_pivots(enclosing(inner, at)).withColumn("pivot", F.lit(0))
    return pivot_costs(pivots, inner, points, k, x, y).select(F.col("n_blocks").alias("cost"))


def select_cost_corners(points: DataFrame, inner: DataFrame, at: tuple[float, float], k: int, x: str, y: str) -> DataFrame:
    """The cost at the centre, moved towards the corners' largest by how far out the point is; whole numbers."""
    leaf = enclosing(inner, at)
    pivots = center_pivots(leaf).withColumn("pivot", F.lit(0)).unionByName(corner_pivots(leaf).select("block", "px", "py", (F.col("corner") + 1).alias("pivot")))
    costs = pivot_costs(pivots, inner, points, k, x, y)
    both = costs.agg(F.max(F.when(F.col("pivot") == 0, F.col("n_blocks"))).alias("center"), F.max(F.when(F.col("pivot") > 0, F.col("n_blocks"))).alias("corner"))
    where = leaf.select(g.distance(F.col("bx") + F.col("w") / 2, F.col("by") + F.col("w") / 2, F.lit(float(at[0])), F.lit(float(at[1]))).alias("off"), (g.norm(F.col("w"), F.col("w")) / 2).alias("half"))
    out = both.join(F.broadcast(where), F.lit(True))  # one row each
    return out.select(F.floor(F.col("center") + F.abs(F.col("corner") - F.col("center")) * F.col("off") / F.col("half")).alias("cost"))


def select_cost_density(inner: DataFrame, at: tuple[float, float], k: int) -> DataFrame:
    """The cost if points were as dense as around the point.

    From the leaf that holds the point, leaves are taken in order of distance
    from it until the circle that should hold k points at their density fits
    into their common box; the cost is the leaves within the circle's radius.
    """
    px, py = F.lit(float(at[0])), F.lit(float(at[1]))
    leaf = enclosing(inner, at).select(F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("w").alias("aw"))  # one row
    near = inner.join(F.broadcast(leaf), F.lit(True)).withColumn("near", g.min_dist_block(F.col("ax"), F.col("ay"), F.col("aw"), F.col("bx"), F.col("by"), F.col("w")))
    order = Window.orderBy("near", "leaf").rowsBetween(Window.unboundedPreceding, 0)
    run = near.select("leaf", "near", F.min("bx").over(order).alias("x0"), F.min("by").over(order).alias("y0"), F.max(F.col("bx") + F.col("w")).over(order).alias("x1"), F.max(F.col("by") + F.col("w")).over(order).alias("y1"), F.sum("n").over(order).alias("held"))
    radius = F.sqrt(F.lit(float(k)) / (F.lit(3.141592653589793) * (F.col("held") / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))))))
    run = run.withColumn("radius", radius)
    fits = (px - F.col("radius") >= F.col("x0")) & (px + F.col("radius") <= F.col("x1")) & (py - F.col("radius") >= F.col("y0")) & (py + F.col("radius") <= F.col("y1"))
    stop = run.agg(F.coalesce(F.min(F.when(fits, F.struct("near", "leaf", "radius")))["radius"], F.max(F.struct("near", "leaf", "radius"))["radius"]).alias("r"))  # one row
    return near.join(F.broadcast(stop), F.col("near") <= F.col("r")).agg(F.count(F.lit(1)).alias("cost"))


def storage(entries: DataFrame) -> DataFrame:
    """One row: how many entries a catalog has."""
    return entries.agg(F.count(F.lit(1)).alias("n_entries"))


def accuracy(estimate: Column, actual: Column) -> Column:
    """The smaller by the larger, from 0 to 1."""
    return F.least(estimate, actual) / F.greatest(estimate, actual)


def closeness(estimate: Column, actual: Column) -> Column:
    """1 less the relative error; 0 if the estimate is over twice the actual."""
    return F.when(estimate > 2 * actual, F.lit(0.0)).otherwise(1 - F.abs(estimate - actual) / actual)
