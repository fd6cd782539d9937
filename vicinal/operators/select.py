"""Nearest points to one focal point, with a relational predicate.

level="P": the k nearest of all points, then those of them that satisfy the
predicate. level="Q": the k nearest of those that satisfy it. They are different
queries; each has several plans with equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import predicates, quadtree

FOCUS = (50000.0, 40000.0)


def with_distance(points: DataFrame, at: tuple[float, float], x: str, y: str) -> DataFrame:
    """The points that have both coordinates, with d."""
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (x, y)]
    return points.where(ok[0] & ok[1]).withColumn("d", g.distance(F.col(x), F.col(y), F.lit(float(at[0])), F.lit(float(at[1]))))


def nearest(points: DataFrame, k: int, at: tuple[float, float], x: str, y: str, key: str, ties: str = "break") -> DataFrame:
    """The k nearest points with their distance d. ties: `break` by key, or `all` that are as near as the kth."""
    ranked = with_distance(points, at, x, y)
    first = ranked.orderBy("d", key).limit(k)
    if ties == "break":
        return first
    last = first.agg(F.max("d").alias("_d"))  # one row
    return ranked.join(F.broadcast(last), F.col("d") <= F.col("_d")).drop("_d")


def p_relational_first(points: DataFrame, keys: DataFrame, k: int, at: tuple[float, float], x: str, y: str, key: str, ties: str = "break") -> DataFrame:
    """Those that qualify, unless k points lie closer."""
    last = nearest(points, k, at, x, y, key).agg(F.max(F.struct("d", key)).alias("_last"))  # one row
    within = F.struct("d", key) <= F.col("_last") if ties == "break" else F.col("d") <= F.col("_last.d")
    qualified = with_distance(points.join(keys, key, "left_semi"), at, x, y)
    return qualified.join(F.broadcast(last), within).drop("_last")


def p_sweep(points: DataFrame, orders: DataFrame, parameters: predicates.Parameters, at: tuple[float, float], x: str, y: str, key: str) -> DataFrame:
    """(k, price_below, more_than, key, d): the level P select for every (k, price, count) of some parameters, in one plan.

    The nearest for the largest k are found once, and their orders are read once
    and counted under every price. A key qualifies with more than so many orders;
    below 0, without any too. No parameters give no rows.
    """
    near = nearest(points, max((k for k, _, _ in parameters), default=0), at, x, y, key).select(key, "d")
    ranked = near.withColumn("_rank", F.row_number().over(Window.orderBy("d", key)))  # rows of one parameter
    mine = orders.join(ranked.select(F.col(key).alias("o_custkey")).distinct(), "o_custkey", "left_semi")
    counts, each = predicates.swept_counts(mine, parameters)
    both = ranked.join(counts, F.col(key) == F.col("o_custkey"), "left")
    every = both.select(key, "d", "_rank", F.explode(each).alias("p")).where((F.col("_rank") <= F.col("p.k")) & (F.col("p.n") > F.col("p.more_than")))
    return every.select("p.k", "p.price_below", "p.more_than", key, "d")


def q_sweep(points: DataFrame, orders: DataFrame, parameters: predicates.Parameters, at: tuple[float, float], x: str, y: str, key: str) -> DataFrame:
    """As p_sweep() at level Q: the k nearest of those that qualify.

    Points and orders are read once. A point goes to the conditions that it
    satisfies; a task hands on no more than the largest k of each.
    """
    most = {(float(p), c): max(k for k, q, d in parameters if (q, d) == (p, c)) for _, p, c in parameters}
    counts, each = predicates.swept_counts(orders, [(k, p, c) for (p, c), k in most.items()])
    both = with_distance(points, at, x, y).select(key, "d").join(counts, F.col(key) == F.col("o_custkey"), "left")
    qualified = both.select(key, "d", F.explode(each).alias("p")).where(F.col("p.n") > F.col("p.more_than")).select("p.price_below", "p.more_than", key, "d")
    ranked = qualified.withColumn("_rank", F.row_number().over(Window.partitionBy("price_below", "more_than").orderBy("d", key))).where(F.col("_rank") <= max(most.values(), default=0))
    ks = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(p)).alias("p"), F.lit(c).cast("long").alias("c")) for k, p, c in parameters]).cast("array<struct<k: bigint, p: double, c: bigint>>")
    asked = ranked.select("*", F.explode(ks).alias("a")).where((F.col("a.p") == F.col("price_below")) & (F.col("a.c") == F.col("more_than")) & (F.col("_rank") <= F.col("a.k")))
    return asked.select("a.k", "price_below", "more_than", key, "d")


def p_knn_first(points: DataFrame, keys: DataFrame, k: int, at: tuple[float, float], x: str, y: str, key: str, ties: str = "break") -> DataFrame:
    """The k nearest, then those that qualify. keys may carry columns, which come along."""
    return nearest(points, k, at, x, y, key, ties).join(keys, key)


def q_relational_first(points: DataFrame, keys: DataFrame, k: int, at: tuple[float, float], x: str, y: str, key: str, ties: str = "break") -> DataFrame:
    """The k nearest of those that qualify."""
    return nearest(points.join(keys, key, "left_semi"), k, at, x, y, key, ties)


def locality(tree: DataFrame, at: tuple[float, float], k: int) -> DataFrame:
    """Leaves that can hold one of the k nearest: those within the reach of the nearest leaves with k points.

    Leaves are few, so they are put in order in one place.
    """
    px, py = F.lit(float(at[0])), F.lit(float(at[1]))
    block = F.col("bx"), F.col("by"), F.col("w")
    tree = tree.withColumns({"min_d": g.min_dist_point(px, py, *block), "max_d": g.max_dist_point(px, py, *block)})
    from pyspark.sql import Window

    order = Window.orderBy("min_d", "max_d", "leaf").rowsBetween(Window.unboundedPreceding, 0)
    scan = tree.withColumns({"_n": F.sum("n").over(order), "_reach": F.max("max_d").over(order)})
    whole = Window.partitionBy(F.lit(1))
    reach = F.coalesce(F.min(F.when(F.col("_n") >= k, F.col("_reach"))).over(whole), F.max("_reach").over(whole))
    return scan.withColumn("reach", reach).where(F.col("min_d") <= F.col("reach")).drop("_n", "_reach")


def _reach(tree: DataFrame, at: tuple[float, float], k: int) -> tuple[float, int]:
    """How far the k nearest points are at most, and how many points the tree holds, from the counts of its leaves.

    Leaves are summed over rings of about equal ratio around the point, so what
    is put in order is some thousand rows at most, whatever the tree.
    """
    px, py = F.lit(float(at[0])), F.lit(float(at[1]))
    far = g.max_dist_point(px, py, F.col("bx"), F.col("by"), F.col("w"))
    rings = tree.select("n", far.alias("far")).groupBy(F.round(F.log2(F.greatest("far", F.lit(1e-9))) * 32).alias("ring")).agg(F.sum("n").alias("n"), F.max("far").alias("far"))
    held, reach = 0, 0.0
    found = sorted((r["ring"], r["n"], r["far"]) for r in rings.collect())  # at most 32 a doubling of distance
    total = sum(n for _, n, _ in found)
    for _, n, far in found:
        held, reach = held + n, max(reach, far)
        if held >= k:
            break
    return reach, total


def q_knn_first(points: DataFrame, keys: DataFrame, k: int, at: tuple[float, float], x: str, y: str, key: str, capacity: int = quadtree.CAPACITY) -> DataFrame:
    """The nearest of all points first, four times as many a turn, and the predicate on these only.

    Where they are comes from the counts of leaves, so a turn reads the points
    within a radius and puts nothing in order but what qualifies. Points out of
    the world are looked at once all others were.
    """
    tree, looked = quadtree.leaves(points, x, y, capacity), 4 * k
    while True:
        reach, total = _reach(tree, at, looked)
        whole = looked >= total
        near = with_distance(points, at, x, y)
        near = near if whole else near.where(F.col("d") <= reach)
        found = near.join(keys, key, "left_semi").orderBy("d", key).limit(k)
        if whole or len(found.select("d").collect()) == k:
            return found
        looked *= 4


def q_browse(points: DataFrame, keys: DataFrame, k: int, at: tuple[float, float], x: str, y: str, key: str, capacity: int = quadtree.CAPACITY) -> DataFrame:
    """Distance browsing: rings from near to far, each looked at once, until k points of them qualify.

    A ring is what the next 4 * k, 16 * k, ... points take by the counts of the
    leaves; what qualified nearer is kept.
    """
    tree, looked, inner, found = quadtree.leaves(points, x, y, capacity), 4 * k, -1.0, None
    while True:
        reach, total = _reach(tree, at, looked)
        whole = looked >= total
        ring = with_distance(points, at, x, y).where(F.col("d") > inner)
        ring = (ring if whole else ring.where(F.col("d") <= reach)).join(keys, key, "left_semi")
        found = ring if found is None else found.unionByName(ring)
        best = found.orderBy("d", key).limit(k)
        if whole or len(best.select("d").collect()) == k:
            return best
        looked, inner = looked * 4, reach


def browsed_leaves(points: DataFrame, k: int, at: tuple[float, float], x: str, y: str, capacity: int = quadtree.CAPACITY) -> DataFrame:
    """One row: how many leaves distance browsing explores for the k nearest: those no farther than the kth."""
    kth = with_distance(points, at, x, y).select("d").orderBy("d").limit(k).agg(F.max("d").alias("_d"))  # one row
    near = g.min_dist_point(F.lit(float(at[0])), F.lit(float(at[1])), F.col("bx"), F.col("by"), F.col("w"))
    return quadtree.leaves(points, x, y, capacity).join(F.broadcast(kth), near <= F.col("_d")).agg(F.count(F.lit(1)).alias("explored_leaves"))


def locality_scan(tree: DataFrame, at: tuple[float, float], most: float | None = None) -> DataFrame:
    """Leaves from near to far, with min_d and max_d; only those no farther than `most`, if given."""
    px, py = F.lit(float(at[0])), F.lit(float(at[1]))
    block = F.col("bx"), F.col("by"), F.col("w")
    scan = tree.withColumns({"min_d": g.min_dist_point(px, py, *block), "max_d": g.max_dist_point(px, py, *block)})
    return (scan if most is None else scan.where(F.col("min_d") <= most)).orderBy("min_d", "max_d", "leaf")


def browse(points: DataFrame, at: tuple[float, float], x: str, y: str, key: str):
    """Points from near to far, fetched partition by partition as they are asked for."""
    return with_distance(points, at, x, y).orderBy("d", key).toLocalIterator()


def k_in_circle(points: DataFrame, k: int, at: tuple[float, float], radius: float, x: str, y: str) -> DataFrame:
    """One row: whether at least k points lie strictly inside the circle, and how many do."""
    n = with_distance(points, at, x, y).agg(F.count(F.when(F.col("d") < radius, 1)).alias("n_inside"))
    return n.select("n_inside", (F.col("n_inside") >= k).alias("k_inside"))
