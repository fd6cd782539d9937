"""The k nearest inner points of every outer point.

Joins are exact and need no cross product. Inner points are counted in the cells
of a quadtree; every outer row goes down from the root, round by round, and
keeps the cells that can hold one of its k nearest: those no farther than the
farthest corner of the nearest cells that hold k points. Only points of the last
cells are looked at. So an outer row costs some cells a level and some points,
wherever it lies and however dense the points are.

Rows without both coordinates have no neighbours and are nobody's neighbour.
Outer rows are told apart, also if they share a key or have none. Ties go by
inner key, or all stay; repeated inner rows are rows each. Points may lie
anywhere: the root covers all of them. An empty side gives no rows. The sides may
have any other columns, and be one table: see _apart() for the names they get.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import tables
from ..sources.tables import WORLD
from . import predicates, quadtree

#: Outer rows up to which a nested loop is taken: what it sends to every executor; and pairs up to which, all of which it sorts.
NESTED_ROWS, NESTED_PAIRS = 10_000, 50_000_000
#: Parts that the uppermost cells are met in, as all outer rows begin there; and the level from which cells are many.
PARTS, MANY_FROM = 32, 6
#: Levels that cells are counted on at least.
FIRST_LEVELS = 6
#: Rounds in one statement, and about how many cells a round meets for an outer row.
ROUNDS, ROUND_CELLS = 5, 64
#: Rows a place from which a join with all ties goes by places, rows of a part of a place, and pairs of a task that lists them.
CROWDED, PART_ROWS, TASK_PAIRS = 4, 1_000, 5_000_000
#: Places in a range of values, for joins by a condition on values.
RANGE_ROWS = 1_024


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="vicinal-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    """Write a table to the folder that executors share and read it back, so that no later step repeats it."""
    path = shared_path(df.sparkSession, "join")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def best_k(pairs: DataFrame, outer_key: str, inner_key: str, k: int, ties: str = "break") -> DataFrame:
    """The k nearest pairs of every outer key, with rn from 1. ties: `break` by inner key, or `all` (rank).

    Sessions that take k above 1,000 set spark.sql.optimizer.windowGroupLimitThreshold
    to it, so that the limit is pushed below the window's sort.
    """
    order = ["d", inner_key] if ties == "break" else ["d"]
    rank = (F.row_number() if ties == "break" else F.rank()).over(Window.partitionBy(outer_key).orderBy(*order))
    return pairs.withColumn("rn", rank).where(F.col("rn") <= k)


#: Keys that qualify, of the inner keys in a table with that column.
Qualify = Callable[[DataFrame], DataFrame]


class Side:
    """A table with the names of its key and coordinates."""

    def __init__(self, df: DataFrame, key: str, x: str, y: str):
        self.df, self.key, self.x, self.y = df, key, x, y

    def where(self, keys: DataFrame) -> Side:
        return Side(self.df.join(keys, self.key, "left_semi"), self.key, self.x, self.y)

    def located(self) -> Side:
        """Without the rows that lack a coordinate."""
        ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        return Side(self.df.where(ok(self.x) & ok(self.y)), self.key, self.x, self.y)

    def rows(self) -> int:
        return self.df.count()

    def renamed(self, names: dict[str, str]) -> Side:
        if not names:
            return self
        new = lambda c: names.get(c, c)
        return Side(self.df.select(*[F.col(f"`{c}`").alias(new(c)) for c in self.df.columns]), new(self.key), new(self.x), new(self.y))


#: Names of columns that results and steps have.
TAKEN = frozenset("d rn reach level _row _group _cell _next _ix _iy _fx _fy _px _py _seen _bound _n _m _v _kind _o _i _id _part _start _place _range _limit _size".split())


def _apart(outer: Side, inner: Side, *columns: str) -> tuple:
    """Both sides without a name in common, and the names that columns (inner, outer, inner, ...) have then.

    A column named like one of the results or of the steps (TAKEN) gets `_outer`
    or `_inner` appended, as does an inner one that the outer side has too. So a
    table may be joined with itself.
    """

    def names(side: Side, taken: set[str], mark: str) -> dict[str, str]:
        found: dict[str, str] = {}
        for c in side.df.columns:
            new = c
            while new.lower() in taken:
                new = f"{new}_{mark}"
            if new != c:
                found[c] = new
            taken.add(new.lower())
        return found

    taken = set(TAKEN)
    own = names(outer, taken, "outer")
    other = names(inner, taken, "inner")
    given = [(other if i % 2 == 0 else own).get(c, c) for i, c in enumerate(columns)]
    return (outer.renamed(own), inner.renamed(other), *given)


def _asking(qualify: Qualify, asked: str, key: str) -> Qualify:
    """The same predicate for a key that has been renamed."""
    if asked == key:
        return qualify
    return lambda keys: qualify(keys.withColumnRenamed(key, asked)).select(F.col(asked).alias(key))


def _distance(outer: Side, inner: Side) -> Column:
    return g.distance(F.col(outer.x), F.col(outer.y), F.col(inner.x), F.col(inner.y))


def nested_loop(outer: Side, inner: Side, k: int, ties: str = "break", on: Column | None = None) -> DataFrame:
    """Every inner row against every outer row; for few outer rows, which the caller has counted."""
    outer, inner, *_ = _apart(outer.located(), inner.located())
    rows = _cut(outer.df.withColumn("_row", F.monotonically_increasing_id()))
    pairs = inner.df.join(F.broadcast(rows), on if on is not None else F.lit(True))
    return best_k(pairs.withColumn("d", _distance(outer, inner)), "_row", inner.key, k, ties).drop("_row")


def bounds(*sides: Side) -> tuple[float, float, float]:
    """(low x, low y, width) of a box over all points: the world if that holds them."""
    found = [s.df.agg(F.min(s.x), F.max(s.x), F.min(s.y), F.max(s.y)).first() for s in sides]
    known = [tuple(float(v) for v in r) for r in found if r[0] is not None]
    x0, x1, y0, y1 = (f(r[i] for r in known) if known else 0.0 for i, f in enumerate((min, max, min, max)))
    if x0 >= 0 and y0 >= 0 and max(x1, y1) < WORLD:
        return 0.0, 0.0, WORLD
    return x0, y0, max(x1 - x0, y1 - y0, 1e-300) * (1 + 1e-9)


class Cells:
    """Counts of inner points in the cells of every step-th level, by group, and the points with their last cell.

    A cell with more than `capacity` points is divided, down to the last level.
    """

    def __init__(self, inner: Side, box: tuple[float, float, float], group: str, capacity: int, step: int, grouped: bool = False, deepest: int = 20):
        self.grouped, self.tasks = grouped, 0
        self.inner, self.box, self.group, self.capacity, self.step = inner, box, group, capacity, step
        # as deep as the densest place asks for, four levels at a time
        self.levels = -(-FIRST_LEVELS // step) * step
        while self.levels + 4 <= deepest and self.densest() > capacity:
            self.levels += 4
        at = self.finest(inner)
        points = inner.df.withColumns({"_ix": at[0], "_iy": at[1]})
        finest = points.groupBy(group, "_ix", "_iy").agg(F.count(F.lit(1)).alias("n"))
        down = F.explode(F.sequence(F.lit(0), F.lit(self.levels), F.lit(step))).alias("level")
        up = lambda c: F.expr(f"shiftright({c}, {self.levels} - level)").alias(c)
        every = finest.select(group, down, "_ix", "_iy", "n").select(group, "level", up("_ix"), up("_iy"), "n").groupBy(group, "level", "_ix", "_iy").agg(F.sum("n").alias("n"))
        over = every.where(F.col("n") > capacity).select(group, (F.col("level") + step).alias("level"), F.col("_ix").alias("_px"), F.col("_iy").alias("_py"))
        below = every.withColumns({"_px": F.shiftright("_ix", step), "_py": F.shiftright("_iy", step)})
        # the root, and what is under a divided cell
        self.cells = _cut(every.where(F.col("level") == 0).withColumns({"_px": F.col("_ix"), "_py": F.col("_iy")}).unionByName(below.join(over, [group, "level", "_px", "_py"], "left_semi")))
        last = self.cells.where((F.col("n") <= capacity) | (F.col("level") == self.levels)).select(group, "level", "_ix", "_iy")
        # what comes after a cell: its parts, at most 4**step, or itself if it is a last one
        part = F.struct("level", "_ix", "_iy", "n")
        parts = self.cells.where(F.col("level") > 0).groupBy(group, (F.col("level") - step).alias("level"), F.col("_px").alias("_ix"), F.col("_py").alias("_iy")).agg(F.collect_list(part).alias("_next"))
        self.next = _cut(parts.unionByName(self.cells.join(last, [group, "level", "_ix", "_iy"], "left_semi").select(group, "level", "_ix", "_iy", F.array(part).alias("_next"))))
        places = finest.select(group, F.col("_ix").alias("_fx"), F.col("_iy").alias("_fy"), down, "_ix", "_iy").select(group, "_fx", "_fy", "level", up("_ix"), up("_iy")).join(last, [group, "level", "_ix", "_iy"])
        places = places.select(group, F.col("_fx").alias("_ix"), F.col("_fy").alias("_iy"), self.name("level", "_ix", "_iy"))
        self.points = points.join(places, [group, "_ix", "_iy"]).drop("_ix", "_iy")

    def densest(self) -> int:
        """The most points in a cell of the last level."""
        ix, iy = self.finest(self.inner)
        return self.inner.df.groupBy(self.group, ix, iy).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def finest(self, side: Side) -> tuple[Column, Column]:
        x0, y0, world = self.box
        last = F.lit(2**self.levels - 1)
        return tuple(F.least(g.cell(F.col(c) - F.lit(low), self.levels, world), last) for c, low in ((side.x, x0), (side.y, y0)))

    @staticmethod
    def name(level: str, ix: str, iy: str) -> Column:
        return quadtree.leaf_id(F.col(level), F.col(ix), F.col(iy)).alias("_cell")

    def gap(self, x: Column, y: Column) -> Column:
        """How far a point is from the cell named `_cell`."""
        x0, y0, world = self.box
        cell = F.col("_cell")
        side = F.lit(world) / F.pow(F.lit(2.0), F.shiftright(cell, 40))
        last = F.lit((1 << 20) - 1)
        return g.min_dist_point(x, y, F.lit(x0) + cell.bitwiseAND(last) * side, F.lit(y0) + F.shiftright(cell, 20).bitwiseAND(last) * side, side)

    def reached(self, rows: DataFrame, x: str, y: str, k: int) -> DataFrame:
        """(_row, group, x, y, _cell, reach): the last cells that can hold one of a row's k nearest, all within reach.

        A few rounds are one SQL statement, as they would be analysed over and over
        otherwise, and what they leave is written. Where rows are many, what a round
        meets is dealt by row over tasks of about tables.TASK_ROWS.
        """
        x0, y0, world = (f"{v!r}D" for v in self.box)
        own = "PARTITION BY r" + (", g" if self.grouped else "")
        side = f"{world} / pow(2D, level)"
        gap = lambda p, low: f"greatest({low} - {p}, {p} - ({low} + w), 0D)"
        far = lambda p, low: f"greatest(abs({p} - {low}), abs({low} + w - {p}))"
        norm = lambda f: f"sqrt({f('x', 'bx')} * {f('x', 'bx')} + {f('y', 'by')} * {f('y', 'by')})"
        named = lambda df, **names: df.select(*[F.col(c).alias(n) for n, c in names.items()])
        root = named(self.cells.where("level = 0"), g=self.group, level="level", ix="_ix", iy="_iy", n="n")  # a row a group
        after_all = named(self.next, g=self.group, level="level", ix="_ix", iy="_iy", after="_next")
        state = named(rows, r="_row", g=self.group, x=x, y=y).join(root if self.grouped else F.broadcast(root), "g")
        met, least = rows.count() * ROUND_CELLS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = f"/*+ REPARTITION({max(math.ceil(met / tables.TASK_ROWS), least)}, r) */ " if met > tables.TASK_ROWS else ""
        parts: list[str] = []
        levels = list(range(0, self.levels, self.step))
        for i, level in enumerate(levels):
            hint, on, after = "", "", f"(SELECT * FROM t WHERE level <= {level})"
            if level < MANY_FROM and not self.grouped:  # some hundred rows, as the level says
                hint = " /*+ BROADCAST(t) */"
            elif level < MANY_FROM:
                on, after = f" AND t.p = pmod(xxhash64(r), {PARTS})", f"(SELECT *, explode(sequence(0, {PARTS - 1})) AS p FROM t WHERE level <= {level})"
            parts += [
                f"a{i} AS (SELECT{hint} r, s.g, x, y, inline(after) FROM {f"s{i}" if parts else "o"} s JOIN {after} t ON s.g = t.g AND s.level = t.level AND s.ix = t.ix AND s.iy = t.iy{on})",
                f"b{i} AS (SELECT r, g, x, y, level, _ix AS ix, _iy AS iy, n, {x0} + _ix * ({side}) AS bx, {y0} + _iy * ({side}) AS by, {side} AS w FROM a{i})",
                f"d{i} AS (SELECT {dealt}*, {norm(gap)} AS near, {norm(far)} AS far FROM b{i})",
                f"h{i} AS (SELECT *, sum(n) OVER ({own} ORDER BY far ROWS UNBOUNDED PRECEDING) AS held FROM d{i})",
                f"e{i} AS (SELECT *, coalesce(min(CASE WHEN held >= {k} THEN far END) OVER ({own}), max(far) OVER ({own})) * (1 + 1e-12D) + {world} * 1e-12D AS reach FROM h{i})",
                f"s{i + 1} AS (SELECT r, g, x, y, level, ix, iy, n, reach FROM e{i} WHERE near <= reach)",
            ]
            if i % ROUNDS == ROUNDS - 1 or level == levels[-1]:
                state = _cut(rows.sparkSession.sql(f"WITH o AS (SELECT * FROM {{o}}), t AS (SELECT * FROM {{t}}), {', '.join(parts)} SELECT * FROM s{i + 1}", o=state, t=after_all))
                parts = []
        # pairs that the cells make, and those of one cell
        pairs, most = state.groupBy("g", "level", "ix", "iy").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.max("n")).first()
        many = (pairs or 0) > tables.TASK_ROWS and most <= 4 * tables.TASK_ROWS
        self.tasks = max(math.ceil(pairs / tables.TASK_ROWS), least) if many else 0
        return state.select(F.col("r").alias("_row"), F.col("g").alias(self.group), F.col("x").alias(x), F.col("y").alias(y), self.name("level", "ix", "iy"), "reach")

    def meet(self, near: DataFrame) -> DataFrame:
        """Rows that reached() gave, with the points of their cells.

        Where these are many, cells are dealt over tasks of about tables.TASK_ROWS
        pairs, so a task's memory doesn't grow with the tables; a cell of far more
        pairs is left to Spark, which splits it.
        """
        on = [self.group, "_cell"]
        return (near.repartition(self.tasks, *on) if self.tasks else near).join(self.points, on)


def numbered(outer: Side) -> DataFrame:
    """Outer rows with a number each, written so that it stays."""
    return _cut(outer.located().df.withColumn("_row", F.monotonically_increasing_id()))


def _pairs(rows: DataFrame, outer: Side, inner: Side, k: int, cells: Cells, reached: DataFrame | None = None) -> DataFrame:
    """(_row, inner columns, d) within the rows' reach; rows has _row, the group and the outer coordinates."""
    near = cells.reached(rows, outer.x, outer.y, k) if reached is None else reached
    pairs = cells.meet(near).drop("_cell")
    return pairs.withColumn("d", _distance(outer, inner)).where(F.col("d") <= F.col("reach")).drop("reach", outer.x, outer.y, cells.group)


def pruned(outer: Side, inner: Side, k: int, ties: str = "break", capacity: int = quadtree.CAPACITY, step: int = 2) -> DataFrame:
    """Neighbours from the cells that can hold them, `step` levels a round."""
    outer, inner = _apart(outer, inner)
    rows, inner = numbered(outer), inner.located()
    box = bounds(Side(rows, outer.key, outer.x, outer.y), inner)
    one = lambda df: df.withColumn("_group", F.lit(0))
    cells = Cells(Side(one(inner.df), inner.key, inner.x, inner.y), box, "_group", capacity, step)
    pairs = _pairs(one(rows), outer, inner, k, cells)
    found = best_k(pairs.repartition(cells.tasks, "_row") if cells.tasks else pairs, "_row", inner.key, k, ties)
    return rows.join(found, "_row").drop("_row")


def by_places(outer: Side, inner: Side, k: int, step: int = 2) -> DataFrame | None:
    """Neighbours with all ties where inner rows share places, CROWDED or more a place, else None.

    Only places are joined: a place is ranked by the rows of nearer ones, and no
    pair of rows is sorted or shuffled. Rows of a place are kept in parts of about
    PART_ROWS, and two parts whose places are near are a row that lists its pairs
    where it is, over tasks of about TASK_PAIRS. So the work is that of listing
    the result, and a task holds two parts at a time however crowded a place is.
    """
    outer, inner = _apart(outer, inner)
    inner = inner.located()
    places = lambda df, side, kind: _cut(df.groupBy(F.col(side.x).alias(f"{kind}x"), F.col(side.y).alias(f"{kind}y")).agg(F.count(F.lit(1)).alias(f"{kind}n")).withColumn(kind, F.monotonically_increasing_id()))
    others = places(inner.df, inner, "other")
    n_places, n = others.agg(F.count(F.lit(1)), F.sum("othern")).first()
    if (n or 0) < CROWDED * n_places or not n_places:
        return None
    rows, points = numbered(outer), numbered(inner)
    own = places(rows, outer, "own")
    near = pruned(Side(own, "own", "ownx", "owny"), Side(others, "other", "otherx", "othery"), k, "all", step=step)
    nearer = F.sum("othern").over(Window.partitionBy("own").orderBy("d")) - F.sum("othern").over(Window.partitionBy("own", "d"))
    near = _cut(near.withColumn("rn", (nearer + 1).cast("int")).where(F.col("rn") <= k).select("own", "other", "ownn", "othern", "d", "rn"))
    n_pairs = near.agg(F.sum(F.col("ownn") * F.col("othern"))).first()[0] or 0

    def parts(rows: DataFrame, side: Side, found: DataFrame, kind: str) -> DataFrame:
        """(kind, part, rows): rows of a place, in parts."""
        each = rows.select(F.col(side.x).alias(f"{kind}x"), F.col(side.y).alias(f"{kind}y"), "_row", F.struct(*[F.col(f"`{c}`") for c in side.df.columns]).alias("_o"))
        part = F.pmod(F.xxhash64("_row"), F.ceil(F.col(f"{kind}n") / PART_ROWS)).alias(f"{kind}_part")
        return each.join(found, [f"{kind}x", f"{kind}y"]).groupBy(kind, part).agg(F.collect_list("_o").alias(f"{kind}_rows"))

    met = near.select("own", "other", "d", "rn").join(parts(rows, outer, own, "own"), "own").join(parts(points, inner, others, "other"), "other")
    tasks = max(math.ceil(n_pairs / TASK_PAIRS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = met.repartition(tasks, "own", "own_part", "other", "other_part") if n_pairs > TASK_PAIRS else met
    listed = met.select("d", "rn", "other_rows", F.explode("own_rows").alias("_o")).select("d", "rn", "_o", F.explode("other_rows").alias("_i"))
    return listed.select("_o.*", "_i.*", "d", "rn")


def in_place(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Rows with `_place`, their number from 0 in an order without ties, and how many there are.

    The order is made by ranges, with a row's place counted in its partition and
    the counts of the partitions before (a row a partition is broadcast).
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = _cut(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    total = counts.agg(F.sum("_m")).first()[0] or 0
    placed = ranged.join(F.broadcast(starts), "_part").withColumn("_place", F.col("_start") + F.col("_id") - F.shiftleft("_part", 33))
    return placed.drop("_part", "_id", "_start"), total


def in_order(outer: DataFrame, inner: DataFrame, value: str, limit: str) -> tuple[DataFrame, DataFrame, int]:
    """Both tables with `_place`, their rows' places in one order of limits and values, and how many rows that has.

    A limit comes before the values that equal it, so an inner row is under an
    outer row's limit if its place is lower. Equal values have a place each.
    """
    both = outer.select(F.col(limit).cast("double").alias("_v"), F.lit(0).alias("_kind"), F.struct(*outer.columns).alias("_o"), F.lit(None).cast(inner.select(F.struct(*inner.columns).alias("s")).schema["s"].dataType).alias("_i"))
    both = both.unionByName(inner.select(F.col(value).cast("double").alias("_v"), F.lit(1).alias("_kind"), F.lit(None).cast(both.schema["_o"].dataType).alias("_o"), F.struct(*inner.columns).alias("_i")))
    placed, total = in_place(both.withColumn("_n", F.monotonically_increasing_id()), "_v", "_kind", "_n")
    return placed.where("_kind = 0").select("_o.*", "_place"), placed.where("_kind = 1").select("_i.*", "_place"), total


def below(outer: Side, inner: Side, k: int, value: str, limit: str, ties: str = "break", capacity: int = quadtree.CAPACITY, step: int = 2) -> DataFrame:
    """The k nearest of the inner rows whose value is under the outer row's limit.

    Limits and values are put in one order, which is cut into ranges of RANGE_ROWS
    places, and these are joined two by two up to the whole. What is under a limit
    is then at most one group of ranges of each size, which are gone through like
    tables of their own, and the part of one range, whose rows are compared one by
    one. Only groups that some row asks for are made. Equal values fall into as
    many ranges as they fill. Null and NaN values and limits match nothing.
    """
    outer, inner, value, limit = _apart(outer, inner, value, limit)
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows, inner = numbered(Side(outer.df.where(known(limit)), outer.key, outer.x, outer.y)), inner.located()
    inner = Side(inner.df.where(known(value)), inner.key, inner.x, inner.y)
    box = bounds(Side(rows, outer.key, outer.x, outer.y), inner)
    own, ranged, total = in_order(rows.select("_row", outer.x, outer.y, limit), inner.df, value, limit)
    depth = max(0, math.ceil(math.log2(max(total / RANGE_ROWS, 1))))
    own, ranged = (df.withColumn("_range", F.floor(F.col("_place") / RANGE_ROWS)) for df in (own, ranged))
    name = lambda size, i: (size.cast("long") * 2**48 + i).alias("_group")
    sizes = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_size")
    # the range numbers before i are, for every bit of i, the ranges of that size that lead up to it
    lead = own.select("_row", outer.x, outer.y, "_range", sizes).where(F.expr("shiftright(_range, _size) % 2 = 1"))
    lead = _cut(lead.select("_row", outer.x, outer.y, name(F.col("_size"), F.expr("shiftright(_range, _size) - 1"))))
    columns = [c for c in ranged.columns if c not in ("_range", "_place")]
    groups = ranged.select(*columns, "_range", sizes).select(*columns, name(F.col("_size"), F.expr("shiftright(_range, _size)")))
    groups = _cut(groups.join(lead.select("_group").distinct(), "_group", "left_semi"))
    cells = Cells(Side(groups, inner.key, inner.x, inner.y), box, "_group", capacity, step, grouped=True)
    whole = best_k(_pairs(lead, outer, inner, k, cells), "_row", inner.key, k, ties).drop("rn")
    part = own.select("_row", outer.x, outer.y, F.col("_place").alias("_limit"), "_range").join(ranged, "_range").where(F.col("_place") < F.col("_limit"))
    part = part.withColumn("d", _distance(outer, inner)).select(*whole.columns)
    return rows.join(best_k(whole.unionByName(part), "_row", inner.key, k, ties), "_row").drop("_row")


def few_pairs(outer: Side, inner: Side) -> bool:
    """Whether a nested loop's outer rows and pairs are few; of the inner rows only so many are counted as may be met."""
    rows = outer.df.limit(NESTED_ROWS + 1).count()
    most = NESTED_PAIRS // max(rows, 1)
    return rows <= NESTED_ROWS and inner.df.limit(most + 1).count() <= most


def theta_relational(outer: Side, inner: Side, k: int, value: str, limit: str, ties: str = "break") -> DataFrame:
    """As below(), by going through all inner rows under the limit: for up to NESTED_ROWS outer rows and NESTED_PAIRS pairs, else below()."""
    if not few_pairs(outer, inner):
        return below(outer, inner, k, value, limit, ties)
    outer, inner, value, limit = _apart(outer, inner, value, limit)
    return nested_loop(outer, inner, k, ties, F.col(value) < F.col(limit))


def knn_join(outer: Side, inner: Side, k: int, strategy: str = "pruned", ties: str = "break") -> DataFrame:
    """Outer and inner columns with d and rn, for the k nearest inner rows of every outer row.

    strategy: nested_loop (only up to NESTED_ROWS outer rows and NESTED_PAIRS
    pairs, else pruned), pruned (two levels of cells a round) or rings (one level
    a round). With all ties, the last two go by places where rows share them.
    """
    outer, inner = _apart(outer, inner)
    if strategy == "nested_loop" and few_pairs(outer, inner):
        return nested_loop(outer, inner, k, ties)
    step = 1 if strategy == "rings" else 2
    found = by_places(outer, inner, k, step) if ties == "all" else None
    return pruned(outer, inner, k, ties, step=step) if found is None else found


def p_knn_first(outer: Side, inner: Side, qualify: Qualify, k: int, ties: str = "break") -> DataFrame:
    """Level P: the k nearest of all inner rows, then the predicate on those that were found."""
    asked = inner.key
    outer, inner = _apart(outer, inner)
    found = _cut(knn_join(outer, inner, k, ties=ties))
    return found.join(_asking(qualify, asked, inner.key)(found.select(inner.key).distinct()), inner.key, "left_semi")


def _all_cells(outer: Side, inner: Side, capacity: int) -> tuple[DataFrame, Cells]:
    """Numbered outer rows, and the cells of all inner points."""
    rows, inner = numbered(outer), inner.located()
    box = bounds(Side(rows, outer.key, outer.x, outer.y), inner)
    one = lambda df: df.withColumn("_group", F.lit(0))
    return one(rows), Cells(Side(one(inner.df), inner.key, inner.x, inner.y), box, "_group", capacity, 2)


def p_relational_first(outer: Side, inner: Side, qualify: Qualify, k: int, ties: str = "break", capacity: int = quadtree.CAPACITY) -> DataFrame:
    """Level P: rows that qualify first; an outer row is gone through only if one lies in its reach.

    The reach of k rows comes from the counts of all inner rows, without looking
    at a point. Where no qualifying row is that near, k others are nearer.
    """
    asked = inner.key
    outer, inner = _apart(outer, inner)
    rows, cells = _all_cells(outer, inner, capacity)
    reached = cells.reached(rows, outer.x, outer.y, k)
    keys = _cut(_asking(qualify, asked, inner.key)(inner.located().df.select(inner.key).distinct()))
    qualified = reached.join(cells.points.join(keys, inner.key, "left_semi"), ["_group", "_cell"]).where(_distance(outer, inner) <= F.col("reach"))
    left = reached.join(qualified.select("_row").distinct(), "_row", "left_semi")
    found = best_k(_pairs(rows, outer, inner, k, cells, left), "_row", inner.key, k, ties)
    return rows.join(found.join(keys, inner.key, "left_semi"), "_row").drop("_row", "_group")


def p_locality(outer: Side, inner: Side, qualify: Qualify, k: int, ties: str = "all", capacity: int = quadtree.CAPACITY) -> DataFrame:
    """Level P: the predicate within every outer row's locality, then the rank of what qualified there.

    Only points of cells in the reach of some outer row are asked for the
    predicate. What qualified shrinks an outer row's reach: to its kth, or its
    last qualifying point; cells beyond are left, and the points of those within
    give the ranks. A row without a qualifying point in reach is done.
    """
    asked = inner.key
    outer, inner = _apart(outer, inner)
    rows, cells = _all_cells(outer, inner, capacity)
    reached = cells.reached(rows, outer.x, outer.y, k)
    local = cells.points.join(reached.select("_group", "_cell").distinct(), ["_group", "_cell"], "left_semi")
    keys = _cut(_asking(qualify, asked, inner.key)(local.select(inner.key).distinct()))
    good = reached.join(local.join(keys, inner.key, "left_semi"), ["_group", "_cell"]).withColumn("d", _distance(outer, inner)).where(F.col("d") <= F.col("reach"))
    bound = best_k(good.select("_row", inner.key, "d"), "_row", inner.key, k, "break").groupBy("_row").agg(F.max("d").alias("_bound"))
    near = reached.join(bound, "_row").where(cells.gap(F.col(outer.x), F.col(outer.y)) <= F.col("_bound") * (1 + 1e-12) + cells.box[2] * 1e-12).withColumn("reach", F.col("_bound")).drop("_bound")
    found = best_k(_pairs(rows, outer, inner, k, cells, near), "_row", inner.key, k, ties)
    return rows.join(found.join(keys, inner.key, "left_semi"), "_row").drop("_row", "_group")


def q_relational_first(outer: Side, inner: Side, qualify: Qualify, k: int, ties: str = "break") -> DataFrame:
    """Level Q: the rows that qualify are written as a table of their own, and joined."""
    asked = inner.key
    outer, inner = _apart(outer, inner)
    keys = _asking(qualify, asked, inner.key)(inner.df.select(inner.key).distinct())
    qualified = Side(_cut(inner.where(keys).df), inner.key, inner.x, inner.y)
    return knn_join(outer, qualified, k, ties=ties)


def q_knn_first(outer: Side, inner: Side, qualify: Qualify, k: int, ties: str = "break", capacity: int = quadtree.CAPACITY) -> DataFrame:
    """Level Q: the nearest of all rows first, ring by ring, with the predicate on what was reached.

    The reach of 4k, 16k, ... rows comes from the counts of cells. Each turn looks
    at the points between the last reach and the next one only, asks the
    predicate for keys that were not asked before, and is over for the rows that
    have k qualifying ones by then. Where a turn would write more pairs than there
    are inner rows, the rest of the keys are asked once and the rows that are left
    go down the counts of the qualifying points. So pairs are at most 4k an outer
    row and a few times the inner rows, however few qualify.
    """
    asked_as = inner.key
    outer, inner = _apart(outer, inner)
    qualify = _asking(qualify, asked_as, inner.key)
    rows, cells = _all_cells(outer, inner, capacity)
    inner = inner.located()
    total, looked = inner.rows(), 4 * k
    left = rows.select("_row", "_group", outer.x, outer.y).withColumn("_seen", F.lit(-1.0))
    asked = good = found = None
    names = ["_row", *inner.df.columns, "d"]
    while True:
        reached = cells.reached(left.drop("_seen"), outer.x, outer.y, looked).join(left.select("_row", "_seen"), "_row")
        ring = cells.meet(reached).withColumn("d", _distance(outer, inner)).where((F.col("d") <= F.col("reach")) & (F.col("d") > F.col("_seen")))
        ring = _cut(ring.select(*names, "reach"))
        new = ring.select(inner.key).distinct()
        new = _cut(new if asked is None else new.join(asked, inner.key, "left_anti"))
        passed = _cut(qualify(new))
        asked, good = (new, passed) if asked is None else (asked.unionByName(new), good.unionByName(passed))
        hit = ring.select(*names).join(good, inner.key, "left_semi")
        found = _cut(hit if found is None else found.unionByName(hit))
        enough = found.groupBy("_row").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select("_row")
        reach = reached.groupBy("_row").agg(F.max("reach").alias("_seen"))
        left = _cut(left.drop("_seen").join(enough, "_row", "left_anti").join(reach, "_row"))
        n_left = left.count()
        if not n_left or looked >= total:
            break
        looked *= 4
        if n_left * looked > max(total, 4 * k):
            rest = inner.df.select(inner.key).distinct().join(asked, inner.key, "left_anti")
            good = _cut(good.unionByName(qualify(rest)))
            few = Side(_cut(inner.where(good).df), inner.key, inner.x, inner.y)
            ended = pruned(Side(left.drop("_seen", "_group").withColumnRenamed("_row", "row_outer"), "row_outer", outer.x, outer.y), few, k, ties, capacity)
            found = found.join(left.select("_row"), "_row", "left_anti").unionByName(ended.withColumnRenamed("row_outer", "_row").select(*names))
            break
    return rows.join(best_k(found, "_row", inner.key, k, ties), "_row").drop("_row", "_group")


def p_sweep(outer: Side, inner: Side, orders: DataFrame, parameters: predicates.Parameters, ties: str = "break") -> DataFrame:
    """(k, price_below, more_than, outer key, inner key, d, rn): the level P join for every (k, price, count) of some parameters, in one plan.

    The join runs once, for the largest k, and the orders of what it found are
    read once and counted under every price. Ties, nulls and names are as for
    other joins; no parameters give no rows.
    """
    outer, inner = _apart(outer, inner)
    found = _cut(knn_join(outer, inner, max((k for k, _, _ in parameters), default=0), ties=ties).select(outer.key, inner.key, "d", "rn"))
    mine = orders.join(found.select(F.col(inner.key).alias("o_custkey")).distinct(), "o_custkey", "left_semi")
    counts, each = predicates.swept_counts(mine, parameters)
    every = found.join(counts, F.col(inner.key) == F.col("o_custkey"), "left").select(outer.key, inner.key, "d", "rn", F.explode(each).alias("_p"))
    return every.where((F.col("rn") <= F.col("_p.k")) & (F.col("_p.n") > F.col("_p.more_than"))).select("_p.k", "_p.price_below", "_p.more_than", outer.key, inner.key, "d", "rn")


def q_sweep(outer: Side, inner: Side, orders: DataFrame, parameters: predicates.Parameters, ties: str = "break", capacity: int = quadtree.CAPACITY, step: int = 2) -> DataFrame:
    """As p_sweep() at level Q: what qualifies under each condition is a group of points, and all groups are gone through together.

    Orders are read once, each condition's join runs once for its largest k in
    the same jobs as the others, and smaller k are taken from its ranks.
    """
    conditions = sorted({(float(p), c) for _, p, c in parameters})
    counts, each = predicates.swept_counts(orders, [(i, p, c) for i, (p, c) in enumerate(conditions)])
    outer, inner = _apart(outer, inner)
    rows, inner = numbered(outer), inner.located()
    box = bounds(Side(rows, outer.key, outer.x, outer.y), inner)
    both = inner.df.select(inner.key, inner.x, inner.y).join(counts, F.col(inner.key) == F.col("o_custkey"), "left")
    both = both.select(inner.key, inner.x, inner.y, F.explode(each).alias("_p")).where(F.col("_p.n") > F.col("_p.more_than"))
    groups = _cut(both.select(inner.key, inner.x, inner.y, F.col("_p.k").alias("_group")))
    # an outer row is one row a condition, named by its number and the condition's
    n = max(len(conditions), 1)
    every = F.array(*[F.lit(i) for i in range(len(conditions))]).cast("array<bigint>")
    lead = rows.select("_row", outer.x, outer.y, F.explode(every).alias("_group"))
    lead = _cut(lead.withColumn("_row", F.col("_row") * n + F.col("_group")))
    cells = Cells(Side(groups, inner.key, inner.x, inner.y), box, "_group", capacity, step, grouped=True)
    most = max((k for k, _, _ in parameters), default=0)
    found = best_k(_pairs(lead, outer, inner, most, cells), "_row", inner.key, most, ties)
    asked = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(p)).alias("price_below"), F.lit(c).cast("long").alias("more_than"), F.lit(conditions.index((float(p), c))).alias("i")) for k, p, c in parameters])
    asked = asked.cast("array<struct<k: bigint, price_below: double, more_than: bigint, i: int>>")
    every = found.select(F.floor(F.col("_row") / n).alias("_row"), F.pmod("_row", F.lit(n)).alias("_i"), inner.key, "d", "rn", F.explode(asked).alias("_p"))
    every = every.where((F.col("_p.i") == F.col("_i")) & (F.col("rn") <= F.col("_p.k")))
    return every.join(rows.select("_row", outer.key), "_row").select("_p.k", "_p.price_below", "_p.more_than", outer.key, inner.key, "d", "rn")


def under_limit(outer: Side, inner: Side, value: str, limit: str) -> DataFrame:
    """(outer key, n_under): how many inner values are under each outer row's limit, from their places in one order.

    Null and NaN values are under nothing; outer rows without a limit have no row.
    """
    outer, inner, value, limit = _apart(outer, inner, value, limit)
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    own, _, _ = in_order(outer.df.where(known(limit)).select(outer.key, limit), inner.df.where(known(value)).select(value), value, limit)
    # a limit's place counts the limits before it too
    alone, _ = in_place(own.select(outer.key, F.col("_place").alias("_of_all")), "_of_all")
    return alone.select(outer.key, (F.col("_of_all") - F.col("_place")).alias("n_under"))


def keep_empty(result: DataFrame, outer: Side) -> DataFrame:
    """With the outer rows that have no neighbour, once each."""
    return outer.df.select(outer.key).join(result, outer.key, "left")


def as_strings(result: DataFrame, outer: Side) -> DataFrame:
    """(key, line): `x,y: d - d - ` with the farthest first, as text for people."""
    far = F.sort_array(F.collect_list("d"), asc=False)
    line = F.concat(F.first(outer.x).cast("string"), F.lit(","), F.first(outer.y).cast("string"), F.lit(": "), F.array_join(F.transform(far, lambda d: F.concat(d.cast("string"), F.lit(" - "))), ""))
    return result.groupBy(outer.key).agg(line.alias("line"))
