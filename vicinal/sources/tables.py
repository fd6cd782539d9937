"""Tables with locations and lateness, and the readers of the text and binary forms of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import binary

#: The world: points lie in [0, WORLD) on both axes.
WORLD = 131072.0
#: Rows of a task where tables are dealt by key, which bounds its memory; fewer rows are left to the session's settings.
TASK_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows dealt by keys over tasks of about TASK_ROWS, or more tasks if the session says so; n is how many rows there are.

    A number of tasks that is asked for stays, so a task's memory doesn't grow
    with the table. Few rows are not moved.
    """
    if n <= TASK_ROWS:
        return rows
    return rows.repartition(max(math.ceil(n / TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _spread(nation: str, key: str, by: int, factor: int, shift: int, modulus: int) -> Column:
    """A whole-numbered coordinate from keys: one of five clusters, and a place in it."""
    return (((F.col(nation).cast("long") * by) % 5) * 20000 + (F.col(key) * factor + shift) % modulus).cast("double")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, c_acctbal, c_x, c_y)."""
    t = table(spark, sf_dir, "customer")
    return t.select("c_custkey", "c_acctbal", _spread("c_nationkey", "c_custkey", 37, 7919, 13, 15013).alias("c_x"), _spread("c_nationkey", "c_custkey", 11, 10473, 17, 15031).alias("c_y"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, s_acctbal, s_x, s_y)."""
    t = table(spark, sf_dir, "supplier")
    return t.select("s_suppkey", "s_acctbal", _spread("s_nationkey", "s_suppkey", 37, 6151, 29, 15013).alias("s_x"), _spread("s_nationkey", "s_suppkey", 11, 5021, 31, 15031).alias("s_y"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_suppkey, late): late if the receipt day, counted from shipping, is after the commit day."""
    receipt = (F.col("l_orderkey") * 17 + F.col("l_partkey") * 13 + F.col("l_linenumber") * 5) % 30 + 1
    commit = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % 61 - 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (receipt > commit).alias("late"))


def _pipe(spark: SparkSession, path: str, names: dict[int, str], last: int) -> DataFrame:
    """A file with fields between bars and a bar at the end; bad lines fail the job."""
    fields = [names.get(i, f"_{i} string") for i in range(last + 1)]
    return spark.read.option("sep", "|").option("mode", "FAILFAST").option("dateFormat", "yyyy-M-d").schema(", ".join([*fields, "_end string"])).csv(path)


def read_orders_tbl(spark: SparkSession, path: str) -> DataFrame:
    return _pipe(spark, path, {0: "o_orderkey long", 1: "o_custkey long", 2: "o_orderstatus string", 3: "o_totalprice double"}, 8).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def read_items_tbl(spark: SparkSession, path: str) -> DataFrame:
    t = _pipe(spark, path, {0: "l_orderkey long", 2: "l_suppkey long", 11: "l_commitdate date", 12: "l_receiptdate date"}, 15)
    return t.select("l_orderkey", "l_suppkey", "l_commitdate", "l_receiptdate", (F.col("l_receiptdate") > F.col("l_commitdate")).alias("late"))


def _located(t: DataFrame, prefix: str) -> DataFrame:
    at = F.split("point", ",")
    return t.select(t.columns[0], f"{prefix}_acctbal", at[0].cast("double").alias(f"{prefix}_x"), at[1].cast("double").alias(f"{prefix}_y"))


def read_customers_tbl(spark: SparkSession, path: str) -> DataFrame:
    """Customers with a last field `x,y`."""
    return _located(_pipe(spark, path, {0: "c_custkey long", 5: "c_acctbal double", 8: "point string"}, 8).select("c_custkey", "c_acctbal", "point"), "c")


def read_suppliers_tbl(spark: SparkSession, path: str) -> DataFrame:
    """Suppliers with a last field `x,y`."""
    return _located(_pipe(spark, path, {0: "s_suppkey long", 5: "s_acctbal double", 7: "point string"}, 7).select("s_suppkey", "s_acctbal", "point"), "s")


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    """(x, y) from lines `y,x`."""
    return spark.read.option("mode", "FAILFAST").schema("y double, x double").csv(path).select("x", "y")


def with_positions(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Rows numbered from 0 in the order they are read in, by the counts of the partitions before; a row a partition is broadcast."""
    own = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = own.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_id") - F.shiftleft("_part", 33))
    return numbered.select(name, *rows.columns)


def read_points_binary(spark: SparkSession, path: str, scale: int = 10) -> DataFrame:
    """(pos, x, y) from big-endian int32 pairs y, x, by ranges of bytes: see binary.read_points()."""
    return binary.read_points(spark, path, scale)


def sample_points(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n points drawn with replacement, each equally likely at every draw; none of an empty table.

    Every draw is a position, met with the numbered points by an equi-join, so
    nothing of the sample or the table is in one place. Draws depend on the seed
    only; which points they are, on the order in which the table is read.
    """
    numbered = with_positions(points, "_pos")
    total = points.count()
    if not total:
        return points.limit(0)
    draws = points.sparkSession.range(0, n, 1, max(1, min(200, n // 100_000 + 1))).select(F.floor(F.rand(seed) * total).alias("_pos"))
    return draws.join(numbered, "_pos").select(*points.columns)


def query_points(points: DataFrame, every: int = 27, pos: str = "pos") -> DataFrame:
    """Every 27th point as a query point."""
    return points.where(F.col(pos) % every == 0)


def write_leaves(leaves: DataFrame, path: str) -> None:
    """Save a quadtree's leaves with their counts."""
    leaves.write.mode("overwrite").parquet(path)


def read_leaves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often: the check of a save and load."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Save catalog entries as Parquet, by block and first k."""
    catalog.write.mode("overwrite").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries as write_catalog() saved them."""
    return spark.read.parquet(path)


def write_catalog_csv(catalog: DataFrame, path: str, per_k: bool = False) -> None:
    """Save entries as CSV with a header, for plotting: a row an entry, or a row for every k."""
    (catalog_per_k(catalog) if per_k else catalog).write.mode("overwrite").option("header", True).csv(path)


def write_located(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Save the customers and suppliers of raw tables with their places, as bar-separated lines that the readers here take.

    Fields that the readers don't look at stay empty; the last one is `x,y`.
    """
    for t, key, balance, prefix, last, name in (
        (customers(spark, sf_dir), "c_custkey", "c_acctbal", "c", 8, "customer"),
        (suppliers(spark, sf_dir), "s_suppkey", "s_acctbal", "s", 7, "supplier"),
    ):
        fields = {0: F.col(key).cast("string"), 5: F.col(balance).cast("string"), last: F.concat_ws(",", f"{prefix}_x", f"{prefix}_y")}
        line = F.concat(F.concat_ws("|", *[F.coalesce(fields.get(i, F.lit("")), F.lit("")) for i in range(last + 1)]), F.lit("|"))
        t.select(line.alias("value")).write.mode("overwrite").text(f"{path}/{name}.tbl")


def catalog_per_k(catalog: DataFrame) -> DataFrame:
    """A row for every k of every entry, for plotting."""
    return catalog.withColumn("k", F.explode(F.sequence("start_k", "end_k"))).drop("start_k", "end_k")


def levels_for(n: int, capacity: int) -> int:
    """Levels that bring evenly spread points under a capacity, with two to spare for clusters."""
    return max(1, math.ceil(math.log(max(n / capacity, 1), 4))) + 2
