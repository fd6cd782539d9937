"""Relational predicates as tables of the keys that satisfy them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables


def order_counts(orders: DataFrame, price_below: float | None = None) -> DataFrame:
    """(o_custkey, n) over orders strictly under a price, if one is given."""
    if price_below is not None:
        orders = orders.where(F.col("o_totalprice") < price_below)
    return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def by_order_count(customers: DataFrame, orders: DataFrame, more_than: int, price_below: float | None = None) -> DataFrame:
    """(c_custkey): customers with more than so many orders (under a price). Below 0, those without orders too."""
    counts = order_counts(orders, price_below)
    if more_than >= 0:
        return counts.where(F.col("n") > more_than).select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").where(F.coalesce("n", F.lit(0)) > more_than).select("c_custkey")


#: (k, price, count): the k nearest that have more than so many orders strictly under a price.
Parameters = list[tuple[int, float, int]]
#: What a swept row begins with.
SWEPT = "struct<k: bigint, price_below: double, more_than: bigint, n: bigint>"


def swept_counts(orders: DataFrame, parameters: Parameters) -> tuple[DataFrame, Column]:
    """(o_custkey, counts under every price of some parameters), from one reading of the orders; and the parameters as an array of SWEPT, n being a customer's count, 0 without orders."""
    prices = sorted({float(p) for _, p, _ in parameters})
    counts = orders.groupBy("o_custkey").agg(*[F.count_if(F.col("o_totalprice") < p).alias(f"_n{i}") for i, p in enumerate(prices)] or [F.first("o_custkey").alias("_n")])
    each = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(p)).alias("price_below"), F.lit(c).cast("long").alias("more_than"), F.coalesce(F.col(f"_n{prices.index(float(p))}"), F.lit(0)).cast("long").alias("n")) for k, p, c in parameters]
    return counts, F.array(*each).cast(f"array<{SWEPT}>")


def late_counts(suppliers: DataFrame, items: DataFrame, orders: DataFrame, mode: str = "reference") -> DataFrame:
    """(s_suppkey, late_count) for every supplier, 0 without such items.

    Counts late items of finished orders that other suppliers delivered to as
    well. reference: all items of the others were late too; tpch: none was.
    Per order and supplier the items are summed once and the order's totals are
    taken over that, so no item meets another. Items are dealt by order once,
    over as many tasks as tables.spread() takes for them, and all that is done by
    order is done there.
    """
    n = items.count()
    finished = orders.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    late = F.col("late").cast("long")
    mine = tables.spread(items, n, "l_orderkey").join(tables.spread(finished, n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    per = mine.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(late).alias("n_late"))
    own = Window.partitionBy("l_orderkey")
    whole = per.withColumns({"all": F.sum("n").over(own), "all_late": F.sum("n_late").over(own), "suppliers": F.count(F.lit(1)).over(own)})
    others_late = F.col("all_late") - F.col("n_late")
    alike = others_late == (F.col("all") - F.col("n") if mode == "reference" else F.lit(0))
    counted = whole.where(F.col("l_orderkey").isNotNull() & (F.col("suppliers") > 1) & alike).groupBy("l_suppkey").agg(F.sum("n_late").alias("late"))
    return suppliers.join(counted, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("late", F.lit(0)).cast("long").alias("late_count"))


def by_late_count(suppliers: DataFrame, items: DataFrame, orders: DataFrame, under: int, mode: str = "reference") -> DataFrame:
    """(s_suppkey): suppliers with fewer late items than this."""
    return late_counts(suppliers, items, orders, mode).where(F.col("late_count") < under).select("s_suppkey")


def histogram(counts: DataFrame, value: str) -> DataFrame:
    """(value, how_many): how often each count occurs."""
    return counts.groupBy(F.col(value).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("how_many"))


def selectivities(customers: DataFrame, orders: DataFrame, price_below: float, more_than: int) -> DataFrame:
    """One row of counts and of the shares that each condition lets through, and rejects."""
    prices = orders.agg(F.count(F.lit(1)).alias("n_orders"), F.count(F.when(F.col("o_totalprice") < price_below, 1)).alias("n_cheap"), F.countDistinct("o_totalprice").alias("n_prices"))
    counts = order_counts(orders).agg(F.count(F.when(F.col("n") > more_than, 1)).alias("n_many"))
    many = customers.agg(F.count(F.lit(1)).alias("n_customers"))
    # three one-row tables side by side
    one = lambda df: df.withColumn("_one", F.lit(1))
    row = one(prices).join(one(counts), "_one").join(one(many), "_one").drop("_one")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return row.select("n_orders", "n_prices", "n_customers", "n_cheap", "n_many", (1 - share("n_cheap", "n_orders")).alias("price_rejected"), (1 - share("n_many", "n_customers")).alias("count_rejected"))
