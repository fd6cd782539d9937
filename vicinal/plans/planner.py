"""Choose between relational-first and neighbours-first by cost.

Costs are in rows and leaves touched. The statistics are two one-row
aggregates; the catalog values are those of the leaf that holds the focal point
(select) or the sum over the outer leaves (join). Neighbours-first is taken only
if it is strictly cheaper.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import locality, predicates, quadtree

RELATIONAL_FIRST, KNN_FIRST = "relational_first", "knn_first"


@dataclass(frozen=True)
class Statistics:
    """Sizes, and the shares of rows that the price and the count condition reject."""

    n_orders: int
    n_customers: int
    price_rejected: float
    count_rejected: float

    @property
    def orders_per_customer(self) -> float:
        return max(self.n_orders / max(self.n_customers, 1), 1.0)

    @property
    def passing(self) -> float:
        """The share that passes at least one condition, as the cost model has it."""
        return max(1 - self.price_rejected * self.count_rejected, 1e-9)

    @property
    def cheap(self) -> int:
        return int(self.n_orders * (1 - self.price_rejected))

    @property
    def qualifying(self) -> int:
        return int(self.cheap / self.orders_per_customer * (1 - self.count_rejected))


def statistics(customers: DataFrame, orders: DataFrame, price_below: float, more_than: int) -> Statistics:
    row = predicates.selectivities(customers, orders, price_below, more_than).first()
    return Statistics(row["n_orders"], row["n_customers"], row["price_rejected"], row["count_rejected"])


def _log(k: int) -> float:
    return math.log2(max(k, 2))


def select_costs(level: str, s: Statistics, k: int, n_blocks: int, n_points: int) -> tuple[float, float]:
    """(relational-first, neighbours-first) of a select; the catalog values are for k at level P and for k / passing at Q."""
    if level == "P":
        return 2 * s.cheap + s.qualifying * (_log(k) + n_blocks), n_points + s.orders_per_customer * k
    return 2 * s.cheap + s.qualifying * _log(k), n_points * s.orders_per_customer


def join_costs(level: str, s: Statistics, k: int, outer_leaves: int, merged_blocks: int) -> tuple[float, float]:
    """(relational-first, neighbours-first) of a join."""
    first = outer_leaves * s.qualifying / 500
    return (first + 2 * outer_leaves * _log(k) if level == "P" else first), float(merged_blocks)


def prefers_locality(selectivity: Column, n_inner: int, k: int, capacity: int = quadtree.CAPACITY) -> Column:
    """Whether an outer row should read its locality and not the rows that satisfy the condition."""
    share = F.greatest(selectivity, F.lit(1e-9))
    return share * n_inner / capacity > F.lit(k) / (share * capacity)


def uniform_selectivity(balance: Column, low: float = -999.99, high: float = 9999.99) -> Column:
    """Share of balances below one, if they were evenly spread."""
    return F.least(F.greatest((balance - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def choose(costs: tuple[float, float]) -> str:
    return KNN_FIRST if costs[1] < costs[0] else RELATIONAL_FIRST


def for_select(level: str, customers: DataFrame, orders: DataFrame, at: tuple[float, float], k: int, price_below: float, more_than: int, x: str = "c_x", y: str = "c_y") -> str:
    s = statistics(customers, orders, price_below, more_than)
    tree = quadtree.leaves(customers, x, y)
    looked = k if level == "P" else math.ceil(k / s.passing)
    cost = locality.block_costs(locality.enclosing(tree, at), tree, looked).first()
    blocks, points = (cost["n_blocks"], cost["n_points"]) if cost else (0, s.n_customers)
    return choose(select_costs(level, s, k, blocks, points))


def for_join(level: str, outer_leaves: DataFrame, inner_leaves: DataFrame, s: Statistics, k: int, step: int = 1) -> str:
    looked = k if level == "P" else min(math.ceil(k / s.passing), max(s.n_customers - 1, 1))
    merged = locality.join_cost_sampled(outer_leaves, inner_leaves, looked, step).first()["cost"]
    return choose(join_costs(level, s, k, outer_leaves.count(), merged or 0))


def explain(level: str, costs: tuple[float, float]) -> str:
    """One line about a choice."""
    return f"{level}-level: relational-first {costs[0]:.0f}, neighbours-first {costs[1]:.0f}: {choose(costs)}"
