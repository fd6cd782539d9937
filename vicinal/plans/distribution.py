"""How the values of columns are spread, as a table of mergeable sketches, for estimates of conditions on values.

A sketch is made in every task and merged, so a column is read once and nothing
but sketches is moved. A summary is a table with a row a column; it can be
saved, and summaries of parts of a table (a day's rows, say) add up to that of
the whole without reading the parts again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch (some 20 KB), and points at which a distribution is kept for reading.
SKETCH, POINTS = 2048, 256
#: How far an estimated share of rows may be from the true one.
ERROR = 0.01


def _read(sketch: str) -> list[Column]:
    """How many values a sketch has seen, and values at evenly spaced shares of them, in order."""
    n = F.kll_sketch_get_n_double(sketch)
    shares = F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)])
    points = F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, shares)).otherwise(F.array().cast("array<double>"))
    return [n.alias("n"), points.alias("points")]


def summary(rows: DataFrame, *columns: str) -> DataFrame:
    """(column, n, points, sketch) for number columns of a table.

    n counts the values that are neither null nor NaN; without such there are no
    points. Other columns are not read. An empty table gives a row a column, with
    n = 0.
    """
    names = [f"_{i}" for i in range(len(columns))]
    made = rows.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)]).agg(*[F.kll_sketch_agg_double(n, F.lit(SKETCH)).alias(n) for n in names])  # one row
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(n).alias("sketch")) for c, n in zip(columns, names)])
    return made.select(F.inline(each)).select("column", *_read("sketch"), "sketch")


def merged(*summaries: DataFrame) -> DataFrame:
    """The summary of the tables of several summaries put together."""
    all_of = reduce(DataFrame.unionByName, summaries)
    return all_of.groupBy("column").agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch")).select("column", *_read("sketch"), "sketch")


def with_share_below(rows: DataFrame, stats: DataFrame, column: str, limit: str, name: str = "share") -> DataFrame:
    """Rows with the estimated share of the column's values that are under their limit, within ERROR.

    What every task gets is POINTS numbers. The share is null for a null or NaN
    limit and for a column without values. `name` may not be a column of the rows.
    """
    points = f"_points_{name}"
    one = stats.where(F.col("column") == column).limit(1).select(F.col("points").alias(points))  # one row of POINTS numbers
    known = F.col(f"`{limit}`").isNotNull() & ~F.isnan(F.col(f"`{limit}`").cast("double")) & (F.size(points) > 0)
    under = F.size(F.filter(points, lambda p: p < F.col(f"`{limit}`").cast("double")))
    found = rows.join(F.broadcast(one), F.lit(True), "left")
    return found.withColumn(name, F.when(known, under / F.size(points))).drop(points)


def within_error(estimate: Column, share: Column) -> Column:
    return F.abs(estimate - share) <= ERROR
