"""Exact top-k by inner product with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import spool, spread

#: Rows and queries that a task scans, on average and at most.
BLOCK, QUERY_BLOCK = 16_384, 1_024
#: Cells that an axis is cut into; a code is a byte.
CELLS = 128
#: Exact vectors read first, as a multiple of k.
FIRST = 4

FILES = "dims int, block long, rows array<long>, ids array<long>, named array<boolean>, codes binary, low binary, high binary"
FOUND = "query_id long, row long, upper long"


def approximation(vectors: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's file of cells: a cell number per component, and each axis's cell edges (low, high).

    Edges are quantiles of the block's own values, as integers, so a cell holds
    about as many vectors as any other.
    """
    dims = vectors.shape[1]
    low, high = np.empty((dims, cells), np.int64), np.empty((dims, cells), np.int64)
    codes = np.empty(vectors.shape, np.uint8)
    for d in range(dims):
        column = vectors[:, d]
        edges = np.unique(np.quantile(column, np.linspace(0, 1, cells + 1)[1:-1], method="lower"))
        codes[:, d] = np.searchsorted(edges, column, "left")
        low[d], high[d] = column.min(), column.max()
        n = len(edges)
        low[d, 1 : n + 1] = edges + 1
        high[d, :n] = edges
    return codes, low, high


def files(rows: DataFrame) -> DataFrame:
    """The approximation files of (row, vec_id, v): one for the vectors of a length in a batch, built where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, part in batch.groupby("dims"):
                codes, low, high = approximation(np.stack(part["v"].to_numpy()).astype(np.int64))
                yield pd.DataFrame([(dims, part["row"].iloc[0], part["row"].to_numpy(), part["id"].to_numpy(), part["named"].to_numpy(), codes.T.tobytes(), low.tobytes(), high.tobytes())], columns=[f.split()[0] for f in FILES.split(", ")])

    # a long that is null would make its column one of doubles, so ids go with a flag
    return rows.select(F.size("v").alias("dims"), "row", F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNotNull().alias("named"), "v").mapInPandas(run, FILES)


def candidates(codes: np.ndarray, low: np.ndarray, high: np.ndarray, others: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in a file that may be among a query's k best, with their highest possible scores; codes go by axis.

    A place stays if its highest possible score reaches the kth of the lowest
    possible ones among the most promising places. (As distances: its lower
    bound, the kth upper bound.)
    """
    a, b = q[:, None] * low, q[:, None] * high
    best, worst = np.maximum(a, b), np.minimum(a, b)
    upper = np.zeros(codes.shape[1], np.int64)
    for d, cells in enumerate(codes):
        upper += best[d].take(cells)
    at = np.flatnonzero(others)
    if len(at) > k:
        n = min(len(at), 8 * k)
        promising = at[np.argpartition(upper[at], -n)[-n:]]
        lower = sum(worst[d].take(cells[promising]) for d, cells in enumerate(codes))
        at = at[upper[at] >= np.partition(lower, -k)[-k]]
    return at, upper[at]


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), of vectors that have no null or non-finite component.

    Null and empty vectors are left out; a null id stays. Components are 64-bit:
    beyond 2^63 they stop there.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(vector_col).isNotNull()).where(finite & (F.size(x) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


@F.pandas_udf(LongType())
def inner_product(q: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([int(np.asarray(a, np.int64) @ np.asarray(b, np.int64)) for a, b in zip(q, v, strict=True)], dtype="int64")


def numbered(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v), written, so that a row keeps its number."""
    return spool(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k vectors of highest inner product for every query: (query_id, rank, vec_id, score).

    Both have (vec_id, v) with long components; vectors that numbered() has
    written are not written again. Queries have an id each, one row for an id;
    rows of a query's own id are no candidates for it.

    Vectors become cell numbers, a byte a component, in files of their own
    cells; only these meet the queries, block by block, and give each query's
    candidates with the highest score that each can have. Then exact vectors
    are read in the order of that bound, by joins on their row numbers: 4k of
    them for a query, and after that those whose bound reaches the kth score
    found. All others are certain to be below it.

    Vectors of another length are no candidates. Ties go to the smaller vec_id,
    null ids last; repeated rows are candidates each. No queries or no vectors
    give no rows. Scores are 64-bit; what is beyond wraps around.
    """
    rows = vectors if "row" in vectors.columns else numbered(vectors)
    n_slots = max(1, -(-rows.count() // block))
    n_query_blocks = max(1, -(-queries.count() // query_block))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.empty(0, np.int64),) * 3]
        for f in left.itertuples():
            numbers, ids, named = np.asarray(f.rows, np.int64), np.asarray(f.ids, np.int64), np.asarray(f.named, bool)
            codes = np.frombuffer(f.codes, np.uint8).reshape(f.dims, -1).astype(np.intp)
            low, high = (np.frombuffer(x, np.int64).reshape(f.dims, -1) for x in (f.low, f.high))
            for q in right.itertuples():
                at, upper = candidates(codes, low, high, ~named | (ids != q.query_id), np.asarray(q.q, np.int64), k)
                parts.append((np.full(len(at), q.query_id, np.int64), numbers[at], upper))
        return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("query_id", "row", "upper"))})

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = spool(files(rows)).withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(n_slots)).cast("int")).withColumn("query_block", all_of(n_query_blocks))
    right = asked.withColumn("dims", F.size("q")).withColumn("query_block", spread("query_id", n_query_blocks)).withColumn("slot", all_of(n_slots))
    keys = ["dims", "slot", "query_block"]
    found = spool(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, FOUND))

    def exact(wanted: DataFrame) -> DataFrame:
        pairs = wanted.select("query_id", "row", "upper").join(rows, "row").join(asked, "query_id")
        return pairs.select("query_id", "row", "upper", "vec_id", inner_product("q", "v").alias("score"))

    place = F.struct("upper", (-F.col("row")).alias("back"))  # the order of reading, from the highest down
    ahead = Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "row")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    read = spool(exact(found.withColumn("n", F.row_number().over(ahead)).where(F.col("n") <= FIRST * k)))
    ranked = read.withColumn("rank", F.row_number().over(best))
    so_far = ranked.groupBy("query_id").agg(F.min(place).alias("last"), F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    rest = found.join(so_far, "query_id").where((F.col("upper") >= F.col("kth")) & (place < F.col("last")))
    every = read.unionByName(exact(rest))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, every: int = 20, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """top_k() of a table against itself; the queries are the rows whose id is divisible by `every`, one for an id."""
    rows = numbered(usable(df, id_col, vector_col, scale))
    return top_k(rows, rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), k)
