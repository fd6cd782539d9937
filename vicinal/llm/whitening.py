"""Whitening of embeddings: exact scatter in residue numbers, then eigenvectors in doubles.

Vectors become whole numbers x. The scatter of x is summed without rounding: every
partition multiplies residues of x modulo several primes, small enough for a
product of doubles to be exact, sums of partitions are added modulo the primes,
and Chinese remaindering gives the sums themselves. The covariance is then one
division of whole numbers an entry, so eigenvectors are as good as doubles are,
however far the mean is from zero and however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x is floor(SCALE * entry) + OFFSET; entries beyond LIMIT are taken as LIMIT, so that x is a long.
SCALE, OFFSET, LIMIT = 64.0, 1_000_000, 2.0**62
#: Components of the result at most.
COMPONENTS = 32
#: Rows in one product, and the bits of a prime: 2**11 products under 2**42 sum to less than 2**53.
ROWS, PRIME_BITS = 2**11, 21
#: Partitions whose sums are added in one task.
PARTS = 64


def primes(bits: int) -> list[int]:
    """The largest primes under 2**PRIME_BITS whose product has more than `bits` bits."""
    found, product, at = [], 1, 2**PRIME_BITS - 1
    while product.bit_length() <= bits:
        if all(at % q for q in range(3, int(at**0.5) + 1, 2)):
            found.append(at)
            product *= at
        at -= 2
    return found


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The number nearest to zero with these residues."""
    total, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        total += product * ((r - total) * pow(product, -1, p) % p)
        product *= p
    return total - product if 2 * total > product else total


def whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64) + OFFSET


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return whole(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def finite(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with a vector of finite entries; an empty one has nothing to whiten."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where((F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))


def added(parts: DataFrame, shape: tuple[int, int], modular: bool) -> dict[int, np.ndarray]:
    """The sums of matrices (part, m, prime) by prime, in two rounds of at most PARTS matrices a task at first."""
    kind = np.int64 if modular else np.float64

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prime = int(pdf["prime"].iloc[0])
        total = np.zeros(shape, kind)
        for m in pdf.sort_values("part")["m"]:
            total += np.frombuffer(m, kind).reshape(shape)
            if modular:
                total %= prime
        return pd.DataFrame({"part": [int(pdf["part"].min()) // PARTS], "prime": [prime], "m": [total.tobytes()]})

    schema = "part long, prime long, m binary"
    once = parts.groupBy("prime", F.floor(F.col("part") / PARTS)).applyInPandas(run, schema)
    return {r["prime"]: np.frombuffer(r["m"], kind).reshape(shape) for r in once.groupBy("prime").applyInPandas(run, schema).collect()}  # a matrix a prime


@dataclass
class Whitening:
    """What a fit knows: rows n, dimension, sums and scatter of x, eigenvalues from large to small and their vectors as columns."""

    n: int
    d: int
    largest: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def used(self) -> np.ndarray:
        """Which components vary at all, as far as doubles tell."""
        return self.values > max(self.values[0], 0.0) * self.d * np.finfo(float).eps

    @property
    def projection(self) -> np.ndarray:
        """Columns that take x less its mean to whitened components; zeros for those that don't vary."""
        e = np.where(self.used, self.values, 1.0)
        return np.where(self.used, self.vectors / np.sqrt(e), 0.0)

    @property
    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.covariance))
        return np.where(self.used, self.values, 0.0) / trace if trace else np.zeros(self.d)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, without rounding: Python numbers where 64 bits might not hold them."""
        if self.n * self.largest < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)


def fit(vectors: DataFrame) -> Whitening | None:
    """Exact sums over all rows of (id, v) and the eigenvectors of their covariance; None without rows.

    The dimension is that of most rows, of several the larger.
    """
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"))
    first = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return None
    n, d = first["n"], first["d"]
    largest = int(min(SCALE * first["most"], LIMIT)) + OFFSET + 1
    moduli = primes((2 * n * largest * largest).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((d + 1, d + 1), np.int64) for _ in moduli]
        for batch in batches:
            x = _matrix(batch, d)
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                for total, p in zip(totals, moduli, strict=True):
                    r = np.ones((len(part), d + 1))  # the last column counts, and sums the others
                    r[:, :d] = part % p
                    total += (r.T @ r).astype(np.int64)
                    total %= p
        rows = len(moduli)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()] * rows, pa.int64()), "prime": pa.array(moduli, pa.int64()), "m": [t.tobytes() for t in totals]})

    sums = added(vectors.where(F.size("v") == d).select("v").mapInArrow(run, "part long, prime long, m binary"), (d + 1, d + 1), True)
    exact = [[remaindered([int(sums[p][i, j]) for p in moduli], moduli) for j in range(d + 1)] for i in range(d + 1)]
    s = exact[d][:d]
    covariance = np.array([[(n * exact[i][j] - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, vectors_ = values[order], vectors_[:, order]
    turn = np.sign(vectors_[np.argmax(np.abs(vectors_), axis=0), np.arange(d)])  # the largest entry is positive
    return Whitening(n, d, largest, s, covariance, values, vectors_ * turn)


def identity_error(vectors: DataFrame, found: Whitening, components: int) -> float:
    """The largest entry of the covariance of whitened rows less the identity, over the components that vary; measured over all rows."""
    used = int(found.used[:components].sum())
    d, w = found.d, found.projection[:, :used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((used + 1, used + 1))
        for batch in batches:
            y = found.deviations(_matrix(batch, d)).astype(np.float64) / found.n @ w
            y = np.hstack([y, np.ones((len(y), 1))])
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "prime": pa.array([0], pa.int64()), "m": [total.tobytes()]})

    total = added(vectors.where(F.size("v") == d).select("v").mapInArrow(run, "part long, prime long, m binary"), (used + 1, used + 1), False)[0]
    mean = total[:used, used] / found.n
    return float(np.abs(total[:used, :used] / found.n - np.outer(mean, mean) - np.eye(used)).max(initial=0.0))


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for every vector and component.

    Vectors that are null or empty, or hold a null, NaN or infinite entry, take no
    part, nor do those of another dimension than most (of several, the larger).
    Ids may be null, of any type and repeated: rows are rows. Fewer rows than
    dimensions, or equal ones, leave components that don't vary: whitened and
    explained are 0 there, and identity_error is over the others. A deviation
    that a long can't hold is null. An empty table gives no rows; other columns
    are not read, and may have any name.

    The driver gets matrices of the dimension's square, one a prime, and counts.
    """
    spark, key = df.sparkSession, df.schema[id_col].dataType
    vectors = finite(df, id_col, vector_col)
    schema = f"`{id_col}` {key.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(vectors)
    if found is None:
        return spark.createDataFrame([], schema)
    k = min(components, found.d)
    error = identity_error(vectors, found, k)
    d, n, w, explained = found.d, found.n, found.projection[:, :k], found.explained[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            dev = found.deviations(_matrix(batch, d))
            near = dev.astype(np.float64)
            if dev.dtype != object and float((near * near).sum(axis=1).max()) < 2.0**62:
                squares = pa.array((dev * dev).sum(axis=1), pa.int64())
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in dev]
                squares = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    squares.take(each),
                    pa.array((near / n @ w).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.where(F.size("v") == d).mapInArrow(run, schema)
