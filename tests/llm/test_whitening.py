"""Whitening against whole-number sums in plain Python, and odd rows."""

import math

import numpy as np
import pytest

from vicinal.llm import queries, whitening

SMALL = "/root/testdata/sf0.001"


def plain(vectors):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    dev = [[n * r[i] - s[i] for i in range(d)] for r in x]
    scatter = [[sum(r[i] * r[j] for r in dev) for j in range(d)] for i in range(d)]
    cov = np.array([[scatter[i][j] / n**3 for j in range(d)] for i in range(d)])
    return n, [sum(v * v for v in r) for r in dev], np.array([[v / n for v in r] for r in dev]), cov


def test_query_equals_plain_sums(spark):
    pdf = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    n, deviation, centred, cov = plain(pdf["embedding"])
    out = queries.op12_embedding_whitening(spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == n * 32 and set(out["n"]) == {n}
    ids = sorted(pdf["vec_id"])
    want = dict(zip(pdf["vec_id"], deviation, strict=True))
    assert out.drop_duplicates("vec_id").set_index("vec_id")["deviation"].to_dict() == want
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    place = {v: i for i, v in enumerate(pdf["vec_id"])}
    y = (centred @ vectors / np.sqrt(values))[[place[i] for i in ids]][:, :32]
    got = out["whitened"].to_numpy().reshape(n, 32)
    assert np.allclose(np.abs(got), np.abs(y), rtol=1e-6, atol=1e-8)
    assert np.allclose(got.T @ got / n, np.eye(32), atol=1e-9)
    assert np.allclose(out["explained"].to_numpy()[:32], (values / values.sum())[:32], rtol=1e-9)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9


def test_scatter_is_exact_for_large_entries(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(3000, 5)) * np.array([1e9, 1e12, 1.0, 1e5, 3.0]) + 1e10).astype(np.float32)
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "id long, v array<float>").repartition(7)
    found = whitening.fit(whitening.finite(table, "id", "v"))
    _, _, _, cov = plain(vectors)
    assert (found.covariance == cov).all()


def test_remainders_give_signed_numbers_back():
    moduli = whitening.primes(200)
    assert len(set(moduli)) == len(moduli) and math.prod(moduli).bit_length() > 200
    for v in (0, 1, -1, 2**150 + 7, -(2**190)):
        assert whitening.remaindered([v % p for p in moduli], moduli) == v


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (None, [3.0, 5.5]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, float("inf")]), (1, [1.0, 2.0]), (7, [1.0]), (8, [-4.0, 0.5])]
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, component string, v int")
    out = whitening.whitened(table).toPandas()
    assert len(out) == 8 and set(out["n"]) == {4} and out["vec_id"].isna().sum() == 2
    _, deviation, _, _ = plain([[1, 2], [3, 5.5], [1, 2], [-4, 0.5]])
    assert sorted(out[out.component == 1]["deviation"]) == sorted(deviation)
    assert out["identity_error"].max() < 1e-9
    assert whitening.whitened(table.limit(0)).count() == 0
    same = spark.createDataFrame([("a", [2.0, 3.0, 4.0])] * 3, "vec_id string, embedding array<double>")
    flat = whitening.whitened(same).toPandas()
    assert len(flat) == 9 and (flat[["deviation", "whitened", "explained", "identity_error"]] == 0).all().all()
    huge = whitening.whitened(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0])], "vec_id long, embedding array<float>")).toPandas()
    assert huge["deviation"].isna().all() and np.isfinite(huge["whitened"]).all()


@pytest.mark.parametrize("parts", [1, 9])
def test_sums_do_not_depend_on_partitions(spark, parts):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    a = whitening.fit(whitening.finite(table, "vec_id", "embedding"))
    b = whitening.fit(whitening.finite(table.repartition(parts), "vec_id", "embedding"))
    assert (a.covariance == b.covariance).all() and a.sums == b.sums
