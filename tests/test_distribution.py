"""Sketches of distributions, sweeps of joins, and binary points read by ranges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators import join, select
from vicinal.operators.join import Side
from vicinal.plans import distribution
from vicinal.sources import binary, tables


def test_shares_are_within_the_error_whatever_the_spread_and_parts_add_up(spark, tmp_path):
    rng = random.Random(3)
    values = [rng.choice([rng.random() ** 6 * 1e6, 7.0, -rng.expovariate(1e-3)]) for _ in range(30_000)]  # a third is one value
    rows = spark.createDataFrame([(v, 1) for v in values], "v double, `column` int").repartition(6)
    parts = [distribution.summary(rows.where(F.spark_partition_id() % 2 == i), "v") for i in (0, 1)]
    parts[0].write.parquet(str(tmp_path / "stats"))
    whole = distribution.merged(spark.read.parquet(str(tmp_path / "stats")), parts[1])
    assert whole.first()["n"] == 30_000
    limits = [-1e9, 1e9, 7.0, 7.5, *rng.sample(values, 60)]
    asked = spark.createDataFrame([(v,) for v in limits], "l double")
    for stats in (whole, distribution.summary(rows, "v")):
        for r in distribution.with_share_below(asked, stats, "v", "l").collect():
            assert abs(r["share"] - sum(v < r["l"] for v in values) / len(values)) <= distribution.ERROR


def test_shares_of_odd_tables(spark):
    asked = spark.createDataFrame([(1.0,), (None,), (math.nan,)], "l double")
    rows = spark.createDataFrame([(0.0, 5), (None, 5), (math.nan, 5), (2.0, 5)], "v double, w int")
    stats = distribution.summary(rows, "v", "w")
    assert {r["column"]: r["n"] for r in stats.collect()} == {"v": 2, "w": 4}
    share = lambda s, c: sorted((r["share"] for r in distribution.with_share_below(asked, s, c, "l").collect()), key=str)
    assert share(stats, "v") == [0.5, None, None] and share(stats, "w") == [0.0, None, None]
    assert share(distribution.summary(rows.limit(0), "v"), "v") == [None] * 3 and share(stats, "none") == [None] * 3


def test_values_under_limits_are_counted_exactly(spark):
    outer = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 3, -1, 9])] + [(7, None), (8, math.nan)], "o long, v double")
    inner = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 3, 3, 1, 2, 8])] + [(9, None), (10, math.nan)], "o long, v double")
    got = join.under_limit(Side(outer, "o", "v", "v"), Side(inner, "o", "v", "v"), "v", "v").collect()
    assert sorted((r[0], r["n_under"]) for r in got) == [(0, 2), (1, 2), (2, 0), (3, 6)]


PARAMETERS = [(3, 30.0, 2), (9, 30.0, 2), (9, 60.0, 11), (9, 12.0, -1), (0, 60.0, 0), (2, 60.0, 99)]


def _orders(spark):
    return spark.createDataFrame([(i, i % 7, "F", float(i)) for i in range(80)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


def _n(key, price):
    return sum(i % 7 == key and i < price for i in range(80))


def test_a_sweep_at_level_q_equals_its_selects(spark):
    df = spark.createDataFrame([(i, float(i % 4), 0.0) for i in range(12)] + [(20, None, 1.0)], "c_key long, c_x double, c_y double")
    xy = ((0.0, 0.0), "c_x", "c_y", "c_key")
    got = [tuple(r)[:4] for r in select.q_sweep(df, _orders(spark), PARAMETERS, *xy).collect()]
    order = sorted(range(12), key=lambda i: (i % 4, i))
    assert sorted(got) == sorted((k, p, c, key) for k, p, c in PARAMETERS for key in [i for i in order if _n(i, p) > c][:k])
    assert select.q_sweep(df, _orders(spark), [], *xy).isEmpty() and select.q_sweep(df.limit(0), _orders(spark), PARAMETERS, *xy).isEmpty()


@pytest.mark.parametrize("level", ["P", "Q"])
def test_a_sweep_of_joins_equals_its_joins(spark, level):
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(9)), float(rng.randrange(9)), 0.0) for i in range(40)]  # ties
    df = spark.createDataFrame(rows + [(40, None, 1.0, 0.0)], "c long, x double, y double, d double")
    outer = spark.createDataFrame(rows[:9] + [rows[3]], "c long, x double, y double, k double")  # equal names, a repeated row
    sides = Side(outer, "c", "x", "y"), Side(df, "c", "x", "y")
    run = join.p_sweep if level == "P" else join.q_sweep
    got = sorted((*tuple(r)[:5], r["rn"]) for r in run(*sides, _orders(spark), PARAMETERS).collect())
    want = []
    for o in [*rows[:9], rows[3]]:
        order = [r[0] for r in sorted(rows, key=lambda r: ((r[1] - o[1]) ** 2 + (r[2] - o[2]) ** 2, r[0]))]
        for k, p, c in PARAMETERS:
            ranked = [key for key in order if level == "P" or _n(key, p) > c][:k]
            want += [(k, p, c, o[0], key, i + 1) for i, key in enumerate(ranked) if _n(key, p) > c]
    assert got == sorted(want)
    assert run(*sides, _orders(spark), []).isEmpty()
    assert run(sides[0], Side(df.limit(0), "c", "x", "y"), _orders(spark), PARAMETERS).isEmpty()


def test_one_binary_file_is_read_by_several_tasks(spark, tmp_path):
    yx = np.arange(2 * 10_000, dtype=">i4").reshape(-1, 2)
    (tmp_path / "points").mkdir()
    yx[:7003].tofile(tmp_path / "points" / "a.bin")
    yx[7003:].tofile(tmp_path / "points" / "b.bin")
    (tmp_path / "points" / "c.bin").write_bytes(b"")
    (tmp_path / "points" / "_SUCCESS").write_bytes(b"x")
    for path in (str(tmp_path / "points"), (tmp_path / "points").as_uri()):
        got = binary.read_points(spark, path, range_bytes=1000 * binary.POINT + 3)
        assert got.rdd.getNumPartitions() == 8 + 3
        assert sorted(tuple(r) for r in got.collect()) == [(i, 2.0 * i + 1, 2.0 * i) for i in range(10_000)]
    some = tables.read_points_binary(spark, str(tmp_path / "points"), 3)
    assert sorted(r["pos"] for r in some.collect()) == [i for i in range(10_000) if (i if i < 7003 else i - 7003) % 10 < 3]
    assert tables.read_points_binary(spark, str(tmp_path / "points" / "c.bin")).isEmpty()
    (tmp_path / "bad.bin").write_bytes(b"123456789")
    with pytest.raises(Exception, match="within a point"):
        tables.read_points_binary(spark, str(tmp_path / "bad.bin")).collect()
