"""Stored layouts: equal rows, and only files near the point are read."""

import random

import pytest
from pyspark.sql import functions as F

from vicinal.operators import select
from vicinal.sources import layout, tables


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(11)
    clusters = [(rng.uniform(-5e5, 5e5), rng.uniform(0, 9e5)) for _ in range(20)]
    rows = []
    for i in range(60_000):
        cx, cy = clusters[i % 20]
        rows.append((i, round(rng.gauss(cx, 2e4 if i % 3 else 50), 1), round(rng.gauss(cy, 2e4 if i % 3 else 50), 1), "x" * 20))
    rows += [(100_000 + i, 1.0, 1.0, "one place") for i in range(300)] + [(-1, None, 1.0, "nowhere"), (-2, float("nan"), 2.0, "nowhere")]
    points = spark.createDataFrame(rows, "id long, x double, y double, note string").repartition(8)
    path = str(tmp_path_factory.mktemp("layout"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    layout.write(points, path, "x", "y")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return points.cache(), layout.read(spark, path)


def scanned(spark, df):
    """Rows that the scan of the points gave out, and the plan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df._jdf.queryExecution().executedPlan().executeCollect()
        leaves, found = df._jdf.queryExecution().executedPlan().collectLeaves(), []
        for i in range(leaves.size()):
            metric = leaves.apply(i).metrics().get("numOutputRows")
            if metric.isDefined():
                found.append(metric.get().value())
        return sum(found), df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


PLACES = [(0.0, 0.0), (1.0, 1.0), (123456.0, 777777.0), (-9e6, 4e5)]


@pytest.mark.parametrize("at", PLACES)
@pytest.mark.parametrize("k", [1, 10, 700])
def test_same_rows_as_over_the_table(stored, at, k):
    points, kept = stored
    for ties in ("break", "all"):
        got = sorted((r["d"], r["id"]) for r in layout.nearest(kept, k, at, "id", ties).collect())
        assert got == sorted((r["d"], r["id"]) for r in select.nearest(points, k, at, "x", "y", "id", ties).collect())


def test_a_select_reads_few_rows_and_pushes_places_down(spark, stored):
    points, kept = stored
    n = kept.points.count()
    assert n == kept.size() == 60_300
    for at in PLACES[2:]:
        rows, plan = scanned(spark, kept.within(at, kept.reach(at, 10)))
        assert rows < n / 5
        assert layout.PLACE in plan.split("PushedFilters")[1].split("]")[0]
    assert len(kept.ranges((0.0, 3e5), 6e5)) <= layout.RANGES


@pytest.mark.parametrize("share", [2, 3000, 10**9])
def test_level_q_ring_by_ring(stored, share):
    points, kept = stored
    keys = points.where(F.col("id") % share == 1).select("id")
    got = [tuple(r) for r in layout.q_knn_first(kept, keys, 9, (50_000.0, 4e5), "id").select("id", "d").collect()]
    assert got == [tuple(r) for r in select.q_relational_first(points, keys, 9, (50_000.0, 4e5), "x", "y", "id").select("id", "d").collect()]


def test_level_p(stored):
    points, kept = stored
    keys = points.where(F.col("id") % 3 == 1).select("id")
    got = sorted(r["id"] for r in layout.p_knn_first(kept, keys, 50, (1.0, 1.0), "id", "all").collect())
    assert got == sorted(r["id"] for r in select.p_knn_first(points, keys, 50, (1.0, 1.0), "x", "y", "id", "all").collect())


def test_bar_separated_files_to_a_layout(spark, tmp_path):
    tables.write_located(spark, "/root/testdata/sf0.001", str(tmp_path / "raw"))
    customers = tables.read_customers_tbl(spark, str(tmp_path / "raw" / "customer.tbl"))
    layout.write(customers, str(tmp_path / "stored"), "c_x", "c_y", 8)
    kept = layout.read(spark, str(tmp_path / "stored"))
    assert tables.same_rows(kept.points.drop(layout.PLACE), customers)
    got = layout.nearest(kept, 7, select.FOCUS, "c_custkey").select("c_custkey", "d").collect()
    assert got == select.nearest(customers, 7, select.FOCUS, "c_x", "c_y", "c_custkey").select("c_custkey", "d").collect()


def test_no_points_and_taken_names(spark, tmp_path):
    none = spark.createDataFrame([(1, None, 2.0)], "id long, x double, y double")
    layout.write(none, str(tmp_path / "none"), "x", "y")
    kept = layout.read(spark, str(tmp_path / "none"))
    assert kept.size() == 0 and layout.nearest(kept, 3, (0.0, 0.0), "id").count() == 0
    with pytest.raises(ValueError):
        layout.write(none.withColumn("d", F.lit(1)), str(tmp_path / "d"), "x", "y")
