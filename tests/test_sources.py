"""Samples with replacement."""

from collections import Counter

from vicinal.sources import tables


def test_a_sample_with_replacement_has_exactly_n_rows_and_is_even(spark):
    points = spark.createDataFrame([(float(i), float(-i)) for i in range(50)], "x double, y double").coalesce(3)
    drawn = tables.sample_points(points, 5000, seed=7)
    got = Counter(r["x"] for r in drawn.collect())
    assert sum(got.values()) == 5000 and len(got) == 50
    assert 50 < min(got.values()) and max(got.values()) < 160
    assert got == Counter(r["x"] for r in tables.sample_points(points, 5000, seed=7).collect())
    assert got != Counter(r["x"] for r in tables.sample_points(points, 5000, seed=8).collect())
    assert tables.sample_points(points, 3, seed=1).count() == 3 and tables.sample_points(points, 0).count() == 0
    assert tables.sample_points(points.limit(0), 9).count() == 0
