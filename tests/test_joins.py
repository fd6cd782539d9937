"""Joins with few qualifying rows, hot values, one place, clashing names, and tables joined with themselves."""

import math
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vicinal import catalogue
from vicinal.operators import join, predicates
from vicinal.operators.join import Side
from vicinal.sources import tables


def points(spark, n, key, seed, extra=None, at=None):
    rng = random.Random(seed)
    rows = [(i, *(at or (float(rng.randrange(5000)), float(rng.randrange(5000)))), extra(rng, i) if extra else i) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{key} long, {key}_x double, {key}_y double, {key}_v double" if extra else f"{key} long, {key}_x double, {key}_y double, {key}_v long")


def side(df, key):
    return Side(df, key, f"{key}_x", f"{key}_y")


def nearest(outer, inner, k, keep=lambda o, i: True, level="Q", ties="break"):
    """(outer, inner, rn) by looking at all pairs."""
    found = []
    for o in outer:
        all_ = sorted((math.sqrt((o[1] - i[1]) ** 2 + (o[2] - i[2]) ** 2), i[0], i) for i in inner if level == "P" or keep(o, i))
        for n, (d, key, i) in enumerate(all_):
            rank = n + 1 if ties == "break" else 1 + sum(e < d for e, _, _ in all_)
            if rank <= k and keep(o, i):
                found.append((o[0], key, rank))
    return sorted(found)


def got(df, a="o", b="i"):
    return sorted(tuple(r) for r in df.select(a, b, "rn").collect())


def few(keys, every=2000):
    return keys.where(F.col("i") % every == 7 % every)


@pytest.mark.parametrize("every", [2000, 40, 2])
def test_neighbours_first_writes_little_however_few_qualify(spark, every, monkeypatch):
    outer, o = points(spark, 60, "o", 1)
    inner, i = points(spark, 6000, "i", 2)
    written, cut = [], join._cut

    def counted(df):
        out = cut(df)
        if {"_row", "i", "d"} <= set(out.columns):
            written.append(out.count())
        return out

    monkeypatch.setattr(join, "_cut", counted)
    found = join.q_knn_first(side(o, "o"), side(i, "i"), lambda keys: few(keys, every), 5)
    assert got(found) == nearest(outer, inner, 5, lambda a, b: b[0] % every == 7 % every)
    assert sum(written) < 60 * 6000 / 5


def test_qualifying_within_the_locality(spark):
    outer, o = points(spark, 40, "o", 3)
    inner, i = points(spark, 3000, "i", 4)
    inner = [(r[0], float(r[1] // 250 * 250), float(r[2] // 250 * 250), r[3]) for r in inner]  # many ties
    i = spark.createDataFrame(inner, i.schema)
    keep = lambda a, b: b[0] % 20 == 7
    for ties in ("all", "break"):
        want = nearest(outer, inner, 30, keep, "P", ties)
        assert want and got(join.p_locality(side(o, "o"), side(i, "i"), lambda keys: few(keys, 20), 30, ties)) == want
        assert got(join.p_relational_first(side(o, "o"), side(i, "i"), lambda keys: few(keys, 20), 30, ties)) == want
    assert join.p_locality(side(o, "o"), side(i, "i"), lambda keys: keys.limit(0), 3).count() == 0


@pytest.mark.parametrize("hot", [0.0, 0.7])
def test_values_under_a_limit(spark, hot):
    """One value may be that of most rows, and limits may equal it."""
    outer, o = points(spark, 50, "o", 5, lambda rng, n: rng.choice([3.0, 5.0, -1.0, 99.0, rng.random() * 10]))
    inner, i = points(spark, 5000, "i", 6, lambda rng, n: 5.0 if rng.random() < hot else rng.random() * 10)
    found = join.below(side(o, "o"), side(i, "i"), 4, "i_v", "o_v")
    assert got(found) == nearest(outer, inner, 4, lambda a, b: b[3] < a[3])


def test_limits_are_not_written_into_the_plan(spark):
    _, o = points(spark, 50, "o", 5, lambda rng, n: rng.random())
    _, i = points(spark, 20_000, "i", 6, lambda rng, n: rng.random())
    plan = join.below(side(o, "o"), side(i, "i"), 4, "i_v", "o_v")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "Join Cross" not in plan


def test_null_limits_and_values_match_nothing(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 0.0, 0.0, float("nan")), (3, 0.0, 0.0, 5.0)], "o long, o_x double, o_y double, o_v double")
    i = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 1.0, 0.0, float("nan")), (3, 2.0, 0.0, 4.0), (4, None, 0.0, 4.0)], "i long, i_x double, i_y double, i_v double")
    assert got(join.below(side(o, "o"), side(i, "i"), 2, "i_v", "o_v")) == [(3, 3, 1)]
    assert join.below(side(o, "o"), side(i.limit(0), "i"), 2, "i_v", "o_v").count() == 0


@pytest.mark.parametrize("run", ["pruned", "nested_loop", "rings", "p_first", "q_first", "q_near", "p_local"])
def test_a_table_joined_with_itself(spark, run):
    rows, t = points(spark, 300, "o", 7)
    t = t.withColumns({"d": F.lit("x"), "rn": F.lit(1), "_row": F.lit(2)})
    a = side(t, "o")
    odd = lambda keys: keys.where(F.col("o") % 2 == 1)
    runs = {"p_first": join.p_relational_first, "q_first": join.q_relational_first, "q_near": join.q_knn_first, "p_local": join.p_locality}
    if run in runs:
        found = runs[run](a, a, odd, 3, "break")
        want = nearest(rows, rows, 3, lambda x, y: y[0] % 2 == 1, "P" if run.startswith("p") else "Q")
    else:
        found, want = join.knn_join(a, a, 3, run), nearest(rows, rows, 3)
    assert len(set(found.columns)) == len(found.columns)
    assert got(found, "o", "o_inner") == want


def test_below_on_one_table(spark):
    rows, t = points(spark, 200, "o", 8, lambda rng, n: rng.random())
    found = join.below(side(t, "o"), side(t, "o"), 3, "o_v", "o_v")
    assert got(found, "o", "o_inner") == nearest(rows, rows, 3, lambda a, b: b[3] < a[3])


def test_nested_loops_give_way_by_pairs(spark, monkeypatch):
    """Few outer rows may meet many inner ones."""
    outer, o = points(spark, 20, "o", 9, lambda rng, n: rng.random())
    inner, i = points(spark, 500, "i", 10, lambda rng, n: rng.random())
    looped, loop = [], join.nested_loop
    monkeypatch.setattr(join, "nested_loop", lambda *a, **b: looped.append(1) or loop(*a, **b))
    for most, times in ((10_000, 1), (9_999, 0)):
        monkeypatch.setattr(join, "NESTED_PAIRS", most)
        looped.clear()
        assert got(join.knn_join(side(o, "o"), side(i, "i"), 3, "nested_loop")) == nearest(outer, inner, 3) and len(looped) == times
        assert got(join.theta_relational(side(o, "o"), side(i, "i"), 3, "i_v", "o_v")) == nearest(outer, inner, 3, lambda a, b: b[3] < a[3]) and len(looped) == 2 * times


@pytest.mark.parametrize("mode", ["reference", "tpch"])
def test_late_items_are_dealt_over_tasks_of_so_many_rows(spark, duck, monkeypatch, mode):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    found = predicates.late_counts(tables.suppliers(spark, SMALL), tables.items(spark, SMALL), tables.orders(spark, SMALL), mode)
    plan = found._jdf.queryExecution().executedPlan().toString()
    tasks = -(-tables.items(spark, SMALL).count() // 100)
    assert f", {tasks}), REPARTITION_BY_NUM" in plan and plan.count("hashpartitioning(l_orderkey") == 1
    sql = catalogue.ORACLE_SQL["q21_late_counts" + ("_tpch" if mode == "tpch" else "")]
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(sql).fetchall())


@pytest.mark.parametrize("run", ["pruned", "q_near", "below"])
def test_pairs_are_dealt_over_tasks_of_so_many(spark, monkeypatch, run):
    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    outer, o = points(spark, 60, "o", 11, lambda rng, n: rng.random())
    inner, i = points(spark, 2000, "i", 12, lambda rng, n: rng.random())
    asked, meet = [], join.Cells.meet
    monkeypatch.setattr(join.Cells, "meet", lambda self, near: asked.append(self.tasks) or meet(self, near))
    a, b = side(o, "o"), side(i, "i")
    if run == "pruned":
        found, want = join.pruned(a, b, 5, capacity=16), nearest(outer, inner, 5)
    elif run == "q_near":
        found, want = join.q_knn_first(a, b, lambda keys: few(keys, 2), 5, capacity=16), nearest(outer, inner, 5, lambda x, y: y[0] % 2 == 1)
    else:
        found, want = join.below(a, b, 5, "i_v", "o_v", capacity=16), nearest(outer, inner, 5, lambda x, y: y[3] < x[3])
    assert got(found) == want and max(asked) > 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert run == "q_near" or f", {asked[-1]}), REPARTITION_BY_NUM" in plan


def test_all_ties_of_crowded_places_are_listed_without_sorting_pairs(spark, monkeypatch):
    monkeypatch.setattr(join, "PART_ROWS", 7)
    monkeypatch.setattr(join, "TASK_PAIRS", 500)
    rng = random.Random(3)
    place = lambda: (float(rng.randrange(4) * 4000), float(rng.randrange(4) * 4000))
    outer, inner = ([(i, *place(), f"{kind}{i}") for i in range(n)] for kind, n in (("o", 40), ("i", 300)))
    kind = "id long, x double, y double, v string"  # names that the sides share
    frames = [spark.createDataFrame([*rows, (900, None, 1.0, "none"), (901, float("nan"), 1.0, "nan")], kind) for rows in (outer, inner)]
    sorted_, best_k = [], join.best_k
    monkeypatch.setattr(join, "best_k", lambda pairs, *a: sorted_.append(pairs.count()) or best_k(pairs, *a))
    for k in (1, 40):
        df = join.knn_join(*[Side(f, "id", "x", "y") for f in frames], k, ties="all")
        assert df.columns == ["id", "x", "y", "v", "id_inner", "x_inner", "y_inner", "v_inner", "d", "rn"] and dict(df.dtypes)["rn"] == "int"
        want = nearest(outer, inner, k, ties="all")
        assert got(df, "id", "id_inner") == want and len(want) > 2 * sum(sorted_)
        assert {(r["v"], r["v_inner"]) for r in df.collect()} == {(f"o{a}", f"i{b}") for a, b, _ in want}
        assert all(r["d"] == math.sqrt((r["x"] - r["x_inner"]) ** 2 + (r["y"] - r["y_inner"]) ** 2) for r in df.collect())
        sorted_.clear()
    twice = frames[1].union(frames[1])  # repeated rows are rows each
    df = join.knn_join(Side(frames[0], "id", "x", "y"), Side(twice, "id", "x", "y"), 5, ties="all")
    assert got(df, "id", "id_inner") == nearest(outer, inner + inner, 5, ties="all")
    none = frames[0].where("false")
    assert join.knn_join(Side(none, "id", "x", "y"), Side(frames[1], "id", "x", "y"), 5, ties="all").count() == 0
    assert join.knn_join(Side(frames[0], "id", "x", "y"), Side(none, "id", "x", "y"), 5, ties="all").count() == 0
