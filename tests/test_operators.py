import math
import struct

import pytest
from pyspark.sql import functions as F

from vicinal.functions import geometry
from vicinal.operators import join, locality, predicates, quadtree, select
from vicinal.operators.join import Side
from vicinal.plans import planner
from vicinal.sources import tables


def points(spark, rows, prefix="c"):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], f"{prefix}_key long, {prefix}_x double, {prefix}_y double")


def side(spark, rows, prefix):
    return Side(points(spark, rows, prefix), f"{prefix}_key", f"{prefix}_x", f"{prefix}_y")


def brute(outer, inner, k):
    out = set()
    for i, (x, y) in enumerate(outer):
        near = sorted((math.hypot(x - a, y - b), j) for j, (a, b) in enumerate(inner))[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    return out


def found(df):
    return {(r["s_key"], r["c_key"], r["rn"]) for r in df.collect()}


CLUSTERED = [((i * 7919) % 131, (i * 6151) % 127) for i in range(150)] + [(90000 + (i * 37) % 4001, 110000 + (i * 91) % 3001) for i in range(150)]


@pytest.mark.parametrize("strategy", ["nested_loop", "rings", "pruned"])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_join_strategies_equal_brute_force(spark, strategy, k):
    outer = [(0, 0), (131071, 131071), (60000, 60000), (91000, 111000), (50, 60)]
    got = join.knn_join(side(spark, outer, "s"), side(spark, CLUSTERED, "c"), k, strategy)
    assert found(got) == brute(outer, CLUSTERED, k)


def test_neighbour_across_a_block_border(spark):
    outer, inner = [(1, 0.5)], [(-1 + 1, 0.001), (3.001, 0.5)]
    got = join.knn_join(side(spark, outer, "s"), side(spark, inner, "c"), 1)
    assert found(got) == brute(outer, inner, 1)


def test_outer_points_out_of_the_world(spark):
    outer = [(-50, -50), (200000, 200000)]
    got = join.knn_join(side(spark, outer, "s"), side(spark, CLUSTERED, "c"), 3)
    assert found(got) == brute(outer, CLUSTERED, 3)


ODD_INNER = [(0, 5.0, 5.0), (1, None, 5.0), (2, 6.0, None), (3, float("nan"), 1.0), (4, -40.0, 7.0), (5, 3e6, -2e6), (6, 5.0, 5.0)]
ODD_OUTER = [(1, 4.0, 5.0), (1, 2.9e6, -2e6), (None, -39.0, 7.0), (None, 100.0, 0.0), (2, None, 1.0), (3, 5.0, 5.0), (3, 5.0, 5.0)]


@pytest.mark.parametrize("strategy", ["nested_loop", "rings", "pruned"])
def test_null_places_repeated_keys_and_points_anywhere(spark, strategy):
    outer = Side(spark.createDataFrame(ODD_OUTER, "s_key long, s_x double, s_y double"), "s_key", "s_x", "s_y")
    inner = Side(spark.createDataFrame(ODD_INNER, "c_key long, c_x double, c_y double"), "c_key", "c_x", "c_y")
    got = sorted((str(r["s_key"]), r["s_x"], r["c_key"], r["rn"]) for r in join.knn_join(outer, inner, 2, strategy).collect())
    good, want = [(j, a, b) for j, a, b in ODD_INNER if a is not None and b is not None and a == a], []
    for i, x, y in ODD_OUTER:
        if x is not None:
            want += [(str(i), x, j, r + 1) for r, (_, j) in enumerate(sorted((math.hypot(x - a, y - b), j) for j, a, b in good)[:2])]
    assert got == sorted(want)
    nothing = Side(inner.df.where("false"), "c_key", "c_x", "c_y")
    assert join.knn_join(outer, nothing, 2, strategy).count() == 0
    assert join.knn_join(Side(outer.df.where("false"), "s_key", "s_x", "s_y"), inner, 2, strategy).count() == 0
    assert {r["c_key"] for r in select.nearest(inner.df, 10, (0.0, 0.0), "c_x", "c_y", "c_key").collect()} == {0, 4, 5, 6}


def test_plans_of_joins_agree_and_differ(spark):
    outer, inner = side(spark, [(0, 0), (60000, 60000), (91000, 111000), (50, 60), (131000, 3)], "s"), side(spark, CLUSTERED, "c")
    qualify = lambda keys: keys.where("c_key % 7 = 0")
    kept = [p for i, p in enumerate(CLUSTERED) if i % 7 == 0]
    where = [(0, 0), (60000, 60000), (91000, 111000), (50, 60), (131000, 3)]
    q = {(s, 7 * c, r) for s, c, r in brute(where, kept, 6)}
    p = {x for x in brute(where, CLUSTERED, 6) if x[1] % 7 == 0}
    assert found(join.q_relational_first(outer, inner, qualify, 6)) == q == found(join.q_knn_first(outer, inner, qualify, 6))
    assert found(join.p_relational_first(outer, inner, qualify, 6)) == p == found(join.p_knn_first(outer, inner, qualify, 6))
    asked = []
    seen = lambda keys: asked.append(keys.count()) or qualify(keys)
    join.p_knn_first(outer, inner, seen, 6), join.p_relational_first(outer, inner, seen, 6)
    assert asked[0] <= 30 and asked[1] == len(CLUSTERED)  # only what was found, or all


def test_a_dense_cluster_costs_no_more_than_spread_points(spark):
    """Few cells and points are looked at, though nearly all points are in one place and outer rows are far from it."""
    n = 20_000
    at = lambda c, m: (F.col("id") * c) % m
    df = spark.range(n).select(F.col("id").alias("c_key"), (at(7919, 331) / 10 + 50_000).alias("c_x"), (at(6151, 337) / 10 + 70_000).alias("c_y"))
    inner = Side(df, "c_key", "c_x", "c_y")
    rows = spark.createDataFrame([(i, 50_000.0 + i, 70_000.0 + i % 7) for i in range(30)] + [(30, 1.0, 1.0)], "s_key long, s_x double, s_y double").withColumn("_row", F.col("s_key")).withColumn("_group", F.lit(0))
    cells = join.Cells(Side(df.withColumn("_group", F.lit(0)), "c_key", "c_x", "c_y"), (0.0, 0.0, tables.WORLD), "_group", 64, 2)
    looked = cells.reached(rows, "s_x", "s_y", 5).join(cells.points, ["_group", "_cell"]).groupBy("_row").count().agg(F.max("count")).first()[0]
    assert looked < 2_000
    got = {(r["s_key"], r["d"]) for r in join.knn_join(Side(rows.drop("_row", "_group"), "s_key", "s_x", "s_y"), inner, 1).collect()}
    places = df.collect()
    for s, d in got:
        x, y = (1.0, 1.0) if s == 30 else (50_000.0 + s, 70_000.0 + s % 7)
        assert d == min(math.sqrt((x - r["c_x"]) ** 2 + (y - r["c_y"]) ** 2) for r in places)


def test_joins_under_a_limit_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(join, "RANGE_ROWS", 30)
    outer = spark.createDataFrame([(i, float((i * 977) % 130_000), float((i * 331) % 130_000), None if i == 3 else float((i * 37) % 320 - 10)) for i in range(40)], "s_key long, s_x double, s_y double, s_b double")
    inner = spark.createDataFrame([(i, float(x), float(y), None if i == 5 else float(i * 53 % 300)) for i, (x, y) in enumerate(CLUSTERED)], "c_key long, c_x double, c_y double, c_b double")
    got = join.below(Side(outer, "s_key", "s_x", "s_y"), Side(inner, "c_key", "c_x", "c_y"), 4, "c_b", "s_b")
    want, rows = set(), [tuple(r) for r in inner.collect()]
    for s, x, y, b in (tuple(r) for r in outer.collect()):
        if b is not None:
            near = sorted((math.hypot(x - a, y - c), j) for j, a, c, v in rows if v is not None and v < b)[:4]
            want |= {(s, j, r + 1) for r, (_, j) in enumerate(near)}
    assert found(got) == want


def test_ties_all_keeps_equal_distances(spark):
    got = join.knn_join(side(spark, [(10, 10)], "s"), side(spark, [(10, 11), (11, 10), (9, 10), (50, 50)], "c"), 1, ties="all")
    assert {r["c_key"] for r in got.collect()} == {0, 1, 2}


def test_empty_inner_and_kept_outers(spark):
    outer = side(spark, [(1, 1), (2, 2)], "s")
    nothing = outer.df.select(F.col("s_key").alias("c_key")).where("false")
    got = join.q_relational_first(outer, side(spark, CLUSTERED, "c"), lambda keys: nothing, 5)
    assert got.count() == 0
    assert join.keep_empty(got.select("s_key", "c_key", "d"), outer).count() == 2


def test_leaves_partition_the_points_and_border_goes_low(spark):
    df = points(spark, [*CLUSTERED, (65536, 65536), (65536.5, 0), (0, 0)])
    tree = quadtree.leaves(df, "c_x", "c_y", 10)
    assert tree.agg(F.sum("n")).first()[0] == df.count()
    assigned = quadtree.assign(df, tree, "c_x", "c_y")
    assert assigned.count() == df.count()
    counts = {r["leaf"]: r["n"] for r in tree.collect()}
    assert {r["leaf"]: r["count"] for r in assigned.groupBy("leaf").count().collect()} == counts
    low = geometry.cell(F.lit(65536.0), 1, tables.WORLD)
    assert spark.range(1).select(low.alias("i")).first()["i"] == 0


def test_points_on_the_high_edge_are_outside(spark):
    df = points(spark, [(131072, 5), (5, 131072), (5, 5), (-1, 5)])
    assert quadtree.inside(df, "c_x", "c_y").count() == 1


def test_a_cluster_is_divided_below_the_first_levels(spark):
    crowd = [(70000 + i / 4, 70000 + (i * 7 % 100) / 4) for i in range(100)]  # one cell of 512 x 512
    df = points(spark, [*crowd, *CLUSTERED, *[(2000.5, 2000.5)] * 3])
    tree = quadtree.leaves(df, "c_x", "c_y", 2)
    counts = {r["leaf"]: (r["level"], r["n"]) for r in tree.collect()}
    assert max(level for level, _ in counts.values()) > quadtree.FIRST_LEVELS
    assert all(n <= 2 or level == quadtree.DEEPEST for level, n in counts.values())
    assert sum(n for _, n in counts.values()) == df.count()
    assigned = quadtree.assign(df, tree, "c_x", "c_y").groupBy("leaf").count().collect()
    assert {r["leaf"]: r["count"] for r in assigned} == {leaf: n for leaf, (_, n) in counts.items()}
    # equal places can't be divided
    assert [n for level, n in counts.values() if level == quadtree.DEEPEST] == [3]


def test_points_beyond_the_world_are_counted_and_have_no_leaf(spark):
    df = points(spark, [(131072, 5), (5, 131072), (5, 5), (-1, 5), (7, 9)])
    df = df.unionByName(spark.createDataFrame([(9, None, 1.0), (10, float("nan"), 1.0)], df.schema))
    assert tuple(quadtree.placed(df, "c_x", "c_y").first()) == (2, 3, 2)
    tree = quadtree.leaves(df, "c_x", "c_y", 1)
    got = {r["c_key"]: r["leaf"] for r in quadtree.assign(df, tree, "c_x", "c_y", outside=True).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 9, 10} and {k for k, v in got.items() if v is not None} == {2, 4}
    assert quadtree.assign(df, tree, "c_x", "c_y").count() == 2
    none = df.limit(0)
    assert tuple(quadtree.placed(none, "c_x", "c_y").first()) == (0, 0, 0)
    assert quadtree.leaves(none, "c_x", "c_y").isEmpty()
    assert quadtree.assign(df, quadtree.leaves(none, "c_x", "c_y"), "c_x", "c_y", outside=True).where("leaf IS NULL").count() == 7


def test_pivot_catalogs_equal_brute_force_without_pairing_all(spark):
    df = points(spark, [*CLUSTERED, *CLUSTERED[:5]])
    inner, tree = quadtree.leaves(df, "c_x", "c_y", 10), quadtree.leaves(points(spark, CLUSTERED[::9]), "c_x", "c_y", 4)
    got = locality.corner_catalog(tree, inner, df, "c_x", "c_y", 40)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    blocks = inner.collect()
    gap = lambda v, b, w: max(b - v, v - (b + w), 0.0)

    def cost(x, y, k):
        d = sorted(math.sqrt((a - x) ** 2 + (b - y) ** 2) for a, b in [*CLUSTERED, *CLUSTERED[:5]])[k - 1]
        return sum(math.sqrt(gap(x, r["bx"], r["w"]) ** 2 + gap(y, r["by"], r["w"]) ** 2) <= d for r in blocks)

    entries = got.collect()
    for leaf in tree.collect():
        own = sorted((r["start_k"], r["end_k"], r["n_blocks"]) for r in entries if r["block"] == leaf["leaf"])
        assert own[0][0] == 1 and own[-1][1] == 40 and all(a[1] + 1 == b[0] and a[2] < b[2] for a, b in zip(own, own[1:]))
        for k in (1, 2, 17, 40):
            x, y, w = leaf["bx"], leaf["by"], leaf["w"]
            want = max(cost(x + w * i, y + w * j, k) for i in (0, 1) for j in (0, 1))
            assert [n for a, b, n in own if a <= k <= b] == [want]
    assert locality.pivot_catalog(locality.center_pivots(tree), inner.limit(0), df.limit(0), "c_x", "c_y", 5).isEmpty()


def test_catalogs_are_contiguous_and_rise(spark):
    inner = quadtree.leaves(points(spark, CLUSTERED), "c_x", "c_y", 10)
    outer = quadtree.leaves(points(spark, CLUSTERED[::20]), "c_x", "c_y", 2)
    entries = locality.catalog(outer, inner).collect()
    for block in {r["block"] for r in entries}:
        own = sorted((r["start_k"], r["end_k"], r["n_blocks"], r["n_points"]) for r in entries if r["block"] == block)
        assert own[0][0] == 1 and own[-1][1] == locality.MAX_K
        assert all(a[1] + 1 == b[0] and a[2] <= b[2] for a, b in zip(own, own[1:]))
    for k in (1, 7, 250):
        direct = {r["block"]: r["n_blocks"] for r in locality.block_costs(outer, inner, k).collect()}
        looked = {r["block"]: r["n_blocks"] for r in locality.lookup(locality.catalog(outer, inner), k).collect()}
        assert direct == looked


GOLDEN = [((1, 10, 2), (11, 10000, 10)), ((1, 3, 5), (4, 10000, 13)), ((1, 7, 6), (8, 10000, 9)), ((1, 5, 4), (6, 10000, 8))]


def catalog_of(spark, golden):
    return spark.createDataFrame([(b, *e) for b, both in enumerate(golden) for e in both], "block long, start_k long, end_k long, n_blocks long")


def spans(df):
    return sorted(tuple(r) for r in df.select("start_k", "end_k", "n_blocks").collect())


def test_merged_catalogs(spark):
    a = catalog_of(spark, GOLDEN)
    assert spans(locality.merge_max(a)) == [(1, 3, 6), (4, 10000, 13)]
    assert spans(locality.merge_sum(a)) == [(1, 3, 17), (4, 5, 25), (6, 7, 29), (8, 10, 32), (11, 10000, 40)]
    b = catalog_of(spark, [*GOLDEN[:2], ((1, 7, 6), (8, 10000, 19)), GOLDEN[3]])
    assert spans(locality.merge_max(b)) == [(1, 3, 6), (4, 7, 13), (8, 10000, 19)]


def test_price_limit_is_strict(spark):
    orders = spark.createDataFrame([(1, 7, "F", 100.0), (2, 7, "F", 99.0), (3, 8, "F", 100.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    customers = spark.createDataFrame([(7, 0.0), (8, 0.0), (9, 0.0)], "c_custkey long, c_acctbal double")
    keys = lambda n: {r[0] for r in predicates.by_order_count(customers, orders, n, 100.0).collect()}
    assert keys(0) == {7} and keys(1) == set() and keys(-1) == {7, 8, 9}


def test_late_counts_in_both_modes(spark):
    orders = spark.createDataFrame([(1, 0, "F", 1.0), (2, 0, "F", 1.0), (3, 0, "O", 1.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    items = spark.createDataFrame([(1, 10, True), (1, 11, True), (2, 10, True), (2, 11, False), (3, 10, True), (3, 11, True)], "l_orderkey long, l_suppkey long, late boolean")
    suppliers = spark.createDataFrame([(10,), (11,), (12,)], "s_suppkey long")
    count = lambda mode: {r[0]: r[1] for r in predicates.late_counts(suppliers, items, orders, mode).collect()}
    assert count("reference") == {10: 1, 11: 1, 12: 0}
    assert count("tpch") == {10: 1, 11: 0, 12: 0}


def test_select_plans_agree(spark):
    df = points(spark, CLUSTERED)
    keys = df.where("c_key % 3 = 0").select("c_key")
    at, xy = (91000.0, 111000.0), ("c_x", "c_y", "c_key")
    rows = lambda d: [tuple(r) for r in d.orderBy("d", "c_key").select("c_key", "d").collect()]
    assert rows(select.p_relational_first(df, keys, 20, at, *xy)) == rows(select.p_knn_first(df, keys, 20, at, *xy))
    q = rows(select.q_relational_first(df, keys, 20, at, *xy))
    assert q == rows(select.q_knn_first(df, keys, 20, at, *xy, 10)) == rows(select.q_browse(df, keys, 20, at, *xy)) and len(q) == 20
    assert len(rows(select.nearest(df, 10_000, at, *xy))) == len(CLUSTERED)


def test_planner_takes_the_cheaper_plan():
    s = planner.Statistics(1000, 100, 0.5, 0.5)
    assert planner.choose((10.0, 10.0)) == planner.RELATIONAL_FIRST
    assert planner.choose((10.0, 9.0)) == planner.KNN_FIRST
    assert planner.select_costs("P", s, 8, 2, 40) == (2 * 500 + 25 * 5.0, 40 + 80.0)


def test_text_and_binary_sources(spark, tmp_path):
    (tmp_path / "o.tbl").write_text("1|7|F|12.5|1996-1-2|x|y|0|c|\n2|8|O|3.0|1996-01-02|x|y|0|c|\n")
    assert [tuple(r) for r in tables.read_orders_tbl(spark, str(tmp_path / "o.tbl")).orderBy("o_orderkey").collect()] == [(1, 7, "F", 12.5), (2, 8, "O", 3.0)]
    (tmp_path / "l.tbl").write_text("1|2|3|1|1|1|1|1|A|F|1996-3-13|1996-2-12|1996-3-22|D|T|c|\n")
    assert tables.read_items_tbl(spark, str(tmp_path / "l.tbl")).first()["late"] is True
    (tmp_path / "c.tbl").write_text("4|n|a|1|p|-3.5|B|c|10.0,20.0|\n")
    assert tuple(tables.read_customers_tbl(spark, str(tmp_path / "c.tbl")).first()) == (4, -3.5, 10.0, 20.0)
    (tmp_path / "s.tbl").write_text("4|n|a|1|p|-3.5|c|10.0,20.0|\n")
    assert tuple(tables.read_suppliers_tbl(spark, str(tmp_path / "s.tbl")).first()) == (4, -3.5, 10.0, 20.0)
    (tmp_path / "p.bin").write_bytes(b"".join(struct.pack(">ii", i, -i) for i in range(30)))
    assert tables.read_points_binary(spark, str(tmp_path / "p.bin"), 3).count() == 9
    assert tuple(tables.read_points_binary(spark, str(tmp_path / "p.bin")).where("pos = 4").first()) == (4, -4.0, 4.0)
    (tmp_path / "p.txt").write_text("1.5,2.5\n")
    assert tuple(tables.read_points_text(spark, str(tmp_path / "p.txt")).first()) == (2.5, 1.5)


def test_leaves_round_trip(spark, tmp_path):
    tree = quadtree.leaves(points(spark, CLUSTERED), "c_x", "c_y", 10)
    tables.write_leaves(tree, str(tmp_path / "tree"))
    assert tables.same_rows(tree, tables.read_leaves(spark, str(tmp_path / "tree")))


def test_a_query_pushes_its_filter_to_the_scan(spark):
    keys = predicates.by_order_count(tables.customers(spark, "/root/testdata/sf0.001"), tables.orders(spark, "/root/testdata/sf0.001"), 5, 250_000)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_totalprice,250000.0)" in plan and "o_orderstatus" not in plan.split("ReadSchema")[1]


def test_catalogs_places_and_query_points_round_trip(spark, tmp_path):
    entries = catalog_of(spark, [((1, 3, 2), (4, 6, 5)), ((1, 6, 1),)])
    tables.write_catalog(entries, str(tmp_path / "c"))
    assert tables.same_rows(entries, tables.read_catalog(spark, str(tmp_path / "c")))
    for per_k, n in ((False, 3), (True, 12)):
        tables.write_catalog_csv(entries, str(tmp_path / f"v{n}"), per_k)
        assert spark.read.option("header", True).csv(str(tmp_path / f"v{n}")).count() == n
    small = "/root/testdata/sf0.001"
    tables.write_located(spark, small, str(tmp_path))
    assert tables.same_rows(tables.read_customers_tbl(spark, str(tmp_path / "customer.tbl")), tables.customers(spark, small))
    assert tables.same_rows(tables.read_suppliers_tbl(spark, str(tmp_path / "supplier.tbl")), tables.suppliers(spark, small))
    (tmp_path / "p.txt").write_text("".join(f"{i},{-i}\n" for i in range(100)))
    points_ = tables.with_positions(tables.read_points_text(spark, str(tmp_path / "p.txt")))
    assert [(r["pos"], r["y"]) for r in tables.query_points(points_).orderBy("pos").collect()] == [(0, 0.0), (27, 27.0), (54, 54.0), (81, 81.0)]


def test_scans_by_distance(spark):
    df = points(spark, CLUSTERED)
    tree = quadtree.leaves(df, "c_x", "c_y", 10)
    at = (91000.0, 111000.0)
    near = [r["min_d"] for r in select.locality_scan(tree, at, 2000.0).collect()]
    assert near == sorted(near) and 0 < len(near) < tree.count() and near[-1] <= 2000.0
    explored = select.browsed_leaves(df, 20, at, "c_x", "c_y", 10).first()[0]
    assert explored == locality.select_cost(df, tree, at, 20, "c_x", "c_y").first()[0]


def test_a_sweep_equals_its_selects_one_by_one(spark):
    df = points(spark, [(i % 4, 0) for i in range(12)])  # ties
    orders = spark.createDataFrame([(i, i % 5, "F", float(i)) for i in range(60)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    parameters = [(3, 30.0, 2), (9, 30.0, 2), (9, 60.0, 11), (9, 12.0, -1), (0, 60.0, 0)]
    xy = ((0.0, 0.0), "c_x", "c_y", "c_key")
    got = select.p_sweep(df, orders, parameters, *xy).collect()
    n = lambda key, price: sum(i % 5 == key and i < price for i in range(60))
    order = sorted(range(12), key=lambda i: (i % 4, i))
    want = {(k, price, c, key) for k, price, c in parameters for key in order[:k] if n(key, price) > c}
    assert {(r["k"], r["price_below"], r["more_than"], r["c_key"]) for r in got} == want and len(got) == len(want)
    assert select.p_sweep(df, orders, [], *xy).isEmpty() and select.p_sweep(df.limit(0), orders, parameters, *xy).isEmpty()
