"""Plans of op4 are held against sets with a known optimum, brute force and the bound of packings in parts."""

import random
from collections import Counter

import pytest
from test_llm import brute_fewest

from vicinal.llm import packing
from vicinal.llm.fractional import relaxed


def valid(plan, counts, capacity):
    used = Counter()
    for filling, times in plan:
        assert sum(x * m for x, m in filling) <= capacity
        for x, m in filling:
            used[x] += m * times
    assert used == counts
    return sum(n for _, n in plan)


def quadruples():
    rng, lengths = random.Random(1), []
    while len(lengths) < 400:
        a, b, c = (rng.randint(600, 1500) for _ in range(3))
        if 600 <= 4096 - a - b - c <= 1500:
            lengths += [a, b, c, 4096 - a - b - c]
    return lengths


def test_plans_of_perfect_quadruples():
    counts = Counter(quadruples())
    assert valid(packing.plan_sequences(counts, 4096), counts, 4096) == 100


@pytest.mark.parametrize("times", [1, 100_003])
def test_plans_meet_the_bound_of_packings_in_parts(times):
    rng = random.Random(1)
    counts = Counter({x: n * times for x, n in Counter(rng.randrange(1300, 1501) for _ in range(2000)).items()})
    fewest = relaxed(counts, 4096, None)[0]
    assert valid(packing.plan_sequences(counts, 4096), counts, 4096) == fewest and fewest == (787 if times == 1 else 78_625_456)


@pytest.mark.parametrize("blind", [False, True])
def test_the_search_sees_all_packings(blind, monkeypatch):
    if blind:  # nothing but fillings around the largest piece
        monkeypatch.setattr(packing, "relaxed", lambda *a: (0, [], []))
        monkeypatch.setattr(packing, "gathered", lambda *a: None)
        monkeypatch.setattr(packing, "bound", lambda *a: 0)
        monkeypatch.setattr(packing, "best_fit", lambda counts, capacity: [(((x, 1),), n) for x, n in counts.items()])
    rng = random.Random(12)
    for seed in range(60):
        capacity = rng.choice([20, 30, 60, 100])
        lengths = [rng.randint(capacity // 10, int(capacity * rng.choice([0.45, 0.6, 0.9]))) for _ in range(rng.randint(4, 8))]
        counts, fewest = Counter(lengths), brute_fewest(lengths, capacity)
        found, none = packing.whole(counts, capacity, fewest, 10**7, seed % 3, [])
        assert not none and valid(found, counts, capacity) == fewest
        assert packing.whole(counts, capacity, fewest - 1, 10**7, seed % 3, []) == (None, True)


def test_the_bound_is_none_over_the_optimum():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([30, 60, 100])
        lengths = [rng.randint(capacity // 8, int(capacity * 0.6)) for _ in range(9)]
        assert packing.bound(Counter(lengths), capacity) <= relaxed(Counter(lengths), capacity, None)[0] <= brute_fewest(lengths, capacity)


def test_the_last_stage_of_the_pipeline_fills_every_sequence(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "a " * (n - 1)) for i, n in enumerate(quadruples())], "doc_id long, text string")
    got = corpus_pipeline.pack_sequences(spark, docs, "").toPandas()
    assert sorted(got["length"]) == sorted(quadruples())
    assert set(got.groupby("sequence_id")["length"].sum()) == {4096} and got["sequence_id"].nunique() == 100
