"""The n-gram Jaccard join against all pairs."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from vicinal.llm import jaccard_join, queries
from vicinal.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows):
    lower = str.maketrans(jaccard_join.UPPER, jaccard_join.LOWER)
    found = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(lower))
        found.append({tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set())
    return found


def plain(rows):
    """(n, component) of every row by comparing all pairs that share a shingle."""
    sets, up = sets_of(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(i)
    ids: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        up[root(i)] = root(ids.setdefault(doc, i))
    for i, s in enumerate(sets):
        for j in {j for t in s for j in holders[t] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 90 * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def held(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_join.join(table).collect())) == plain(rows)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_all_pairs(spark, size):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_ngram_jaccard_join(spark, f"/root/testdata/{size}").select("doc_id", "n_shingles", "component_id").collect()
    want = plain(rows)
    assert sorted(map(tuple, got)) == want
    assert len({c for _, _, c in want}) < len(want)


def test_words_are_hashed_together_in_lower_case(monkeypatch):
    """Counts and hashes of the words of texts tell apart what their words in lower case do, whatever is hashed together."""
    rng = random.Random(5)
    parts = ["a", "B", "b", "Cc", "dÉ", "é", "x" * 63, "x" * 64, "X" * 65, "x" * 200, "\x1c", "\ud800"]
    texts = [rng.choice(["", " "]) + rng.choice([" ", "\t \n", "\x0b", "\x0c\r"]).join(rng.choices(parts, k=rng.choice([0, 1, 2, 5, 40]))) for _ in range(60)]
    lower = str.maketrans(jaccard_join.UPPER, jaccard_join.LOWER)
    words = [WORD.findall(t.translate(lower)) for t in texts]
    n, h = jaccard_join.word_hasher()(texts)
    assert n.tolist() == [len(w) for w in words]
    named = dict(zip(h.tolist(), [x for w in words for x in w], strict=True))
    assert len(named) == len({x for w in words for x in w}) and [named[x] for x in h.tolist()] == [x for w in words for x in w]
    monkeypatch.setattr(jaccard_join, "BYTES", 50)
    assert all((a == b).all() for a, b in zip((n, h), jaccard_join.word_hasher()(texts), strict=True))


def test_rarest_takes_the_first_of_equal_counts():
    for often in ([3, 1, 1, 2, 1, 0], [5] * 7, [2**61, 4, 4, 2**61, 1], [], [1]):
        for most in range(1, 9):
            want = np.argsort(np.array(often, np.int64), kind="stable")[:most]
            assert sorted(jaccard_join.rarest(np.array(often, np.int64), most)) == sorted(want)


def test_what_is_read_no_more_is_deleted(spark):
    """Of the rarest shingles of all documents nothing stays in the shared folder."""
    spools = lambda: {p for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.name.startswith("spool-")}
    before = spools()
    table = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7, 300))) for i in range(40)], "doc_id long, text string")
    assert jaccard_join.join(table).count() == 40
    left = [set(spark.read.parquet(str(p)).columns) for p in spools() - before]
    assert {"id", "node", "n"} in left and not any("bands" in columns for columns in left)


def family(rng, words, n, edits, first):
    base = [rng.choice(words) for _ in range(120)]
    rows = [(first, " ".join(base))] if rng.random() < 0.5 else []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(copy))
            what = rng.random()
            if what < 0.4:
                copy[at] = rng.choice(words)
            elif what < 0.7:
                del copy[at]
            else:
                copy.insert(at, rng.choice(words))
        rows.append((first + 1 + i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_families_at_the_threshold(spark, seed):
    """Copies with few and many edits, over many groups, some linked by chains only, with a line that all share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(6):
        rows += family(rng, words, (220, 90, 40, 10, 3, 2)[f], (4, 3, 6, 2, 2, 1)[f], 1000 * f)
    line = " " + " ".join(words[:30])
    rows = [(i, t + line if i % 2 else t) for i, t in rows]
    rng.shuffle(rows)
    held(spark, rows)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two"), (8, "two one"), (9, long), (10, long + " end"), (11, "Ä b c"), (12, "ä b c"), (13, "a b c a b c a b c"), (14, "a b c a b"), (14, "other text of one id"), (15, "other text of one id"), (16, "x y z"), (16, "x y z")]
    held(spark, rows)
    table = spark.createDataFrame([(None, "a b c d"), (20, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.join(table).collect()))
    assert len(got) == 3 and got[2][0] == 20 and got[2][2] < 0 and sum(r[1] == 2 for r in got) == 2
    assert jaccard_join.join(table.limit(0)).count() == 0
    named = spark.createDataFrame([(1, "a b c", 0, "x")], "band long, home string, rep int, node string")
    assert jaccard_join.join(named, "band", "home").collect()[0][1] == 1
