"""Conversation repair against a plain search, and odd rows."""

import hashlib
import re
import sys
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from vicinal.llm import conversations, queries

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 0:
            continue
        if f == 1:
            text = ""
        if f == 2:
            text = re.sub(r"[.!?]", "", text)
        if f == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if f == 3 else 1)
    return out


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        letters = WORD.findall(text)
        if not letters:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append(None if letters[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def plain(rows):
    """The report of one conversation, by searching what may follow each state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32], hashlib.sha256(r[3].encode()).hexdigest()))
    found = faults(rows)

    @cache
    def best(i, state, left):
        """(cost, audit, repaired) from message i on; at most `left` inserts before it."""
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if left:
            for role in ("user", "assistant"):
                if (state, role[0]) in AFTER:
                    c, a, r = best(i, role[0], left - 1)
                    options.append((c + 5, "I" + a, (f"{role}:", *r)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, r = best(i + 1, state, 3)
            options.append((c + 2, "D" + a, r))
            if found[i] not in ("blank", "duplicate"):
                more = 5 * (found[i] == "truncated")
                for letter, new, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (state, new[:1]) in AFTER:
                        c, a, r = best(i + 1, AFTER[state, new[:1]], 3)
                        options.append((c + price + more, letter + a, (f"{new}:{text}", *r)))
        return min(options) if options else (10**9, "", ())

    cost, audit, repaired = best(0, "", 3)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        found.count("blank"),
        found.count("duplicate"),
        found.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
    )


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def held(found, rows):
    got = {r[0]: tuple(r[1:]) for r in found.select(*COLUMNS).collect()}
    for conv in {r[0] for r in rows}:
        assert got[conv] == plain([r for r in rows if r[0] == conv]), conv
    return got


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_plain_search(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_conversation_repair(spark, f"/root/testdata/{size}")
    broken = damage(rows)
    got = held(found, broken)
    assert set(got) == {r[0] for r in rows}
    for conv in set(got) - {r[0] for r in broken}:
        assert got[conv] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def made(seed, n, convs, long=0):
    import random

    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "", " \t", "Why?", "so on", "é.", "a\nb."]
    rows = []
    for _ in range(n):
        conv = 0 if rng.random() < long else rng.randrange(convs)
        rows.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", "usher"]), rng.choice(texts) + (str(rng.randrange(9)) if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_repair_of_random_conversations_cut_anywhere(spark, parts):
    """Small partitions cut conversations, one of which has a third of all rows."""
    rows = made(5, 900, 60, 0.35)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        repaired = conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))
        found = conversations.report(repaired)
        if parts > 1:
            assert repaired.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 1
        assert len(held(found, rows)) == 60
        texts = repaired.select(F.explode("messages").alias("m")).where("m.edit <> 'I'").count()
        assert texts == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows(spark):
    long = "word " * 200_000 + "end."
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (2, 3, "assistant", long), (2, 5, "user", None), (3, 0, "", "x."), (4, 0, "system", "x.")]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"messages": F.lit(1), "kind": F.lit("k"), "part": F.lit(2), "same": F.lit(3), "conv": F.lit(0), "fault": F.lit(0)})
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    found = conversations.report(conversations.repair(table))
    assert len(held(found, spaced)) == 5
    named = conversations.repair(spark.createDataFrame(rows[:4], "messages long, turn long, kind string, same string"), "messages", "turn", "kind", "same")
    assert named.count() == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.report(conversations.repair(conversations.damaged(empty))).count() == 0


def test_damage_is_as_described(spark):
    rows = made(9, 300, 40)
    got = conversations.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, damage(rows)))
