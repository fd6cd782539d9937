"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool, unspool


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge: label is the smallest node that it is connected to.

    edges has columns a and b of one ordered type. Each step hangs a node's neighbours on the
    smallest of them (first the larger neighbours, then the smaller ones), so
    paths shrink fast and no node ever gathers its neighbours in one place: a
    minimum is taken per node before the shuffle, and the join back deals a hub
    over as many tasks as AQE wants. Every step is written to the shared folder.
    """
    links = spool(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), few=True)
    state = None
    for _ in range(rounds):
        both = links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct("x", F.col("m").alias("y")))).alias("e"))
        after = spool(small.select("e.x", "e.y").where(F.col("x") != F.col("y")).distinct(), few=True)
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        unspool(links)
        links = after
        if state == now:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("x").alias("node"), F.col("y").alias("label")).union(links.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())
