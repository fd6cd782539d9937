"""Mix sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, positions, spool, spread

#: Hash buckets a size band of a source is split into, so that no task holds a hot source.
SPREAD = 64


def targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """What each source should give: (source, key, source_size, target).

    sized has source and size. Sources in code point order, null last, take the
    weights in turn and share `share` of all sizes; a target stops at `most`
    times its source's size, and what is over goes to the others by weight. In
    closed form: by rising ratio of limit to weight, the sources up to the first
    whose share of the rest fits under its limit stand at their limits.

    One row per source, so the windows without a key see only that many rows.
    """
    order = [F.col("source").asc_nulls_last()]
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(Window.orderBy(*order)) - 1, F.lit(len(weights))).cast("int") + 1)
    sources = sources.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), *order)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c: F.coalesce(c, F.lit(0.0))
    rest = F.lit(float(share)) * F.sum("source_size").over(everything) - first(F.sum("limit").over(above))
    level = rest / (F.sum("weight").over(everything) - first(F.sum("weight").over(above)))
    sources = sources.withColumn("level", level).withColumn("at", F.row_number().over(by_ratio))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("at", "level"))
    found = F.min(fits).over(everything)["level"]
    return sources.withColumn("found", found).select(
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
        "source_size",
        "n_docs",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("limit", F.coalesce(F.col("weight") * F.col("found"), F.col("limit")))).alias("target"),
    )


def _copied(docs: DataFrame, source: Column, size: Column, doc_id: Column, weights: Sequence[float], share: float, most: int, seed: str, spread_n: int) -> DataFrame:
    """docs with _mix_size, _mix_source_size, _mix_target and _mix_copies added to their columns."""
    size_ = F.col("_mix_size")
    bits = F.length(F.bin(size_))
    band = bits * 16 + F.when(bits > 4, F.expr("shiftright(_mix_size, cast(length(bin(_mix_size)) - 4 as int))")).otherwise(size_)
    sized = (
        docs.withColumns({"_mix_source": source, "_mix_id": doc_id, "_mix_size": size})
        .withColumns({"_mix_key": F.coalesce(F.concat(F.lit("="), "_mix_source"), F.lit("")), "_mix_band": band.cast("int"), "_mix_sub": spread("_mix_id", spread_n)})
    )
    plan = targets(sized.select(F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size")), weights, share, most)
    plan = plan.select(F.col("key").alias("_mix_key"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    placed = positions(sized, "_mix_key", ["_mix_band", "_mix_sub"], ["_mix_size", "_mix_id"], "_mix_position")
    at, total = F.col("_mix_position"), F.col("_mix_source_size")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "_mix_key")), 1, 4), 16, 10).cast("double") / 65536
    rate = F.when(total > 0, F.col("_mix_target") / total).otherwise(0.0)
    copies = F.least(F.floor(rate * (at + 1) + offset) - F.floor(rate * at + offset), F.lit(most)).cast("long")
    return placed.join(plan, "_mix_key").withColumn("_mix_copies", copies)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    seed: str = "mix",
    spread_n: int = SPREAD,
) -> DataFrame:
    """How often each document enters the mix: (doc_id, source, size, source_size, target, copies, taken).

    A document of a source is expected target / source_size times. The expected
    copies are summed along the source's documents in order of size band, hash
    bucket, size and id; with one offset per source, drawn from the seed, a copy
    comes out at each integer that the sum crosses. In order of size, the words
    taken stay near the target. Sizes are words; a null text has none.

    Texts are read once, for their sizes. Null ids sort first and share a
    bucket; repeated rows are numbered like others, so they may get different
    copies; null sources are a source; an empty table gives no rows; other
    columns are not read.
    """
    sized = spool(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size")))
    copied = _copied(sized, F.col("source"), F.col("size"), F.col("doc_id"), weights, share, most, seed, spread_n)
    copies = F.col("_mix_copies")
    return copied.select("doc_id", "source", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    seed: str = "mix",
    spread_n: int = SPREAD,
) -> DataFrame:
    """The documents of the mix, each as often as mix() takes it, with their own columns.

    Rows keep their columns on the way, so ids need not be unique.
    """
    names = docs.columns
    copied = _copied(docs, F.col(source_col), n_words(text_col), F.col(id_col), weights, share, most, seed, spread_n)
    taken = copied.where(F.col("_mix_copies") > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return taken.select(*names)
