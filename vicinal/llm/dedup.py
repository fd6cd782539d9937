"""Near-duplicate documents: DartMinHash signatures, banded join, exact verification, classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool
from .components import components

#: Words in a shingle, and the similarity from which two documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of a signature and coordinates of a band. A pair at 0.8 shares no band with probability 1e-4, one at 0.4 shares
#: one with probability 0.03: families of loosely related texts would otherwise fill the buckets.
BANDS, ROWS = 50, 8
#: Documents that are hashed together, and words remembered, in a task.
CHUNK, REMEMBERED = 128, 500_000
#: Ends of the rank levels that darts are thrown on: the last holds 16,384 darts of even one element.
LEVELS = tuple(4.0**e for e in range(-3, 8))

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... events, as far as a double tells them from 1."""
    n = np.arange(int(mean + 12 * mean**0.5 + 24))
    logs = n * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(n))))])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def unit_cells(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An element for each unit of weight: the first keeps its name, the nth is named after n too.

    So weighted sets become plain ones, but for a fraction that the last unit may have.
    """
    cells = np.ceil(weights).astype(np.int64)
    if not len(cells) or cells.max() <= 1:
        return elements, weights, owner
    rows = np.repeat(np.arange(len(elements)), cells)
    cell = np.arange(len(rows)) - np.repeat(np.cumsum(cells) - cells, cells)
    named = np.where(cell == 0, elements[rows], mixed(elements[rows] + cell.astype(_U) * _U(0x9E3779B97F4A7C15)))
    return named, np.minimum(weights[rows] - cell, 1.0), owner[rows]


class Darts:
    """DartMinHash with k coordinates.

    Darts fall on (element, weight, rank) at rate 1, placed by hashes, so sets
    that share an element see the same darts on it. A dart that lands below its
    element's weight counts; it belongs to one of k coordinates, and each
    coordinate keeps the dart of lowest rank. Two signatures agree at a
    coordinate with the probability of their weighted Jaccard similarity. Ranks
    are gone through in levels until every coordinate has a dart, which takes
    about k log k darts a set, however many elements it has.
    """

    def __init__(self, k: int):
        self.k = k
        self.levels = [(a, b, _poisson(b - a)) for a, b in zip((0.0, *LEVELS), LEVELS, strict=False)]

    def sign(self, elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Signatures (n x k, uint32) of n sets at once: elements (uint64) with weights, and the set each belongs to.

        A set without elements keeps zeros.
        """
        k = self.k
        sig, full = np.zeros(n * k, np.uint32), np.zeros(n * k, bool)
        elements, weights, owner = unit_cells(elements, weights, owner)
        partial = bool((weights < 1).any())
        todo = np.zeros(n, bool)
        todo[owner] = True
        for level, (low, high, cdf) in enumerate(self.levels):
            at = todo[owner]
            if not at.any():
                break
            if not at.all():
                elements, weights, owner = elements[at], weights[at], owner[at]
            key = mixed(elements + _U((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            count = np.searchsorted(cdf, unit(key), "right")
            hit = np.nonzero(count)[0]
            count = count[hit]
            source = np.repeat(hit, count)
            nth = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
            dart = mixed(key[source] ^ mixed(nth.astype(_U) + _U(0x632BE59BD9B4E019)))
            place = owner[source] * k + (dart % _U(k)).astype(np.int64)
            good = ~full[place]
            if partial:
                good &= unit(mixed(dart ^ _U(0x2545F4914F6CDD1D))) < weights[source]
            dart, place = dart[good], place[good]
            rank = mixed(dart ^ _U(0xD6E8FEB86659FD93))  # order within the level
            order = np.argsort(rank)[::-1]
            sig[place[order]] = (dart[order] >> _U(32)).astype(np.uint32)  # the last to be written has the lowest rank
            full[place] = True
            todo &= ~full.reshape(n, k).all(1)
        return sig.reshape(n, k)


def word_hasher():
    """A function from texts to (words of each text, their 64-bit hashes in order), which remembers words."""
    import xxhash

    class Known(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = h = xxhash.xxh3_64_intdigest(word)
            return h

    known = Known()

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        return n, np.fromiter(map(known.__getitem__, chain.from_iterable(words)), _U, n.sum())

    return run


def windows(texts: list[str], size: int, hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every run of words as long as a shingle, in order.

    A text with fewer words than a shingle is one shingle; one without words has none.
    """
    n, h = hashes(texts)
    starts = np.cumsum(n) - n
    runs = np.where(n < size, n > 0, n - size + 1)
    few = np.nonzero((n > 0) & (n < size))[0]
    total, of_few = np.zeros(len(h), _U), np.zeros(len(few), _U)  # by first word; those of short texts apart
    for i in range(size):
        part = mixed(h[i:] + _U(i + 1))
        part *= _U(2 * i + 3)
        total[: len(part)] += part
        more = i < n[few]
        of_few[more] += part[starts[few][more]]
    total[starts[few]] = of_few
    begins = np.arange(runs.sum()) + np.repeat(starts - np.cumsum(runs) + runs, runs)
    return mixed(total[begins]), np.repeat(np.arange(len(texts)), runs)


def shingles(texts: list[str], size: int, hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts: (hashes, times in the text, number of the text), by text and hash."""
    total, owner = windows(texts, size, hashes)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(cut, cut[1:]):
        total[a:b].sort()
    first = np.ones(len(total), bool)
    first[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    starts = np.nonzero(first)[0]
    return total[starts], np.diff(np.append(starts, len(total))), owner[starts]


def weighted_sets(part: list[str], size: int, hashes, counted: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The shingles of texts by text: (elements, bounds of each text, a name for each text's elements).

    If counted, a shingle is an element for each time it occurs, else one. The
    name is a 128-bit hash; equal ones have equal elements.
    """
    import xxhash

    elements, times, owner = shingles(part, size, hashes)
    if counted:
        elements, _, owner = unit_cells(elements, times.astype(float), owner)
    cut = np.searchsorted(owner, np.arange(len(part) + 1))
    return elements, cut, [xxhash.xxh3_128_digest(elements[a:b].tobytes()) for a, b in zip(cut, cut[1:])]


SIGNED = "id long, node binary, n int, bands array<long>"


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """(id, node, n, bands) per document: node is a 128-bit hash of its n shingles, or of the id if it has none.

    Null ids get one from the text, below all others. A shingle weighs 1, or if
    counted as often as it occurs.
    """
    darts = Darts(bands * rows)
    salt = mixed(np.arange(1, bands + 1, dtype=_U))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = word_hasher()
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                n = len(part)
                elements, cut, names = weighted_sets(part["text"].tolist(), shingle, hashes, counted)
                sizes = np.diff(cut)
                sig = darts.sign(elements, np.ones(len(elements)), np.repeat(np.arange(n), sizes), n)
                packed = sig.reshape(n, bands, rows).astype(_U)
                key = np.broadcast_to(salt, (n, bands)).copy()
                for r in range(rows):
                    key = mixed(key * _U(3) + packed[:, :, r])
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "node": [name if m else b"id %d" % i for i, name, m in zip(part["id"], names, sizes, strict=True)],
                        "n": sizes,
                        "bands": [row if m else row[:0] for row, m in zip(key.astype(np.int64), sizes, strict=True)],
                    }
                )

    return texts(docs, id_col, text_col).mapInPandas(run, SIGNED)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(internal_id(id_col, text_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shingle_sets(rows: DataFrame, shingle: int, counted: bool, hasher: Callable = word_hasher) -> DataFrame:
    """(id, node, shingles) of rows (id, text): the shingles as uint64 in a row of bytes, and their node as in signed(); hasher makes the function that hashes words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = hasher()
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                elements, cut, names = weighted_sets(part["text"].tolist(), shingle, hashes, counted)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "node": names, "shingles": [elements[a:b].tobytes() for a, b in zip(cut, cut[1:])]})

    return rows.mapInPandas(run, "id long, node binary, shingles binary")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(rep, own): how many shingles of a set are in no other one; sets without such have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                found = [np.frombuffer(x, "<i8") for x in part["shingles"]]
                yield pd.DataFrame({"rep": np.repeat(part["rep"].to_numpy(), [len(x) for x in found]), "shingle": np.concatenate(found)})

    once = sets.mapInPandas(run, "rep binary, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("rep")).where(F.col("m") == 1)
    return once.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))


def node_key(id_: Column, node: Column) -> Column:
    """16 bytes that name a node and sort by its smallest id: the id, and a hash that tells nodes with one id apart."""
    digits = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(digits(id_.bitwiseXOR(F.lit(-(2**63)))), digits(F.xxhash64(node)))


def id_of(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))


def internal_id(id_col: str, text_col: str):
    """The id, or for a null one a number made from the text."""
    made = F.bitwise_not(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2))
    return F.coalesce(F.col(id_col).cast("long"), made)


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) with how many shingles both have, and whether that makes them near copies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            common, near = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
            for i, (x, y) in enumerate(zip(pdf["shingles_a"], pdf["shingles_b"], strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common[i] = (both[1:] == both[:-1]).sum()
                near[i] = common[i] >= similarity * (len(x) + len(y) - common[i])
            yield pdf[["a", "b"]].assign(common=common, near=near)

    side = lambda s: sets.select(F.col("rep").alias(s), F.col("shingles").alias(f"shingles_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(run, "a binary, b binary, common long, near boolean")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of every node that has met a link, after more links (a, b): only what these bring together is gone through."""
    if links.isEmpty():
        return labels
    at = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where(F.col("a") != F.col("b"))
    found = components(ends)
    least = found.select(F.col("node").alias("label"), F.col("label").alias("_least"))
    old = labels.join(least, "label", "left").select("node", F.coalesce("_least", "label").alias("label"))
    return spool(old.union(found.join(labels, "node", "left_anti").select("node", "label")), few=True)


def mixed_buckets(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several classes, each with its label."""
    named = placed.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
    several = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high"))
    return named.join(several.select("band"), "band", "left_semi")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """(id, class_id) per document: documents joined by a chain of near copies share a class, named by its smallest id.

    Near copies have a Jaccard similarity of at least `similarity` between their
    sets of word shingles; if counted, between these weighted by how often they
    occur (the sum of the smaller weights by the sum of the larger ones), so
    that what is said over and over weighs more than what is said once.

    Documents with equal shingles are one node, whatever their ids. Nodes that
    share a band meet in its bucket; all that are near copies there are found,
    but not by forming all pairs:

    - a shingle that no other node has is in no intersection, so a node with
      too many of them for any partner in its bucket leaves it;
    - every bucket has a leader, the node with the least share of such shingles,
      which is the one most like the others, and its members are compared with
      it; linked ones are a class from then on, and only pairs across classes
      are left. Buckets with several classes get a second leader from another;
    - of the pairs left, those are compared that may be near copies by what they
      share with the leader: two nodes have at most the smaller of these parts
      in common, and of the rest at most the smaller number of shared shingles.

    All three rules are exact. The work does not grow with the square of a group
    of near copies; it does in a group of texts that are loosely alike through
    shingles of many, with none linked, which costs a look at each pair.

    Documents without words are classes of their own. Rows that share an id
    share a class, also if their texts differ; repeated rows are rows each. Null
    ids get a negative one made from their text. An empty table gives no rows;
    other columns are not read.
    """
    share = similarity / (1 + similarity)  # of both sizes, what near copies have in common at least
    base = spool(signed(docs, id_col, text_col, shingle, bands, rows, counted))
    nodes = base.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = spool(nodes.select("node", node_key(F.col("id"), F.col("node")).alias("rep"), "n", "bands"))
    several = base.groupBy("id").agg(F.min(F.xxhash64("node")).alias("low"), F.max(F.xxhash64("node")).alias("high")).where(F.col("low") < F.col("high"))
    shared = base.join(several, "id", "left_semi").join(nodes.select("node", "rep"), "node").select("id", "rep")
    same_id = spool(shared.join(shared.groupBy("id").agg(F.min("rep").alias("a")), "id").where(F.col("a") < F.col("rep")).select("a", F.col("rep").alias("b")).distinct(), few=True)
    labels = joined(same_id.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0), same_id)

    met = nodes.select(F.explode("bands").alias("band"), "rep", "n")
    buckets = spool(met.join(met.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("band"), "band"), few=True)
    ids = buckets.select(id_of(F.col("rep")).alias("id")).distinct()
    some = texts(docs, id_col, text_col).join(ids, "id", "left_semi").withColumn("_md5", F.md5("text")).dropDuplicates(["id", "_md5"])
    sets = shingle_sets(some.select("id", "text"), shingle, counted).select(node_key(F.col("id"), F.col("node")).alias("rep"), "shingles")
    sets = spool(sets.join(buckets.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"]))

    rest = F.col("n") - F.coalesce("own", F.lit(0))
    placed = buckets.join(own_shingles(sets), "rep", "left").select("band", "rep", "n", rest.alias("rest"), (rest / share - F.col("n") + 1e-6).alias("most"))
    sizes = placed.groupBy("band").agg(F.min("n").alias("least_n"), F.max("most").alias("largest"))
    placed = placed.join(sizes, "band").where((F.col("most") >= F.col("least_n")) & (F.col("n") <= F.col("largest"))).drop("least_n", "largest")
    placed = spool(placed.drop("most"), few=True)

    # what is known of a node before it has met a leader: all that it shares may be the leader's, or none
    placed = placed.withColumns({"lead": F.lit(None).cast("binary"), "in_lead": F.col("rest"), "beside": F.col("rest")})
    enough = lambda a, b: F.least(f"in_lead{a}", f"in_lead{b}") + F.least(f"beside{a}", f"beside{b}") >= share * (F.col(f"n{a}") + F.col(f"n{b}")) - 1e-6
    for turn in range(2):
        placed = spool(mixed_buckets(placed, labels), few=True)
        former = placed.where(F.col("rep") == F.col("lead")).select("band", F.col("label").alias("led"))
        central = F.struct((1 - F.col("rest") / F.col("n")).alias("own"), F.xxhash64("rep").alias("h"), "rep", "label", "n", "in_lead", "beside")
        best = placed.join(former, "band", "left").groupBy("band").agg(F.min(F.when(~F.col("label").eqNullSafe(F.col("led")), central)).alias("best"))
        inside = placed.join(best.select("band", *[F.col(f"best.{c}").alias(f"{c}_2") for c in ("rep", "label", "n", "in_lead", "beside")]), "band")
        todo = inside.where((F.col("label") != F.col("label_2")) & ~F.col("rep").eqNullSafe(F.col("lead")) & enough("", "_2"))
        found = spool(compared(todo.select(F.col("rep_2").alias("a"), F.col("rep").alias("b")).distinct(), sets, similarity), few=True)
        labels = joined(labels, found.where("near").select("a", "b"))
        if turn == 0:
            known = found.select(F.col("a").alias("lead"), F.col("b").alias("rep"), "common")
            placed = placed.drop("lead").join(best.select("band", F.col("best.rep").alias("lead")), "band").join(known, ["lead", "rep"], "left")
            placed = placed.withColumns({"in_lead": F.coalesce("common", "rest"), "beside": F.coalesce(F.col("rest") - F.col("common"), F.col("rest"))}).drop("common", "label")
        else:
            placed = inside.where((F.col("rep") != F.col("lead")) & (F.col("rep") != F.col("rep_2"))).select("band", "rep", "n", "in_lead", "beside")
    placed = spool(mixed_buckets(placed, labels), few=True)
    other = placed.select("band", *[F.col(c).alias(f"{c}_2") for c in ("rep", "label", "n", "in_lead", "beside")])
    pairs = placed.join(other, "band").where((F.col("label") < F.col("label_2")) & enough("", "_2"))
    pairs = pairs.select(F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b")).distinct()
    labels = joined(labels, spool(compared(pairs, sets, similarity).where("near").select("a", "b"), few=True))

    own = base.select("id", "node").join(nodes.select("node", "rep"), "node").select("id", "rep")
    return own.join(labels, F.col("rep") == labels["node"], "left").select("id", id_of(F.coalesce("label", "rep")).alias("class_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class: that with the smallest id. Repeated rows of it are one; columns stay as they are."""
    names = docs.columns
    kept = classes(docs, id_col, text_col, **options).where(F.col("id") == F.col("class_id")).select(F.col("id").alias("_kept")).distinct()
    rows = docs.withColumns({"_near_id": internal_id(id_col, text_col), "_near_text": F.md5(F.coalesce(F.col(text_col), F.lit("")))})
    return rows.join(kept, F.col("_near_id") == F.col("_kept"), "left_semi").dropDuplicates(["_near_id", "_near_text"]).select(*names)
