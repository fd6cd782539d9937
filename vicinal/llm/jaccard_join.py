"""Documents joined by the Jaccard similarity of their word shingles, through a token-group matrix.

Similar documents are put in groups, and a group's row of the matrix is the union
of its members' shingles. How much of a document lies in that union bounds what it
can share with any member; only groups whose bound reaches the threshold are opened
and compared member by member.

Which groups a document looks at comes from rare shingles: of two linked
documents, each has at most a tenth of its shingles outside the other, so with one
order of all shingles they have one in common among their first tenths, and several if
they look a little further. The order puts frequent shingles last, by counts in a
table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, positions, spool, spread, unspool
from .dedup import CHUNK, id_of, internal_id, joined, mixed, mixed_buckets, node_key, shingle_sets, shingles, windows

#: Words in a shingle, and the similarity of linked documents in hundredths.
SHINGLE, PERCENT = 3, 90
#: Cells of the table of counts (a power of two), members of a group, queries of it that are looked at together.
COUNTS, MEMBERS, QUERIES_AT_ONCE = 2**18, 64, 64
#: Columns of a group's matrix in one product.
COLUMNS = 2**16
#: Tables of counts that are added in one task.
PARTS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places of a word that have numbers of their own for each byte, and bytes that are hashed together.
PLACES, BYTES = 64, 2**20


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(internal_id(id_col, text_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def word_hasher():
    """A function from texts to (words of each text, their 64-bit hashes in order): A-Z count as a-z.

    A word's hash is the sum of random numbers for its bytes at their places,
    so all words of some texts are hashed by a few array operations. After so
    many places the numbers come again, mixed with how often they did.
    """
    numbers = mixed(np.arange(1, 256 * PLACES + 1, dtype=np.uint64)).reshape(PLACES, 256)
    numbers[:, list(UPPER.encode())] = numbers[:, list(LOWER.encode())]
    numbers, blank = numbers.ravel(), np.zeros(256, bool)
    blank[list(BLANKS.encode())] = True

    def some(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)  # begins and ends with a blank
        out = blank[data]
        edges = np.nonzero(out[1:] != out[:-1])[0] + 1
        begins, sizes = edges[::2], edges[1::2] - edges[::2]
        first = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum(), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
        value = numbers[place % PLACES * 256 + data[~out]]
        far = np.nonzero(place >= PLACES)[0]
        value[far] = mixed(value[far] + (place[far] // PLACES).astype(np.uint64))
        texts = np.cumsum([1 + len(t) for t in raw])
        n = np.diff(np.searchsorted(begins, texts), prepend=0)
        return n, np.add.reduceat(value, first) if len(first) else value

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        part = np.cumsum([len(t) for t in raw]) // BYTES
        found = [some(raw[a:b]) for p in np.unique(part) for a, b in [np.searchsorted(part, [p, p + 1])]]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return run


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTS.bit_length() + 1)).astype(np.int64)


def shingle_counts(rows: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How often shingles occur, by cells of their hashes: a table of fixed size, summed over all rows (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total, any_rows = word_hasher(), np.zeros(COUNTS, np.int64), False
        for pdf in batches:
            any_rows = any_rows or len(pdf) > 0
            for at in range(0, len(pdf), CHUNK):
                tokens, _ = windows(pdf["text"].iloc[at : at + CHUNK].tolist(), shingle, hashes)
                total += np.bincount(_cell(tokens), minlength=COUNTS)
        if any_rows:
            yield pd.DataFrame({"m": [total.astype(np.int64).tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [sum((np.frombuffer(m, np.int64) for m in pdf["m"]), np.zeros(COUNTS, np.int64)).tobytes()]})

    once = rows.select("text").mapInPandas(run, "m binary").groupBy(F.floor(F.spark_partition_id() / PARTS)).applyInPandas(add, "m binary")
    found = once.groupBy().applyInPandas(add, "m binary").collect()  # one table
    return np.frombuffer(found[0]["m"], np.int64) if found else np.zeros(COUNTS, np.int64)


def needed(n: int) -> int:
    """Shingles that a set of n has in common with a linked one at least."""
    return -(-PERCENT * n // 100)


def also(n: int) -> int:
    """Rare shingles that two linked sets have in common at least, if the smaller one has n.

    Each set looks at that many more of its rarest shingles than may be missing
    in the other. Chance meets in one shingle are many, in several few.
    """
    return 1 + (n - needed(n)) // 2


def rarest(often: np.ndarray, most: int) -> np.ndarray:
    """Where the `most` least counts are, in any order; of equal ones the first."""
    if most >= len(often):
        return np.arange(len(often))
    bits = len(often).bit_length()
    if int(often.max()) >> (63 - bits):
        return np.argsort(often, kind="stable")[:most]
    named = (often << bits) | np.arange(len(often))
    named.partition(most - 1)
    return named[:most] & ((1 << bits) - 1)


def signed(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, node, n, home, bands, ask) per row (id, text): a hash that names the set of n shingles, its least one, its rarest ones, and how many of these any linked set has.

    A document without words has a node of its own and nothing else.
    """
    counts = rows.sparkSession.sparkContext.broadcast(shingle_counts(rows, shingle))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes = word_hasher()
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                tokens, _, owner = shingles(part["text"].tolist(), shingle, hashes)
                cut = np.searchsorted(owner, np.arange(len(part) + 1))
                often, found = counts.value[_cell(tokens)], tokens.view(np.int64)
                names, homes, bands, ask = [], [], [], []
                for i, (a, b) in enumerate(zip(cut, cut[1:])):
                    names.append(xxhash.xxh3_128_digest(tokens[a:b].tobytes()) if b > a else b"id %d" % part["id"].iloc[i])
                    homes.append(int(found[a]) if b > a else 0)
                    size = int(b - a)
                    rare = rarest(often[a:b], size - needed(size) + also(size))
                    bands.append(found[a:b][rare])
                    ask.append(also(needed(size)))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "node": names, "n": np.diff(cut), "home": homes, "bands": bands, "ask": ask})

    return rows.mapInPandas(run, "id long, node binary, n int, home long, bands array<long>, ask int")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the left sets shares with each of the right ones: products of 0/1 matrices, some columns at a time."""
    every = np.concatenate([*left, *right])
    names, column = np.unique(every, return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    total = np.zeros((len(left), len(right)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, len(names), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        m = np.zeros((len(left) + len(right), min(COLUMNS, len(names) - low)), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total.astype(np.int64)


def linked(both: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Whether the similarity reaches the threshold, in whole numbers."""
    return 100 * both >= PERCENT * (n_left[:, None] + n_right[None, :] - both)


class _Forest:
    """Union-find over labels, to give only links that bring something together."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: bytes, b: bytes) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column]


def _own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's union, and links that hold together those of its members that are linked."""
    pdf = pdf.sort_values("rep").drop_duplicates("rep")
    sets, reps = _sets(pdf["shingles"]), pdf["rep"].tolist()
    n = np.array([len(s) for s in sets])
    near, forest = np.nonzero(np.triu(linked(common(sets, sets), n, n), 1)), _Forest()
    links = [{"a": reps[i], "b": reps[j]} for i, j in zip(*near, strict=True) if forest.join(reps[i], reps[j])]
    return pd.DataFrame({"home": [key[0]], "chunk": [key[1]], "shingles": [np.unique(np.concatenate(sets)).tobytes()], "links": [links]})


def _bounded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Which queries of a group reach the threshold by what they share with its union, given its least size."""
    union = np.frombuffer(pdf.loc[pdf["member"], "shingles"].iloc[0], np.uint64)
    pdf = pdf[~pdf["member"]].drop_duplicates("rep")
    keep = []
    for s, least in zip(_sets(pdf["shingles"]), pdf["least_n"], strict=True):
        at = np.searchsorted(union, s)
        both = int((union[np.minimum(at, len(union) - 1)] == s).sum())
        keep.append((100 + PERCENT) * both >= PERCENT * (len(s) + max(int(least), needed(len(s)))))
    kept = pdf[keep]
    return pd.DataFrame({"home": key[0], "chunk": key[1], "rep": kept["rep"], "least_n": kept["least_n"]})


def _opened(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of queries with members of an opened group that bring labels together."""
    pdf = pdf.sort_values("rep").drop_duplicates(["member", "rep"])
    members, queries = pdf[pdf["member"]], pdf[~pdf["member"]]
    left, right = _sets(queries["shingles"]), _sets(members["shingles"])
    near = linked(common(left, right), np.array([len(s) for s in left]), np.array([len(s) for s in right]))
    forest, found = _Forest(), []
    a, la, b, lb = queries["rep"].tolist(), queries["label"].tolist(), members["rep"].tolist(), members["label"].tolist()
    for i, j in zip(*np.nonzero(near), strict=True):
        if forest.join(la[i], lb[j]):
            found.append((a[i], b[j]))
    return pd.DataFrame(found, columns=["a", "b"])


class Matrix:
    """The token-group matrix over (rep, n, home): groups of at most MEMBERS sets, the union of each, and the sets themselves.

    A group holds sets with one least shingle, next to each other by size; a
    least shingle that very many sets have makes many groups.
    """

    def __init__(self, nodes: DataFrame, sets: DataFrame):
        placed = positions(nodes.withColumn("_sub", spread("rep_name", 16)), "home", ["n", "_sub"], ["rep"], "_at")
        members = spool(placed.select("rep", "home", F.floor(F.col("_at") / MEMBERS).alias("chunk")).join(sets, "rep"))
        self.members, self.sets, self.groups = members, members.select("rep", "shingles"), members.select("rep", "home", "chunk").distinct()
        made = spool(members.groupBy("home", "chunk").applyInPandas(_own, "home long, chunk long, shingles binary, links array<struct<a: binary, b: binary>>"))
        self.unions = made.select("home", "chunk", "shingles")
        self.links = made.select(F.explode("links").alias("l")).select("l.a", "l.b")

    def _blocks(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs with a block of about QUERIES_AT_ONCE queries of a group, and the blocks that each group has."""
        sizes = pairs.groupBy("home", "chunk").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).alias("_blocks"))
        pairs = pairs.join(sizes, ["home", "chunk"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_blocks"))).drop("_blocks")
        return pairs, sizes.select("home", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("block"))

    def opened(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Links (a, b) of queries with groups, for pairs (home, chunk, rep, least_n): bounded by unions first, then compared."""
        query, none = F.lit(False).alias("member"), F.lit(None)
        pairs, blocks = self._blocks(spool(pairs))
        asked = pairs.join(self.sets, "rep").select("home", "chunk", "block", "rep", "least_n", "shingles", query)
        unions = blocks.join(self.unions, ["home", "chunk"]).select("home", "chunk", "block", none.cast("binary").alias("rep"), none.cast("int").alias("least_n"), "shingles", (~query).alias("member"))
        reached = asked.unionByName(unions).groupBy("home", "chunk", "block").applyInPandas(_bounded, "home long, chunk long, rep binary, least_n int")
        pairs, blocks = self._blocks(spool(reached).select("home", "chunk", "rep"))
        named = lambda df: df.join(labels, F.col("rep") == labels["node"], "left").withColumn("label", F.coalesce("label", "rep"))
        columns = ["home", "chunk", "block", "rep", "label", "shingles"]
        asked = named(pairs).join(self.sets, "rep").select(*columns, query)
        members = named(blocks.join(self.members, ["home", "chunk"])).select(*columns, (~query).alias("member"))
        return spool(asked.unionByName(members).groupBy("home", "chunk", "block").applyInPandas(_opened, "a binary, b binary"))


def _reach(a: Column, n: Column, other: Column) -> Column:
    """Whether `a` shingles in common can be enough for sets of n and `other`, at least what n needs."""
    return (100 + PERCENT) * a >= PERCENT * (n + F.greatest(other, F.ceil(n * PERCENT / 100)))


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(short, own): how many shingles of a set are in no other one; sets without such have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                found = [np.frombuffer(x, np.int64) for x in part["shingles"]]
                yield pd.DataFrame({"short": np.repeat(part["short"].to_numpy(), [len(x) for x in found]), "shingle": np.concatenate(found)})

    once = sets.select("short", "shingles").mapInPandas(run, "short long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("short").alias("short"))
    return once.where(F.col("m") == 1).groupBy("short").agg(F.count(F.lit(1)).alias("own"))


def _shared(met: DataFrame) -> DataFrame:
    """The rows (band, short, ask) of bands that several have."""
    several = met.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("band")
    return spool(met.join(several, "band", "left_semi"))


def _narrowed(wide: DataFrame, *columns: str) -> DataFrame:
    """Some columns of what spool() wrote, written anew; the rest is deleted."""
    out = spool(wide.select(*columns), few=True)
    unspool(wide)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id) per document: the smallest id that links lead to.

    Words are runs of other than ASCII white space, with A-Z in lower case; two
    documents link if their sets of distinct shingles have a Jaccard similarity of
    at least PERCENT hundredths. A text with fewer words than a shingle is one
    shingle; one without words has none and no links. Every component is that of
    all pairs: nothing is left out, and nothing is compared that the links found
    so far already bring together.

    Documents with equal sets are one node. Nodes that share a rare shingle meet
    in its bucket, if they share enough of them with others. Shingles of no other node are in no intersection, so a node
    with too many of them for anything in its bucket leaves it. The rest make the
    groups of the matrix: first each group's own members are compared; then nodes
    look at the group of the bucket's most typical node; then, in buckets that
    still hold several components, all nodes but those of the largest look at the
    groups that have others. No pairs of nodes are formed but in a group's task.

    Rows that share an id share a component, also if their texts differ; repeated
    rows are rows each. Null ids get a negative one made from their text. An empty
    table gives no rows; other columns are not read, and may have any name.
    """
    rows = _texts(docs, id_col, text_col)
    wide = spool(signed(rows, shingle))
    nodes = wide.groupBy("node").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "home", "bands", "ask")])
    banded = spool(nodes.select("node", node_key(F.col("id"), F.col("node")).alias("rep"), F.xxhash64("node").alias("short"), "n", "home", "bands", "ask"))
    # bands are most of what was written, and are read once more only
    base, nodes = _narrowed(wide, "id", "node", "n"), banded.drop("bands", "ask")
    several = base.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where(F.col("low") < F.col("high"))
    shared = base.join(several, "id", "left_semi").join(nodes.select("node", "rep"), "node").select("id", "rep")
    same_id = spool(shared.join(shared.groupBy("id").agg(F.min("rep").alias("a")), "id").where(F.col("a") < F.col("rep")).select("a", F.col("rep").alias("b")).distinct())
    labels = joined(same_id.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0), same_id)

    # by a short name, which two nodes may share: then both are looked at
    first = _shared(banded.select(F.explode("bands").alias("band"), "short", "ask"))
    nodes = _narrowed(banded, *nodes.columns)
    busy = first.groupBy("short").agg(F.count(F.lit(1)).alias("m"), F.min("ask").alias("ask")).where(F.col("m") >= F.col("ask")).select("short")
    met = _shared(first.join(busy, "short", "left_semi"))
    unspool(first)
    buckets = spool(met.join(nodes.select("short", "rep", "n"), "short").select("band", "rep", "n"))
    unspool(met)
    ids = buckets.select(id_of(F.col("rep")).alias("id")).distinct()
    # a repeated row gives its set again, which the steps below allow for
    sets = shingle_sets(rows.join(ids, "id", "left_semi"), shingle, False, word_hasher).select(node_key(F.col("id"), F.col("node")).alias("rep"), "shingles")
    sets = spool(sets.withColumn("short", F.xxhash64("rep")))

    rest = F.col("n") - F.coalesce("own", F.lit(0))
    own = _own_shingles(sets)
    placed = buckets.withColumn("short", F.xxhash64("rep")).join(own, "short", "left").select("band", "rep", "n", rest.alias("rest")).where(_reach(F.col("rest"), F.col("n"), F.lit(0)))
    least = placed.groupBy("band").agg(F.min("n").alias("_least"), F.count(F.lit(1)).alias("_m"))
    placed = spool(placed.join(least, "band").where((F.col("_m") > 1) & _reach(F.col("rest"), F.col("n"), F.col("_least"))).drop("_least", "_m"))
    left = placed.select("rep").distinct()
    matrix = Matrix(nodes.join(left, "rep", "left_semi").select("rep", "n", "home", F.hex("rep").alias("rep_name")), sets.drop("short"))
    unspool(sets)
    labels = joined(labels, matrix.links)
    placed = spool(placed.join(matrix.groups.select("rep", "home", "chunk"), "rep"))

    # the group of the node with the least share of shingles of its own
    now = mixed_buckets(placed, labels)
    typical = now.groupBy("band").agg(F.min(F.struct((1 - F.col("rest") / F.col("n")).alias("own"), F.xxhash64("rep").alias("h"), "home", "chunk", "label")).alias("t"))
    pairs = now.drop("home", "chunk").join(typical.select("band", "t.home", "t.chunk", F.col("t.label").alias("_led")), "band").where(F.col("label") != F.col("_led"))
    pairs = pairs.select("home", "chunk", "rep", F.lit(0).alias("least_n")).distinct()
    labels = joined(labels, matrix.opened(pairs, labels))

    now = spool(mixed_buckets(placed, labels))
    main = now.groupBy("band", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("band").agg(F.max(F.struct("m", "label"))["label"].alias("main"))
    queries = now.join(main, "band").where(F.col("label") != F.col("main")).select("band", "rep", "n", "rest", "label")
    groups = now.groupBy("band", "home", "chunk").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("rest").alias("most"))
    other = (F.col("low") != F.col("label")) | (F.col("high") != F.col("label"))
    sizes = (100 * F.col("n") >= PERCENT * F.col("least_n")) & (100 * F.col("most_n") >= PERCENT * F.col("n"))
    pairs = queries.join(groups, "band").where(other & sizes & _reach(F.least("rest", "most"), F.col("n"), F.col("least_n")))
    labels = joined(labels, matrix.opened(pairs.groupBy("home", "chunk", "rep").agg(F.min("least_n").alias("least_n")), labels))

    own = base.select("id", "node", "n").join(nodes.select("node", "rep"), "node").select("id", "n", "rep")
    return own.join(labels, F.col("rep") == labels["node"], "left").select("id", F.col("n").cast("long").alias("n_shingles"), id_of(F.coalesce("label", "rep")).alias("component_id"))
