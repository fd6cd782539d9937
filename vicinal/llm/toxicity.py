"""Toxicity of texts: a weighted lexicon matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that a lexicon is learned from, and most terms that it holds.
SAMPLE, TERMS = 20_000, 4_000
#: Lengths of the word beginnings that may become terms.
STEMS = range(3, 13)

# Characters that look like a Latin letter, and the letter.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "ı": "i", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d",
}
# Digits and signs written for a letter inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Zero-width characters and the soft hyphen.
HIDDEN = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))
#: Phrases in which a term is not meant as abuse.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum")

_LOOKALIKE = str.maketrans(HOMOGLYPHS)
_SIGNS = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+")
_LETTER_SIGN = re.compile(r"(?<=[^\W\d_])[013457@8$!|]+(?=[^\W\d_])|\b[013457@8$](?=[^\W\d_])")


def fold(text: str) -> str:
    """Lower case, compatibility forms, look-alike letters and in-word substitutes undone; words apart by one space."""
    text = unicodedata.normalize("NFKC", text).lower().translate(HIDDEN).translate(_LOOKALIKE)
    text = _LETTER_SIGN.sub(lambda m: m[0].translate(_SIGNS), text)
    return " ".join(_WORD.findall(text))


def terms_of(folded: str) -> set[str]:
    """Beginnings of the words of a folded text; short words are among them whole."""
    return {w[:n] for w in set(folded.split()) for n in STEMS if len(w) >= n}


@dataclass
class Lexicon:
    """Terms with their weights, and the logistic model over what they find in a text."""

    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    model: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    def matcher(self):
        """A function from folded texts to (sum of weights, sum of best weights of distinct words, words)."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t, w in self.weights.items():
            automaton.add_word(" " + t, (len(t), w))
        for p in self.exceptions:
            automaton.add_word(" " + fold(p) + " ", (len(fold(p)) + 1, None))
        if len(automaton):
            automaton.make_automaton()

        def match(folded: str) -> tuple[float, float, float, float]:
            padded = f" {folded} "
            words = folded.count(" ") + 1 if folded else 0
            if not len(automaton):
                return 0.0, 0.0, 0.0, words
            best: dict[int, tuple[int, float]] = {}
            excused: list[tuple[int, int]] = []
            for end, (n, w) in automaton.iter(padded):
                at = end - n
                if w is None:
                    excused.append((at, end))
                elif n > best.get(at, (0, 0.0))[0]:  # the longest term at a word
                    best[at] = (n, w)
            found = [(at, w) for at, (_, w) in best.items() if not any(a <= at < b for a, b in excused)]
            total = sum(w for _, w in found)
            distinct: dict[str, float] = {}
            for at, w in found:
                distinct[padded[at + 1 : padded.index(" ", at + 1)]] = w
            strong = sum(w for w in distinct.values() if w > 2)
            return total, sum(distinct.values()), strong, words

        return match

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probability of abuse for rows of features()."""
        z = (features - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.model[1:]) + self.model[0], -30, 30)))


def features(found: Sequence[tuple[float, float, float, float]]) -> np.ndarray:
    """What the model sees: matches by length (two ways) and in all, on log scales."""
    total, distinct, strong, words = np.array(found, float).reshape(-1, 4).T
    size = np.maximum(words, 1)
    return np.stack([np.log1p(np.maximum(total, 0) / np.sqrt(size)), np.log1p(100 * np.maximum(total, 0) / size), np.log1p(np.maximum(distinct, 0)), np.log1p(np.maximum(strong, 0)), np.log1p(size)], 1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    b = np.zeros(z.shape[1])
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(b)), z.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist(), mean.tolist(), scale.tolist()


def _weights(counts: pd.DataFrame, n_toxic: int, n_clean: int, terms: int) -> dict[str, float]:
    """Smoothed log odds of terms, without those that say no more than their own beginning."""
    c = counts.copy()
    c["w"] = np.log((c["toxic"] + 0.5) / (n_toxic + 1)) - np.log((c["clean"] + 0.5) / (n_clean + 1))
    # one standard error off, so that a term met a few times doesn't weigh as much as one met often
    c["w"] -= np.sqrt(1 / (c["toxic"] + 0.5) + 1 / (c["clean"] + 0.5)).clip(upper=2.0) * 0.5
    c = c[(c["w"] > 0.7) & (c["toxic"] >= 3)].sort_values(["toxic", "term"], ascending=[False, True])
    known = dict(zip(c["term"], zip(c["w"], c["toxic"], strict=True), strict=True))
    kept = {}
    for t, (w, n) in known.items():
        shorter = known.get(t[:-1])
        if shorter is None or w > shorter[0] + 0.05 or n < shorter[1] * 0.5 and w > shorter[0] - 0.5:
            kept[t] = (w, n)
    best = sorted(kept.items(), key=lambda kv: (-kv[1][0] * math.sqrt(kv[1][1]), kv[0]))[:terms]
    return {t: float(min(w, 6.0)) for t, (w, _) in best}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> Lexicon:
    """Learn a lexicon and its model from labelled documents.

    At most `sample` labelled rows, the first by a hash of the id, are used: a
    documented bound for a model of fixed size. Half of them give the term
    counts (summed in Spark) and the other half the model over the matches, so
    the model sees terms as they do on new texts; the counts are then taken
    again over all. Null texts are empty; labels that are null are left out.
    Without a label of either kind the lexicon is empty and scores 0.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_y"))
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = rows.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    half = F.pmod(F.crc32(F.concat(F.lit("half"), F.col("_id").cast("string"))), F.lit(2))
    labelled = texts.join(F.broadcast(rows), "_id").select("_text", "_y", half.alias("_half"))

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_text=pdf["_text"].map(fold))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = {key: Counter() for key in ((0, 0), (0, 1), (1, 0), (1, 1))}
            for text, y, h in zip(pdf["_text"], pdf["_y"], pdf["_half"], strict=True):
                seen[(int(h), int(y))].update(terms_of(text))
            every = set().union(*seen.values())
            yield pd.DataFrame([(t, *(seen[k][t] for k in seen)) for t in every], columns=["term", "c0", "t0", "c1", "t1"])

    base = labelled.mapInPandas(folded, "_text string, _y int, _half int").persist()
    try:
        sizes = {(r["_half"], r["_y"]): r["n"] for r in base.groupBy("_half", "_y").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = lambda h, y: sizes.get((h, y), 0)
        if not (n(0, 0) + n(1, 0)) or not (n(0, 1) + n(1, 1)):
            return Lexicon({}, model=[-30.0] + [0.0] * 5, mean=[0.0] * 5, scale=[1.0] * 5)
        sums = base.mapInPandas(count, "term string, c0 long, t0 long, c1 long, t1 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
        # a term must stand in three toxic documents and lean to them: the terms of a bounded sample
        counts = sums.where((F.col("t0") + F.col("t1") >= 3) & ((F.col("t0") + F.col("t1")) * (n(0, 0) + n(1, 0)) > 1.5 * (F.col("c0") + F.col("c1")) * (n(0, 1) + n(1, 1)))).toPandas()
        matched = []
        for h in (0, 1):  # terms of one half, matches in the other
            own = counts.rename(columns={f"t{h}": "toxic", f"c{h}": "clean"})
            lexicon = Lexicon(_weights(own, n(h, 1), n(h, 0), terms))

            def match(batches: Iterator[pd.DataFrame], lexicon=lexicon) -> Iterator[pd.DataFrame]:
                find = lexicon.matcher()
                for pdf in batches:
                    found = pd.DataFrame([find(t) for t in pdf["_text"]], columns=list("abcd"))
                    yield found.assign(y=pdf["_y"].to_numpy())

            matched.append(base.where(F.col("_half") == 1 - h).select("_text", "_y").mapInPandas(match, "a double, b double, c double, d double, y int").toPandas())
    finally:
        base.unpersist()
    seen = pd.concat(matched)
    whole = counts.assign(toxic=counts["t0"] + counts["t1"], clean=counts["c0"] + counts["c1"])
    model, mean, scale = _fit_logistic(features(seen[list("abcd")].to_numpy()), seen["y"].to_numpy(float))
    return Lexicon(_weights(whole, n(0, 1) + n(1, 1), n(0, 0) + n(1, 0), terms), model=model, mean=mean, scale=scale)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", name: str = "score") -> DataFrame:
    """Add a score from 0 to 1 to every row: how likely the whole text is abuse.

    Null and empty texts get the score of a text without words. A text is
    folded and matched once; rows are scored where they are, without a shuffle.
    A column of the given name is replaced.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = lexicon.matcher()
        for texts in batches:
            yield pd.Series(lexicon.score(features([find(fold(t)) for t in texts])))

    return docs.withColumn(name, run(F.coalesce(F.col(text_col), F.lit(""))))


def held_out(id_col: str = "doc_id"):
    """Whether a document's label is kept from learning: crc32 of its id as text leaves 1 of 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def learn_for(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of the labels that are not held out."""
    return learn(docs, labels.where(~held_out()))
