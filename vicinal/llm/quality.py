"""Quality of texts: counting rules, and distance of their histograms to language references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, aside

#: The classes of characters, in the order of the references.
CLASSES = ("lower or digit", "upper", "blank", "sentence", "other")
SYMBOLS = "#*$%&|<>"
SENTENCE = ".,;:!?'\"()-"


@dataclass(frozen=True)
class Reference:
    """Shares of the character classes, and of the commonest words among all words, in good text of a language."""

    classes: tuple[float, ...]
    words: Mapping[str, float]


# Shares measured over labelled good documents.
REFERENCES = {
    "de": Reference((0.8108, 0.0128, 0.1547, 0.0216, 0.0001), {"der": 0.0501, "die": 0.0262, "und": 0.0211, "in": 0.0154, "den": 0.0135, "von": 0.0107, "zu": 0.0091, "das": 0.0088, "mit": 0.0074, "sich": 0.0071}),
    "en": Reference((0.7960, 0.0137, 0.1667, 0.0235, 0.0001), {"the": 0.0504, "of": 0.0262, "and": 0.0212, "to": 0.0154, "a": 0.0128, "in": 0.0108, "is": 0.0097, "that": 0.0085, "it": 0.0071, "for": 0.0070}),
    "es": Reference((0.8022, 0.0133, 0.1616, 0.0228, 0.0001), {"de": 0.0508, "la": 0.0265, "que": 0.0200, "el": 0.0152, "en": 0.0132, "y": 0.0105, "los": 0.0098, "se": 0.0085, "las": 0.0073, "del": 0.0071}),
    "fr": Reference((0.7956, 0.0139, 0.1667, 0.0237, 0.0001), {"de": 0.0509, "la": 0.0275, "le": 0.0200, "et": 0.0156, "les": 0.0129, "des": 0.0110, "en": 0.0098, "un": 0.0088, "du": 0.0070, "une": 0.0066}),
}


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two arrays of shares."""

    def term(a: Column, b: Column) -> Column:
        half = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / half)).otherwise(F.lit(0.0))
        return (part(a) + part(b)) / 2

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def shares(values: Sequence[float], rest: bool = False) -> Column:
    """A constant histogram that sums to 1, with what is left as its last bar if rest."""
    bars = [*values, max(0.0, 1 - sum(values))] if rest else [v / sum(values) for v in values]
    return F.array(*[F.lit(float(v)) for v in bars])


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of three that occur at least twice, overlaps counted once.

    Equal windows are neighbours once sorted by hash, so n words cost n log n;
    words are compared by 64-bit hashes.
    """
    n = F.size(words)
    at = lambda i: F.get(words, i)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i"))))
    return F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>")))


def _covered(windows: Column) -> Column:
    """Words under the windows whose hash a neighbour shares."""
    same = lambda x, i: F.coalesce(F.get(windows, i)["h"] == x["h"], F.lit(False))
    twice = F.transform(windows, lambda x, i: F.when(same(x, i + 1) | (F.when(i > 0, same(x, i - 1)).otherwise(F.lit(False))), x["i"]))
    starts = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
    add = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), add)["n"]


def measure(docs: DataFrame, text_col: str = "text", references: Mapping[str, Reference] = REFERENCES) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance and word_distance.

    The distances are those to the nearest reference; 1 for a text without a
    character (class) or word (word). A null text is empty. Whole texts are
    measured in one projection, without a shuffle. Columns of these names are
    replaced; others may have any name. Repeated rows are rows each; an empty
    table gives none.
    """
    listed = sorted({w for r in references.values() for w in r.words})
    helpers = ["_t", "_words", "_windows", "_common", "_lines", "_upper", "_blank", "_digit", "_sentence", "_classes", *[f"_n_{w}" for w in listed]]
    docs, back, text_col = aside(docs, helpers, text_col)
    docs = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    docs = docs.withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    common = F.filter("_words", lambda w: w.isin(listed))
    length = F.length("_t")
    without = lambda chars: length - F.length(F.translate("_t", chars, ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "_windows": repeated_words(F.col("_words")),
            "_common": F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" ")),
            "_lines": lines,
            "_upper": F.regexp_replace("_t", r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", ""),
            "_blank": without(BLANKS),
            "_digit": without("0123456789"),
            "_sentence": without(SENTENCE),
            "n_symbols": without(SYMBOLS).cast("long"),
        }
    )
    lower = length - F.length("_upper")
    upper = F.length("_upper") - F.length(F.regexp_replace("_upper", r"\p{Lu}+", ""))
    classes = [lower + F.col("_digit"), upper, F.col("_blank"), F.col("_sentence")]
    classes.append(length - sum(classes[1:], classes[0]))
    count = lambda w: (F.length("_common") - F.length(F.replace(F.col("_common"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)
    docs = docs.withColumns(
        {
            "word_chars": (length - F.col("_blank")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _covered(F.col("_windows")).cast("long"),
            "_classes": F.array(*[c / F.greatest(length, F.lit(1)) for c in classes]),
            **{f"_n_{w}": count(w) / F.greatest(F.col("n_words"), F.lit(1)) for w in listed},
        }
    )

    def words(r: Reference) -> Column:
        own = [F.col(f"_n_{w}") for w in r.words]
        return js_distance(F.array(*own, F.greatest(1 - sum(own[1:], own[0]), F.lit(0.0))), shares(list(r.words.values()), rest=True))

    nearest = lambda found: F.least(*found) if len(found) > 1 else found[0]
    docs = docs.withColumns(
        {
            "class_distance": F.when(length == 0, 1.0).otherwise(nearest([js_distance(F.col("_classes"), shares(r.classes)) for r in references.values()])),
            "word_distance": F.when(F.col("n_words") == 0, 1.0).otherwise(nearest([words(r) for r in references.values()])),
        }
    )
    return back(docs.drop(*helpers))


def judge(docs: DataFrame, text_col: str = "text", class_limit: float = 0.17, word_limit: float = 0.24, least_chars: int = 200, least_words: int = 150, references: Mapping[str, Reference] = REFERENCES) -> DataFrame:
    """Add the measures, base_failed and kept.

    base_failed: under 50 words, or over half of the words repeat. The method
    drops a text that is too far from every language: by its classes if it has
    least_chars, by its common words if it has least_words; shorter texts vary
    too much to be judged so. Columns of these names are replaced; others may
    have any name. Repeated rows are rows each; an empty table gives none.
    """
    docs = measure(docs, text_col, references)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = (F.col("word_chars") >= least_chars) & (F.col("class_distance") > class_limit) | (F.col("n_words") >= least_words) & (F.col("word_distance") > word_limit)
    return docs.withColumns({"base_failed": failed, "kept": ~failed & ~odd})
