"""Find secrets in texts: known forms, and windows of high Shannon entropy."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside

# The base kinds in their order, each with its pattern, the group whose length counts and the least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]+", 0, 24),
)
#: What a text must hold for a kind to be looked for at all: a cheaper test than the pattern.
HINTS = {"assign": r"[:=]", "access": "AKIA", "hex": r"(?<![0-9a-f])[0-9a-f]{24}"}
#: The kind of the method's own spans.
ENTROPY = "entropy"
#: The least length of a candidate string for the entropy scan, and its form.
LEAST = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}"
#: What may join a candidate's parts.
JOINTS = r"^[+/_-]+|[+/_-]+$"
WINDOW = 20
#: Character classes from narrow to wide, with the bits per character from which a window counts.
CLASSES = ((r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.7), (r"^.*$", 3.9))
#: Harmless strings of high entropy, each as a whole: UUIDs, paths of words, alphabets and counters, placeholders, numbers.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[/_-]?(?:[A-Z]?[a-z]+[/_-])*[A-Z]?[a-z]+[/_-]?$",
    r"^(?i:[/_+-]|0?123456789(?:0|abcdef)?|abcdefghij(?:klmnopqrstuvwxyz)?|qwertyuiop(?:asdfghjkl(?:zxcvbnm)?)?)+$",
    r"^(?i:[/_+-]|your|my|the|an?|example|sample|placeholder|dummy|test|demo|api|key|token|secret|password|here|xx+|[0-9]{1,4}(?![0-9]))+$",
    r"^[0-9/_+-]+$",
)
REDACTED = "[SECRET]"


def spans_of(text: Column, pattern: str, kind: str, order: int, group: int = 0, least: int = 0) -> Column:
    """All matches of a pattern as structs (start, rank, end, kind, value), in code points, end exclusive.

    SQL's matches have no positions, but the text between them has lengths:
    a match begins after what was before it and the matches until then.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.arrays_zip(whole.alias("m"), counted.alias("v"), F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("g"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")

    def add(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["g"])
        end = start + F.length(p["m"])
        one = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), p["m"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(p["v"]) >= least, F.concat(a["spans"], F.array(one))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add)["spans"]


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of any window over the string.

    The counts of the window's characters are kept, and the sum of n * log2(n)
    over them; each step changes both for the character that leaves and the one
    that enters. Strings shorter than the window count as one. What steps share
    is part of their state, as lambdas work out anew what they name.
    """
    table = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    f = lambda n: F.element_at(table, n + 1)
    chars = F.split(value, "(?!^)(?!$)")
    first = F.slice(chars, 1, window)
    alphabet = F.array_distinct(chars)
    places = F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int"))
    counts = F.transform(alphabet, lambda c: F.size(F.filter(first, lambda x: x == c)))
    begin = F.aggregate(counts, F.lit(0.0), lambda a, n: a + f(n))

    def step(a: Column, i: Column) -> Column:
        left, entering = F.element_at(a["places"], i), F.element_at(a["places"], i + window)
        out, come = F.element_at(a["counts"], left), F.element_at(a["counts"], entering)
        now = F.when(left == entering, a["sum"]).otherwise(a["sum"] - f(out) + f(out - 1) - f(come) + f(come + 1))
        moved = F.transform(a["counts"], lambda n, j: n - (j + 1 == left).cast("int") + (j + 1 == entering).cast("int"))
        return F.struct(a["places"].alias("places"), moved.alias("counts"), now.alias("sum"), F.least(a["least"], now).alias("least"))

    steps = F.when(F.size(chars) > window, F.sequence(F.lit(1), F.size(chars) - window)).otherwise(F.array().cast("array<int>"))
    least = F.aggregate(steps, F.struct(places.alias("places"), counts.alias("counts"), begin.alias("sum"), begin.alias("least")), step)["least"]
    return F.lit(math.log2(window)) - least / window


def suspicious(value: Column, window: int = WINDOW, classes: Sequence[tuple[str, float]] = CLASSES, allowed: Sequence[str] = ALLOWED) -> Column:
    """Whether a candidate string is no allowed one and has a window of its class's entropy."""
    from_bits = F.lit(99.0)
    for pattern, bits in reversed(classes):
        from_bits = F.when(F.rlike(value, F.lit(pattern)), F.lit(bits)).otherwise(from_bits)
    harmless = F.lit(False)
    for pattern in allowed:
        harmless |= F.rlike(value, F.lit(pattern))
    return ~harmless & (window_entropy(value, window) >= from_bits)


def left_of(candidate: Column, touching: Column) -> Column:
    """The parts of a candidate, as long as one, that no span of an array by start covers."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")

    def until(a: Column, end: Column) -> Column:
        value = F.substring(candidate["value"], a["at"] - candidate["start"] + 1, end - a["at"])
        one = F.struct(a["at"].alias("start"), candidate["rank"].alias("rank"), end.alias("end"), candidate["kind"].alias("kind"), value.alias("value"))
        return F.when(end - a["at"] >= LEAST, F.concat(a["parts"], F.array(one))).otherwise(a["parts"])

    def add(a: Column, b: Column) -> Column:
        return F.struct(F.greatest(a["at"], b["end"]).alias("at"), until(a, b["start"]).alias("parts"))

    return F.aggregate(touching, F.struct(candidate["start"].alias("at"), empty.alias("parts")), add, lambda a: until(a, candidate["end"]))


def scan(docs: DataFrame, text_col: str = "text", window: int = WINDOW, classes: Sequence[tuple[str, float]] = CLASSES, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Add base_spans and spans: arrays of (start, rank, end, kind, value) by start, then kind.

    Base spans are the matches of the known forms. Further spans are candidate
    strings of high entropy that overlap none of them; of a candidate that base
    spans cover in part, what is left is judged, with and without the signs that
    join it to them. A null text is empty.
    Rows are scanned whole and where they are: one projection, no shuffle.
    Repeated rows are rows each; an empty table gives none.
    Columns of these two names are replaced; others may have any name.
    """
    docs, back, text_col = aside(docs, ("_t", "_more"), text_col)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    docs = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("_t")
    found = [F.when(F.rlike(text, F.lit(HINTS[kind])), spans_of(text, pattern, kind, i, group, least)).otherwise(none) for i, (kind, pattern, group, least) in enumerate(BASE)]
    docs = docs.withColumn("base_spans", F.sort_array(F.concat(*found)))
    more = F.when(F.rlike(text, F.lit(CANDIDATE)), spans_of(text, CANDIDATE, ENTROPY, len(BASE))).otherwise(none)
    docs = docs.withColumn("_more", more)
    judged = lambda v: suspicious(v, window, classes, allowed)

    def secret(c: Column) -> Column:
        touching = F.filter("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        bare = lambda v: F.regexp_replace(v, JOINTS, "")
        parts = F.filter(left_of(c, touching), lambda p: judged(p["value"]) | (F.length(bare(p["value"])) >= LEAST) & judged(bare(p["value"])))
        return F.when(F.size(touching) > 0, parts).when(judged(c["value"]), F.array(c)).otherwise(none)

    extra = F.flatten(F.transform("_more", secret))
    return back(docs.withColumn("spans", F.sort_array(F.concat("base_spans", extra))).drop("_t", "_more"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", mark: str = REDACTED, **options: Mapping) -> DataFrame:
    """The documents with every secret replaced by a mark; overlapping spans give one.

    Null texts stay null; the columns stay as they are, whatever their names.
    Repeated rows are rows each; an empty table gives none.
    """
    docs, back, text_col = aside(docs, ("spans", "base_spans", "_secret_text"), text_col)
    names = docs.columns
    scanned = scan(docs.withColumn("_secret_text", F.col(text_col)), "_secret_text", **options)
    text = F.col("_secret_text")

    def add(a: Column, s: Column) -> Column:
        before = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        out = F.concat(a["out"], before, F.when(s["start"] >= a["at"], F.lit(mark)).otherwise(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    clean = F.when(F.size("spans") == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return back(scanned.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in names]))
