"""Judge URLs by pattern rules that are indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside

#: What ends a token of a URL or of a rule.
BREAK = r"[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """allow or block what a regular expression finds in host + path, lower-cased host.

    tokens are literals of which every match holds each, as whole tokens.
    Among rules that match, the higher rank wins, then the greater name.
    """

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def host_rule(action: str, rule: str) -> Rule:
    """A rule on a host with its subdomains and the beginning of a path, as in `net/` or `example.net/en/`."""
    host, slash, path = rule.partition("/")
    path = slash + path
    # a path's last token may go on in the URL, so it is literal only where the rule ends it
    ended = [t for t in re.split(BREAK, re.sub(r"[a-z0-9]+$", "", path)) if t] if path == path.lower() else []
    whole = tuple(t for t in [*re.split(BREAK, host), *ended] if t)
    return Rule(rule, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", whole, 1_000_000 + len(rule))


def word_rule(word: str) -> Rule:
    """Block a host one of whose hyphened or dotted words is this."""
    return Rule(f"word:{word}", "block", rf"^(?:[^/]*[.-])?{re.escape(word)}[.-]", (word,))


#: Words of host names that mark junk: the method's own rules, below any rule on a host.
JUNK_WORDS = ("spam", "pills", "casino", "porn", "xxx", "viagra", "betting", "malware", "phishing", "torrent", "warez", "escort")
DEFAULT_RULES = tuple(word_rule(w) for w in JUNK_WORDS)


def rarest(rules: Sequence[Rule], counts: Mapping[str, int] | None = None) -> dict[str, list[Rule]]:
    """Rules by their rarest token: by counts if given, else by how many rules hold it; then the longest."""
    counts = counts or Counter(t for r in rules for t in set(r.tokens))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if r.tokens else ""
        index.setdefault(token, []).append(r)
    return index


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, with A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", counts: Mapping[str, int] | None = None) -> DataFrame:
    """Add host, path, rule (name of the winner, else null) and verdict (allow or block) to every row.

    The rules are a parameter of bounded size, held in the plan as a map from
    the rarest token to its rules. The tokens of a URL fetch its candidates,
    and only their regular expressions run. All is one projection: no shuffle,
    no join. A URL that no rule fits, a null one and an empty one are allowed.
    Columns named host, path, rule or verdict are replaced; others may have any
    name. Repeated rows are rows each; an empty table gives none.
    """
    pages, back, url_col = aside(pages, ("_best",), url_col)
    index = rarest(rules, counts)
    one = lambda r: F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"))
    pages = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if not index:
        return back(pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")}))
    table = F.create_map(*[x for token, found in sorted(index.items()) for x in (F.lit(token), F.array(*map(one, found)))])
    target = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(target), BREAK)))
    known = F.array_intersect(tokens, F.array(*[F.lit(t) for t in sorted(index)]))
    candidates = F.flatten(F.transform(known, lambda t: F.element_at(table, t)))
    matching = F.filter(candidates, lambda r: F.rlike(target, r["pattern"]))
    best = F.array_max(F.transform(matching, lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["action"].alias("action"))))
    return back(pages.withColumn("_best", best).withColumns({"rule": F.col("_best.name"), "verdict": F.coalesce("_best.action", F.lit("allow"))}).drop("_best"))
