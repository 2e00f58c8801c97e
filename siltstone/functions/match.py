"""One term matcher with four modes; they differ on purpose.

boundary      case-sensitive; a term of ASCII letters and digits must not touch another
substring_ci  anywhere, without regard to case
letters       without regard to case; a term of letters must not touch another letter
substring     anywhere, case-sensitive
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import bind, col

MODES = ("boundary", "substring_ci", "letters", "substring")


def pattern(term: str, mode: str) -> str:
    """A Java regular expression that finds the term."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", term)
    if mode == "boundary":
        return f"(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])" if re.fullmatch(r"[\x20-\x7E]+", term) else quoted
    if mode == "letters":
        return f"(?i)(?:^|[^a-z]){quoted}(?:[^a-z]|$)" if re.fullmatch("[A-Za-z]+", term) else f"(?iu){quoted}"
    return f"(?iu){quoted}" if mode == "substring_ci" else quoted


def matches(c, term: str, mode: str) -> Column:
    x = col(c)
    if mode == "substring" or (mode == "boundary" and not term.isascii()):
        return x.contains(term)
    if mode == "substring_ci":
        return F.lower(x).contains(term.lower())
    return x.rlike(pattern(term, mode))


def matched_terms(c, terms: list[str], mode: str) -> Column:
    """The terms found, in their order: an array expression, no join."""
    return F.array_compact(F.array(*[F.when(matches(c, t, mode), F.lit(t)) for t in terms]))


def any_term(c, terms: list[str], mode: str) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | matches(c, t, mode)
    return out


def matched_topics(c, topics: dict[str, list[str]], mode: str = "substring") -> Column:
    """Names of the topics of which a keyword is found, in dictionary order."""
    return F.array_compact(F.array(*[F.when(any_term(c, keys, mode), F.lit(name)) for name, keys in topics.items()]))


def dictionary_join(rows: DataFrame, text: str, rules: list[dict], mode: str = "boundary") -> DataFrame:
    """A row for each rule of which an alias is found: rows' columns, rule fields and ``matched`` aliases.

    Rules are a fixed table, so this is one projection and an explode; a rule has ``name``, ``aliases`` and
    further string fields. By boundary, terms of ASCII letters and digits are looked up among the text's runs of
    such characters, which are found in one scan.
    """
    fields = sorted({k for r in rules for k in r} - {"aliases"})
    words = sorted({t for r in rules for t in (r["name"], *r["aliases"]) if mode == "boundary" and re.fullmatch("[A-Za-z0-9]+", t)})

    def hits(seen):
        terms = lambda r: F.array_compact(F.array(*[F.when(F.array_contains(seen, t) if t in words else matches(text, t, mode), F.lit(t)) for t in (r["name"], *r["aliases"])]))
        found = [F.struct(*[F.lit(r.get(k)).cast("string").alias(k) for k in fields], F.lit(n).alias("rule"), terms(r).alias("matched")) for n, r in enumerate(rules)]
        return F.filter(F.array(*found), lambda x: F.size(x.matched) > 0)

    runs = F.array_intersect(F.array(*map(F.lit, words)), F.regexp_extract_all(col(text), F.lit("[A-Za-z0-9]+"), F.lit(0))) if words else F.array().cast("array<string>")
    return rows.withColumn("hit", F.explode(bind(F.coalesce(runs, F.array().cast("array<string>")), hits))).select(*rows.columns, "hit.*")


def upper_tokens(c, allow: list[str], deny: list[str] = (), least: int = 2, most: int = 5) -> Column:
    """Isolated runs of capitals that are allowed and not denied, distinct, in order."""
    found = F.regexp_extract_all(col(c), F.lit(f"(?<![A-Za-z0-9])([A-Z]{{{least},{most}}})(?![A-Za-z0-9])"), F.lit(1))
    keep = [t for t in allow if t not in set(deny)]
    return F.array_intersect(F.array_distinct(found), F.array(*map(F.lit, keep)))


def mentioned(text: Column, names: Column) -> Column:
    """Whether any of an array of names occurs in the text, without regard to case."""
    return F.exists(names, lambda n: (n != "") & F.lower(text).contains(F.lower(n)))
