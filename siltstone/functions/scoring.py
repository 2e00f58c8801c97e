"""Rule cascades, additive scores, votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import col


def cascade(rules: list[tuple[Column, object]], default=None) -> Column:
    """The value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default)) if out is not None else F.lit(default)


def pattern_cascade(c, rules: list[tuple[str, object]], default=None) -> Column:
    return cascade([(col(c).rlike(p), v) for p, v in rules], default)


def additive(parts: list[tuple[Column, int]], base: int = 0) -> Column:
    """Integer points; sums of doubles would drift."""
    out = F.lit(base)
    for condition, points in parts:
        out = out + F.when(condition, F.lit(points)).otherwise(F.lit(0))
    return out


def polarity(c, up: str, down: str) -> Column:
    x = col(c)
    return cascade([(x.rlike(up) & x.rlike(down), "mixed"), (x.rlike(up), "bullish"), (x.rlike(down), "bearish")], "neutral")


def vote(bullish, neutral, bearish, mixed) -> Column:
    """Overall sentiment from counts of classes."""
    up, flat, down, both = map(col, (bullish, neutral, bearish, mixed))
    return cascade(
        [((both > 0) | ((up > 0) & (down > 0)), "mixed"), (down > up, "bearish"), ((up > down) & (up > flat), "bullish"), (flat > 0, "neutral")],
        "insufficient",
    )


def lookup(c, table: dict, default=None) -> Column:
    return cascade([(col(c) == k, v) for k, v in table.items()], default)


def editorial(c, rules: list[tuple[str, str | None, str]], default: Column) -> Column:
    """The wording of the first rule whose pattern, and further pattern if it has one, a text holds."""
    x = col(c)
    return cascade([(x.rlike(p) & x.rlike(also) if also else x.rlike(p), words) for p, also, words in rules], default)
