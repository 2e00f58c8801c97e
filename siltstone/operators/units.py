"""Representative units of a text, and key points without claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.match import matched_topics
from siltstone.functions.scoring import cascade
from siltstone.functions.text import any_pattern, bind, cleanup_unit, ensure_sentence, split_units


def unit_points(unit: Column, whole: Column, keywords: list[str], topics: dict[str, list[str]], banter: str | None = None, seen: Column | None = None) -> Column:
    """Score in hundredths: length up to 120 characters, keywords, topics of the whole text, less banter.
    With ``seen``, the topics of the whole text, its head alone is enough for ``whole``."""
    points = F.floor(F.least(F.length(unit), F.lit(120)) * 100 / 40)
    points = reduce(lambda a, k: a + F.when(unit.contains(k), 140).otherwise(0), keywords, points)
    named = matched_topics(F.concat_ws(" ", unit, whole), topics)
    points = points + 40 * F.size(named if seen is None else F.array_union(seen, named))
    return points - F.when(unit.rlike(banter), 120).otherwise(0) if banter else points


def best_units(
    text: Column, keywords: list[str], topics: dict[str, list[str]], banter: str | None = None, cues: list[str] = (), top: int = 4, least: int = 18, most: int = 180, not_in: list[str] = ()
) -> Column:
    """The best units of a fair length, best first; later ones lose a hundredth a position, and of units that begin
    alike the best stays. Units that match a pattern of ``not_in`` (promotions) are left out."""
    long = max((len(k) for keys in topics.values() for k in keys), default=0)  # a keyword across unit and text ends in so many characters

    def chosen(w):
        units = F.transform(F.transform(split_units(w.text, cues), cleanup_unit), lambda u, n: F.struct(u.alias("unit"), n.alias("n")))
        units = F.filter(units, lambda x: F.length(x.unit).between(least, most))
        if not_in:
            units = F.filter(units, lambda x: ~any_pattern(x.unit, list(not_in)))
        units = F.transform(units, lambda x: F.struct((x.n - unit_points(x.unit, w.head, keywords, topics, banter, w.seen)).alias("less"), x.n.alias("n"), x.unit.alias("unit")))
        begins = lambda u: F.substring(u, 1, 28)
        step = lambda kept, x: F.when((F.size(kept) >= top) | F.exists(kept, lambda k: begins(k) == begins(x.unit)), kept).otherwise(F.concat(kept, F.array(x.unit)))
        return F.aggregate(F.sort_array(units), F.array().cast("array<string>"), step)

    whole = lambda t: F.struct(t.alias("text"), F.substring(t, 1, long).alias("head"), matched_topics(t, topics).alias("seen"))
    return bind(bind(text, whole), chosen)


def representative_units(rows: DataFrame, key: str, text: str, *rules, **limits) -> DataFrame:
    """(key, rank, unit): :func:`best_units` of each row."""
    return rows.select(key, F.posexplode(best_units(F.col(text), *rules, **limits)).alias("rank", "unit")).withColumn("rank", F.col("rank") + 1)


def themes(unit: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The sentence of the first rule that a unit matches; null without one."""
    return cascade([(unit.rlike(p), s) for p, s in rules], default if default is not None else F.lit(None).cast("string"))


def key_points(title: Column, found: Column, topics: Column, assets: Column, fallback: list[str], least: int = 3, most: int = 4) -> Column:
    """Title (unless weak), themes, assets, then fallback lines up to ``least``; each a sentence, none twice."""
    named = F.when(~weak_title(title), title)
    line = F.when(F.size(assets) > 0, F.array_join(F.slice(assets, 1, 5), "、"))
    points = F.array_distinct(F.array_compact(F.concat(F.array(named), found, F.array(line))))
    pads = F.array(*[F.lit(x) for x in fallback])
    points = F.concat(points, F.slice(pads, F.lit(1), F.greatest(least - F.size(points), F.lit(0))))
    return F.slice(F.transform(points, lambda p: ensure_sentence(p)), 1, most)


def weak_title(title: Column) -> Column:
    """An episode number with symbols only, or hardly any significant characters."""
    significant = F.regexp_replace(title, r"(?U)[\s|。！？!?\p{So}\x{FE0F}\x{200D}]", "")
    return title.rlike(r"(?U)^\s*EP\d+\s*\|\s*[\p{So}\x{FE0F}\x{200D}]+\s*$") | (F.length(significant) <= 6)


