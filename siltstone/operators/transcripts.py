"""Transcripts: adapters, term normalisation with counts, monotonic times, speaker merges."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scoring import lookup
from siltstone.functions.text import col
from siltstone.schemas import SEGMENT

NORMALIZED = "text string, corrections array<struct<`from`: string, `to`: string, reason: string, count: int>>"


def from_legacy(legacy: DataFrame) -> DataFrame:
    """Legacy transcripts in the shape of raw ones: no segments, no warnings."""
    return legacy.select(
        "id", "rawItemId", "sourceId", F.lit("legacy").alias("provider"), "model", "language", "transcribedAt", "audioUrl",
        F.array().cast(f"array<{SEGMENT}>").alias("segments"), "text", F.array().cast("array<string>").alias("warnings"),
    )


def priority_union(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of all tables; of a key, only those of the first table that has it (one row)."""
    rows = None
    for n, t in enumerate(tables):
        t = t.withColumn("priority", F.lit(n))
        rows = t if rows is None else rows.unionByName(t)
    first = Window.partitionBy(key).orderBy("priority")
    return rows.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "priority")


def table_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The whole first table, or the second if the first has no row at all."""
    return second if first.isEmpty() else first


def with_segments(transcripts: DataFrame) -> DataFrame:
    """One segment of the whole text where a provider gave none."""
    one = F.array(F.struct(F.concat("id", F.lit("-0")).alias("id"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("speaker"), F.col("text"), F.lit(None).cast("array<struct<text: string, start: double, end: double, confidence: double>>").alias("words"), F.lit(None).cast("string").alias("providerSegmentId")))
    return transcripts.withColumn("segments", F.when(F.size("segments") > 0, F.col("segments")).otherwise(one.cast(f"array<{SEGMENT}>")))


class Glossary:
    """Left to right: a canonical name is kept whole, else the longest alias becomes its name."""

    def __init__(self, entries: list[dict]):
        self.to = {a: e["name"] for e in entries for a in e["aliases"]}
        self.kind = {e["name"]: e.get("kind", "") for e in entries}
        names = sorted((e["name"] for e in entries), key=lambda x: (-len(x), x))
        aliases = sorted(self.to, key=lambda x: (-len(x), x))
        edge = lambda t: rf"(?<![A-Za-z0-9]){re.escape(t)}(?![A-Za-z0-9])" if t.isascii() else re.escape(t)
        self.pattern = re.compile("|".join([*map(edge, names), *map(edge, aliases)])) if entries else None

    def apply(self, text: str | None) -> tuple[str | None, list[dict]]:
        if not text or self.pattern is None:
            return text, []
        counts: dict[str, int] = {}

        def swap(m):
            found = m.group()
            if found in self.kind or found not in self.to:
                return found
            counts[found] = counts.get(found, 0) + 1
            return self.to[found]

        out = self.pattern.sub(swap, text)
        rows = [{"from": f, "to": self.to[f], "reason": self.kind[self.to[f]], "count": n} for f, n in counts.items()]
        return out, sorted(rows, key=lambda r: (r["to"], r["from"]))


def normalize_terms(rows: DataFrame, entries: list[dict], column: str = "text") -> DataFrame:
    """``normalized`` struct of text and corrections."""
    glossary = Glossary(entries)

    @F.pandas_udf(NORMALIZED)
    def run(text: pd.Series) -> pd.DataFrame:
        done = [glossary.apply(t) for t in text]
        return pd.DataFrame({"text": [t for t, _ in done], "corrections": [c for _, c in done]})

    return rows.withColumn("normalized", run(column))


def normalize_transcripts(transcripts: DataFrame, entries: list[dict]) -> DataFrame:
    """Transcripts with normalised text and segments, and ``corrections`` of the text (of its segments where it is blank)."""
    glossary = Glossary(entries)

    @F.pandas_udf("array<string>")
    def swapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else [glossary.apply(t)[0] for t in x])

    spoken = F.transform("segments", lambda s: s["text"])
    source = F.when(F.trim("text") != "", F.col("text")).otherwise(F.array_join(spoken, "\n"))
    rows = normalize_terms(transcripts.withColumn("source_text", source), entries, "source_text").withColumn("corrections", F.col("normalized.corrections"))
    rows = normalize_terms(rows, entries).withColumn("text", F.col("normalized.text")).withColumn("parts", swapped(spoken))
    renamed = F.transform("segments", lambda s, n: s.withField("text", F.get(F.col("parts"), n)))
    return rows.withColumn("segments", renamed).drop("normalized", "source_text", "parts")


def aliases_found(c, entries: list[dict]) -> Column:
    """The aliases that :func:`normalize_terms` would replace, each as often as it occurs; one scan, no Python."""
    glossary = Glossary(entries)
    swapped = [a for a in glossary.to if a not in glossary.kind]
    return F.filter(F.regexp_extract_all(col(c), F.lit(glossary.pattern.pattern), F.lit(0)), lambda x: x.isin(swapped))


def count_aliases(rows: DataFrame, entries: list[dict], column: str = "text") -> DataFrame:
    """(from, to, reason, count) over all rows, like :func:`correction_counts` but without normalising them."""
    glossary = Glossary(entries)
    counts = rows.select(F.explode(aliases_found(column, entries)).alias("from")).groupBy("from").agg(F.count("*").alias("count"))
    to = lookup("from", glossary.to)
    return counts.select("from", to.alias("to"), lookup(to, glossary.kind).alias("reason"), "count")


def total_corrections(rows: DataFrame) -> int:
    """Corrections in all transcripts together."""
    per_row = F.aggregate("corrections", F.lit(0).cast("long"), lambda a, c: a + c["count"])
    return rows.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("n")).head().n


def correction_counts(rows: DataFrame, corrections: str) -> DataFrame:
    """Counts by (from, to, reason) over all rows."""
    c = rows.select(F.explode(corrections).alias("c")).select("c.*")
    return c.groupBy("from", "to", "reason").agg(F.sum("count").alias("count"))


def keep_unchanged(new: DataFrame, old: DataFrame, key: str, content: list[str], stamp: str) -> DataFrame:
    """The old time stamp stays where the content is unchanged."""
    digest = lambda: F.xxhash64(F.to_json(F.struct(*content)))
    before = old.select(key, digest().alias("old_digest"), F.col(stamp).alias("old_stamp"))
    same = F.col("old_digest") == digest()
    return new.join(before, key, "left").withColumn(stamp, F.when(same, F.col("old_stamp")).otherwise(F.col(stamp))).drop("old_digest", "old_stamp")


def monotonic_times(rows: DataFrame, keys: list[str], order: list, start: str, end: str, fallback: Column | None = None) -> DataFrame:
    """mono_start and mono_end: each start is at least the end before it, each end at least its start.

    A closed form of the running rule: the end is the running maximum of all starts and ends.
    """
    zero = F.lit(0).cast(dict(rows.dtypes)[start])
    s = F.coalesce(col(start), fallback if fallback is not None else zero)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.max(F.greatest(s, F.coalesce(col(end), zero), zero)).over(w)
    rows = rows.withColumn("mono_end", run)
    before = F.lag("mono_end").over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("mono_start", F.greatest(s, F.coalesce(before, zero)))


def merge_run(rows: DataFrame, keys: list[str], order: str, start: str, end: str, text: str, speaker: str) -> DataFrame:
    """One row per group: first start, last end, texts in order, distinct sorted speakers."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(
        F.min(start).alias("start"),
        F.max(end).alias("end"),
        F.array_join(F.transform(parts, lambda p: p.t), " ").alias("text"),
        F.sort_array(F.collect_set(speaker)).alias("speakers"),
    )


def is_monotonic(rows: DataFrame, keys: list[str], order: list, start: str, end: str) -> DataFrame:
    """Per group: every end after its start, every start at or after the end before it."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(*order))
    ok = (col(end) > col(start)) & F.coalesce(col(start) >= before, F.lit(True))
    return rows.withColumn("ok", ok).groupBy(*keys).agg(F.bool_and("ok").alias("monotonic"), F.count("*").alias("n"))
