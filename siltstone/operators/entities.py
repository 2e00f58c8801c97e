"""Entities: dictionary and capital-token matches per segment, rolled up per item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.match import dictionary_join, upper_tokens
from siltstone.functions.text import slug_part


def segment_mentions(segments: DataFrame, rules: list[dict], allow: list[str], deny: list[str]) -> DataFrame:
    """rawItemId, segmentId, name, type, ticker, exchange, matched for rules and fallback tickers.

    A token that a matching rule already stands for is left out.
    """
    text = F.concat_ws(" ", "title", "text", F.array_join("topics", " "), F.array_join("mentionedAssets", " "))
    rows = segments.select("rawItemId", F.col("id").alias("segmentId"), text.alias("searchable"))
    by_rule = dictionary_join(rows, "searchable", rules, "boundary").drop("rule")
    tokens = rows.withColumn("ticker", F.explode(upper_tokens("searchable", allow, deny)))
    covered = by_rule.select("rawItemId", "segmentId", F.explode(F.concat(F.array("ticker"), "matched")).alias("ticker")).distinct()
    tokens = tokens.join(covered, ["rawItemId", "segmentId", "ticker"], "left_anti")
    tokens = tokens.select("rawItemId", "segmentId", F.col("ticker").alias("name"), F.lit("ticker").alias("type"), "ticker", F.lit(None).cast("string").alias("exchange"), F.array("ticker").alias("matched"))
    return by_rule.select(tokens.columns).unionByName(tokens)


def roll_up(mentions: DataFrame) -> DataFrame:
    """One row per (item, name, ticker, type): sorted aliases without the name, sorted segment ids, entity id."""
    rows = mentions.groupBy("rawItemId", "name", "ticker", "type").agg(
        F.max("exchange").alias("exchange"),
        F.flatten(F.collect_set("matched")).alias("matched"),
        F.array_sort(F.collect_set("segmentId")).alias("evidenceSegmentIds"),
    )
    aliases = F.transform(F.array_sort(F.transform(F.array_remove(F.array_distinct("matched"), F.col("name")), lambda a: F.collate(a, "UNICODE"))), lambda a: F.collate(a, "UTF8_BINARY"))
    entity_id = F.concat_ws("-", F.lit("entity"), "type", slug_part("name"), F.nullif(slug_part(F.coalesce("ticker", F.lit(""))), F.lit("")))
    return rows.select("rawItemId", entity_id.alias("id"), F.col("name").alias("canonicalName"), aliases.alias("aliases"), "type", "ticker", "exchange", "evidenceSegmentIds")


def single_key(rows: DataFrame, key: str, fallback: str) -> DataFrame:
    """Per ``fallback`` (file name): the only key in it, the file name if there is none, null if there are several."""
    n = rows.groupBy(fallback).agg(F.countDistinct(key).alias("n"), F.max(key).alias("k"))
    return n.select(fallback, F.when(F.col("n") == 1, F.col("k")).when(F.col("n") == 0, F.col(fallback)).alias(key), (F.col("n") > 1).alias("conflict"))
