"""Podcast and video feeds: fetching with failover, XML to raw items."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import clean_html, first_non_empty, iso_text, parse_feed_date, slug_part

ATTEMPTS, PAUSE = 3, 0.4


def http_get(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as answer:
        return answer.read().decode("utf-8", "replace")


def fetch_first(urls: list[str], get: Callable[[str], str] = http_get, sleep=time.sleep) -> str:
    """The first feed that can be read: each address is tried three times, waiting longer each time."""
    errors = []
    for url in urls:
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return get(url)
            except Exception as error:  # noqa: BLE001  any failure means the next attempt
                errors.append(f"{url} (attempt {attempt}): {error}")
                if attempt < ATTEMPTS:
                    sleep(PAUSE * attempt)
    raise RuntimeError("; ".join(errors) or "no address")


def fetch_feeds(sources: DataFrame, get: Callable[[str], str] = http_get) -> DataFrame:
    """Adds xml and error to sources with ``urls``; a source that fails does not stop the others."""

    def run(frames):
        for pdf in frames:
            out = []
            for urls in pdf["urls"]:
                try:
                    out.append((fetch_first(list(urls), get), None))
                except Exception as error:  # noqa: BLE001
                    out.append((None, str(error)))
            yield pdf.assign(xml=[x for x, _ in out], error=[e for _, e in out])

    return sources.mapInPandas(run, sources.schema.simpleString()[7:-1] + ", xml:string, error:string")


RSS = (
    "channel struct<item: array<struct<guid: struct<_VALUE: string, `@_isPermaLink`: string>, link: string, title: string, pubDate: string, description: string, "
    "`content:encoded`: string, enclosure: struct<`@_url`: string>, `itunes:image`: struct<`@_href`: string>>>>"
)
ATOM = (
    "entry array<struct<id: string, `yt:videoId`: string, title: string, published: string, updated: string, link: struct<`@_href`: string>, "
    "`media:group`: struct<`media:description`: string, `media:thumbnail`: struct<`@_url`: string>>>>"
)
OPTIONS = {"attributePrefix": "@_", "valueTag": "_VALUE"}


def _identity(rows: DataFrame, external: Column, published: Column) -> DataFrame:
    at = F.coalesce(iso_text(parse_feed_date(published)), F.col("fetchedAt"))
    rows = rows.withColumn("externalId", external).withColumn("publishedAt", at)
    return rows.withColumn("id", F.concat_ws("-", "sourceId", F.substring("publishedAt", 1, 10), slug_part("externalId")))


def rss_items(feeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw items of RSS text in ``xml`` (with sourceId and fetchedAt), in feed order; at most ``limit`` a source."""
    rows = feeds.withColumn("x", F.from_xml("xml", RSS, OPTIONS)).select("sourceId", "fetchedAt", F.posexplode("x.channel.item").alias("position", "i"))
    rows = rows if limit is None else rows.filter(F.col("position") < limit)
    rows = _identity(rows, first_non_empty("i.guid._VALUE", "i.link", "i.title"), F.col("i.pubDate"))
    return rows.select(
        "id",
        "sourceId",
        "externalId",
        F.lit("podcast").alias("medium"),
        first_non_empty("i.title", F.lit("Untitled")).alias("title"),
        clean_html(F.coalesce(first_non_empty("i.description", "i.`content:encoded`"), F.lit(""))).alias("description"),
        "publishedAt",
        F.coalesce("i.link", F.lit("")).alias("url"),
        F.col("i.enclosure.`@_url`").alias("audioUrl"),
        F.col("i.`itunes:image`.`@_href`").alias("imageUrl"),
        "fetchedAt",
        "position",
    )


def atom_items(feeds: DataFrame, limit: int | None = None, watch: str = "https://www.youtube.com/watch?v=") -> DataFrame:
    """Raw items of Atom text, like :func:`rss_items`."""
    rows = feeds.withColumn("x", F.from_xml("xml", ATOM, OPTIONS)).select("sourceId", "fetchedAt", F.posexplode("x.entry").alias("position", "i"))
    rows = rows if limit is None else rows.filter(F.col("position") < limit)
    rows = _identity(rows, first_non_empty("i.`yt:videoId`", "i.id", "i.title"), F.coalesce("i.published", "i.updated"))
    return rows.select(
        "id",
        "sourceId",
        "externalId",
        F.lit("youtube").alias("medium"),
        first_non_empty("i.title", F.lit("Untitled")).alias("title"),
        clean_html(F.coalesce("i.`media:group`.`media:description`", F.lit(""))).alias("description"),
        "publishedAt",
        first_non_empty("i.link.`@_href`", F.concat(F.lit(watch), "externalId")).alias("url"),
        F.lit(None).cast("string").alias("audioUrl"),
        F.col("i.`media:group`.`media:thumbnail`.`@_url`").alias("imageUrl"),
        "fetchedAt",
        "position",
    )


def select_sources(sources: DataFrame, wanted: str | None) -> DataFrame:
    """Sources whose id or slug is ``wanted``; all without one."""
    return sources if not wanted else sources.filter((F.col("id") == wanted) | (F.col("slug") == wanted))


