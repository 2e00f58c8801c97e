"""Claims: at most one well-signalled quote per segment, classified and scored."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import rules as R
from siltstone.functions.match import mentioned
from siltstone.functions.scoring import additive, pattern_cascade, polarity
from siltstone.functions.text import any_pattern, bind, quote_key, shingles

_SPLIT = re.compile(r"(?<=[。！？；;.!?])\s*|[\r\n]+")
_LEAD = re.compile(r"^[，,、：:；;。！？!?.\s]+")
#: fixed value: a leading number goes, with the word that links it
_NUMBER = re.compile(r"^\d+(?:\.\d+)?%?(?:但|不過|不过|當然|当然)?")
_TRAIL = re.compile(r"[，,、：:；;\s]+$")
BEFORE, AFTER, FOCUS_OVER, WINDOWS = 20, 95, 100, 2


def clause(text: str) -> str:
    """Without leading marks and number, trailing marks."""
    return _TRAIL.sub("", _LEAD.sub("", _NUMBER.sub("", _LEAD.sub("", text)))).strip()


def quote_candidates(text: str | None, anchors: re.Pattern) -> list[tuple[int, str]]:
    """(position, quote): sentences of a fair length, long ones narrowed to windows around anchors."""
    text = (text or "").strip()
    if not text:
        return []
    parts = [p for p in (x.strip() for x in _SPLIT.split(text)) if len(p) >= R.MIN_QUOTE] or [text]
    found: dict[str, int] = {}
    for part in parts:
        if len(part) <= R.MAX_QUOTE:
            quotes = [clause(part)]
            if len(quotes[0]) > FOCUS_OVER:
                m = anchors.search(quotes[0])
                quotes = [clause(quotes[0][max(0, m.start() - BEFORE) : m.end() + AFTER])] if m else []
        else:
            quotes = []
            for m in anchors.finditer(part):
                q = clause(part[max(0, m.start() - BEFORE) : m.end() + AFTER])
                if len(q) >= R.MIN_QUOTE and q not in quotes:
                    quotes.append(q)
                if len(quotes) == WINDOWS:
                    break
        for q in quotes:
            if len(q) >= R.MIN_QUOTE and q not in found:
                found[q] = max(0, text.find(part) + part.find(q))
    return sorted((at, q) for q, at in found.items())


def candidates(rows: DataFrame, text: str = "text", names: str = "names", patterns: list[str] | None = None) -> DataFrame:
    """Explodes ``index`` and ``quote``; ``names`` (array) are anchors besides the signal patterns."""
    signals = patterns or [R.ASSERTION, R.ACTION, R.MARKET]

    @F.pandas_udf("array<struct<index: int, quote: string>>")
    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(t, n):
            sources = sorted({*signals, *(re.escape(v) for v in (y if y is not None else []) if v)})
            out.append([{"index": i, "quote": q} for i, q in quote_candidates(x, re.compile("|".join(sources), re.I))])
        return pd.Series(out)

    return rows.withColumn("c", F.explode(run(text, names))).withColumn("index", F.col("c.index")).withColumn("quote", F.col("c.quote")).drop("c")


def concrete(entities: Column) -> Column:
    return F.exists(entities, lambda e: F.coalesce(e.ticker != "", F.lit(False)) | e.type.isin(R.CONCRETE_TYPES))


def strong_signal(quote: Column, entities: Column) -> Column:
    """None of three kinds of denied content; an assertion and a specific action, about a concrete entity or a macro subject."""
    said = quote.rlike(f"(?i){R.ASSERTION}") & quote.rlike(f"(?i){R.SPECIFIC_ACTION}")
    return ~any_pattern(quote, [f"(?i){p}" for p in (R.HARD_DENY, R.ANECDOTES, R.BANTER)]) & said & (concrete(entities) | quote.rlike(f"(?i){R.MACRO}"))


def candidate_score(quote: Column, entities: Column) -> Column:
    return additive([
        (F.size(entities) > 0, 8),
        (F.exists(entities, lambda e: F.coalesce(e.ticker != "", F.lit(False))), 4),
        (F.exists(entities, lambda e: e.type.isin("company", "ticker")), 3),
        (quote.rlike(f"(?i){R.MARKET}"), 4),
        (quote.rlike(f"(?i){R.MACRO}"), 2),
        (quote.rlike(f"(?i){R.ASSERTION}"), 2),
        (F.length(quote) <= R.MAX_QUOTE, 1),
    ])


def confidence_points(quote: Column, quote_entities: Column, segment_entities: Column, assets: Column, topics: Column) -> Column:
    """Confidence in whole hundredths, at most 90."""
    market = quote.rlike(f"(?i){R.MARKET}")
    points = additive([
        (F.size(quote_entities) > 0, 15),
        ((F.size(quote_entities) == 0) & (F.size(segment_entities) > 0) & market, 4),
        (F.size(assets) > 0, 5),
        (F.size(topics) > 0, 5),
        (quote.rlike(R.ascii_edges("(?i)" + "|".join(p for p, _ in R.CLAIM_TYPES))), 8),
        (market, 5),
        (F.length(quote).between(40, R.MAX_QUOTE), 3),
    ], 55)
    return F.least(points, F.lit(90))


def claim_type(quote: Column, topics: Column) -> Column:
    default = F.when(F.exists(topics, lambda t: t.rlike(f"(?i){R.MACRO}")), "macro").otherwise("fact")
    return pattern_cascade(quote, [(R.ascii_edges(f"(?i){p}"), k) for p, k in R.CLAIM_TYPES], default)


def near_copies(rows: DataFrame, keys: list[str], order: str, text: str, limit: float = 0.55, size: int = 6) -> DataFrame:
    """(keys, a, b): pairs of a group's texts, a before b, that contain each other or whose n-grams overlap by ``limit``.

    Texts meet on rare n-grams only: two that overlap enough share one among the rarest of either (a prefix
    as long as the limit asks for), and one that is contained shares its rarest with the other.
    Of n-grams their hashes are dealt out: equal ones only add pairs, which the texts decide, and prefixes are as
    long as the true number of n-grams asks for. N-grams that one text alone has count for its ranks and go early.
    """
    rows = rows.select(*keys, F.col(order).alias("o"), F.col(text).alias("t"))
    grams = rows.select(*keys, "o", F.length("t").alias("len"), shingles("t", size).alias("g"))
    grams = grams.select(*keys, "o", "len", F.size("g").alias("s"), F.array_distinct(F.transform("g", lambda x: F.xxhash64(x))).alias("g"))
    grams = grams.select(*keys, "o", "len", "s", F.size("g").alias("h"), F.explode("g").alias("gram"))
    grams = grams.withColumn("f", F.count("*").over(Window.partitionBy(*keys, "gram"))).filter("f > 1")
    mine = Window.partitionBy(*keys, "o")
    rank = F.col("h") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("f", "gram"))
    grams = grams.withColumn("r", rank).select(*keys, "gram", "o", "len", "s", "r", (F.col("r") <= F.col("s") - F.ceil(F.col("s") * limit) + 1).alias("rare"))
    other = grams.select(*keys, "gram", F.col("o").alias("p"), F.col("len").alias("plen"), F.col("s").alias("ps"), F.col("rare").alias("prare"))
    alike = F.col("prare") & (F.col("o") < F.col("p")) & (F.least("s", "ps") >= limit * F.greatest("s", "ps"))
    within = (F.col("r") == 1) & (F.col("o") != F.col("p")) & (F.col("len") <= F.col("plen"))
    pairs = grams.filter("rare").join(other, [*keys, "gram"]).filter(alike | within)
    pairs = pairs.select(*keys, F.least("o", "p").alias("a"), F.greatest("o", "p").alias("b")).distinct()
    side = lambda n: rows.select(*keys, F.col("o").alias(n), F.col("t").alias(f"t{n}"))
    pairs = pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    overlap = lambda x: bind(F.size(F.array_intersect(x.a, x.b)), lambda both: both >= F.lit(limit) * (F.size(x.a) + F.size(x.b) - both))
    enough = bind(F.struct(shingles("ta", size).alias("a"), shingles("tb", size).alias("b")), overlap)
    same = F.col("ta").contains(F.col("tb")) | F.col("tb").contains(F.col("ta")) | enough
    return pairs.filter(same).select(*keys, "a", "b")


def drop_near_copies(quotes: Column, limit: float = 0.55) -> Column:
    """Keep-first over an ordered array of structs with ``key`` and ``grams``: a later one that contains,
    is contained in, or overlaps a kept one goes."""

    def step(kept, x):
        alike = (x.key != "") & F.exists(kept, lambda k: (k.key != "") & (k.key.contains(x.key) | x.key.contains(k.key) | (F.size(F.array_intersect(k.grams, x.grams)) >= limit * F.size(F.array_union(k.grams, x.grams)))))
        return F.when(alike, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(quotes, F.slice(quotes, 1, 0), step)


def extract_claims(segments: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims of topic segments (id, rawItemId, text, topics, mentionedAssets, start, end, position)."""
    e = entities.select("rawItemId", F.explode("evidenceSegmentIds").alias("segmentId"), F.struct("canonicalName", "ticker", "type", "aliases").alias("e"))
    e = e.groupBy("rawItemId", "segmentId").agg(F.sort_array(F.collect_list("e")).alias("segmentEntities"))
    rows = segments.withColumnRenamed("id", "segmentId").join(e, ["rawItemId", "segmentId"], "left")
    rows = rows.withColumn("segmentEntities", F.coalesce("segmentEntities", F.array().cast(dict(e.dtypes)["segmentEntities"])))
    every = lambda x: F.array_compact(F.concat(F.array(x.canonicalName, x.ticker), x.aliases))
    rows = candidates(rows.withColumn("names", F.flatten(F.transform("segmentEntities", every))))
    rows = rows.withColumn("quoteEntities", F.filter("segmentEntities", lambda x: mentioned(F.col("quote"), every(x))))
    rows = rows.filter(strong_signal(F.col("quote"), F.col("quoteEntities")))
    rows = rows.withColumn("score", candidate_score(F.col("quote"), F.col("quoteEntities")))
    # of similar quotes the earliest stays, even if a later one scores more
    item = F.struct("index", "quote", quote_key("quote").alias("key"), shingles(quote_key("quote")).alias("grams"))
    kept = rows.groupBy("rawItemId", "segmentId").agg(drop_near_copies(F.sort_array(F.collect_list(item))).alias("k"))
    kept = kept.select("rawItemId", "segmentId", F.explode("k").alias("k")).select("rawItemId", "segmentId", "k.index", "k.quote")
    best = Window.partitionBy("rawItemId", "segmentId").orderBy(F.desc("score"), "index")
    rows = rows.join(kept, ["rawItemId", "segmentId", "index", "quote"], "left_semi").withColumn("r", F.row_number().over(best)).filter("r = 1")
    number = F.row_number().over(Window.partitionBy("rawItemId").orderBy("position", "segmentId"))
    points = confidence_points(F.col("quote"), F.col("quoteEntities"), F.col("segmentEntities"), F.col("mentionedAssets"), F.col("topics"))
    return rows.select(
        F.format_string("%s-claim-%03d", "rawItemId", number).alias("id"),
        "rawItemId",
        "segmentId",
        F.col("quote").alias("claim"),
        claim_type(F.col("quote"), F.col("topics")).alias("claimType"),
        F.array_sort(F.array_distinct(F.transform("quoteEntities", lambda x: x.canonicalName))).alias("entities"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform("quoteEntities", lambda x: x.ticker)))).alias("tickers"),
        polarity("quote", f"(?i){R.BULLISH}", f"(?i){R.BEARISH}").alias("sentiment"),
        (points / 100).alias("confidence"),
        F.struct("start", "end", "quote").alias("evidence"),
    )
