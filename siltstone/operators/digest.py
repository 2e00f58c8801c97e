"""Digest: summaries enriched with top evidence, insights and chips; the index and its queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import rules as R
from siltstone.functions.scoring import editorial, lookup
from siltstone.functions.text import clock, compact_text, fold_replacements


def top_k(rows: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes within tasks before it shuffles."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)


def gather(rows: DataFrame, keys: list[str], order: str, item: Column, out: str) -> DataFrame:
    """An array of ``item`` per group in order."""
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v")))).alias("l"))
    return lists.select(*keys, F.transform("l", lambda x: x.v).alias(out))


def concise(c) -> Column:
    """Editorial wording of a claim where a rule has one, else the claim in at most 112 characters."""
    return editorial(c, R.DIGEST_EDITORIAL, compact_text(c, 112))


def evidence(claims: DataFrame, k: int = 4) -> DataFrame:
    good = claims.filter((F.col("confidence") >= R.MIN_CONFIDENCE) & F.coalesce(F.nullif("claim", F.lit("")), F.nullif("evidence.quote", F.lit(""))).isNotNull())
    mood = lookup("sentiment", {"bearish": 2, "mixed": 2, "bullish": 1}, 0)
    points = 1000 * (F.coalesce(lookup("claimType", R.EVIDENCE_PRIORITY), F.lit(0)) + mood) + F.round(F.col("confidence") * 10000).cast("long")
    rows = top_k(good.withColumn("points", points), ["rawItemId"], [F.desc("points"), F.desc("confidence"), "id"], k)
    item = F.struct(
        "id", concise(F.coalesce(F.nullif("claim", F.lit("")), F.col("evidence.quote"))).alias("claim"), "claimType", "sentiment", F.round("confidence", 2).alias("confidence"),
        F.slice(F.array_distinct("entities"), 1, 4).alias("entities"), F.slice(F.array_distinct("tickers"), 1, 4).alias("tickers"),
        F.struct("evidence.start", "evidence.end", compact_text("evidence.quote", 88).alias("quote")).alias("evidence"),
    )
    return gather(rows, ["rawItemId"], "rank", item, "evidenceClaims")


def top_insights(rows: DataFrame, k: int = 3) -> DataFrame:
    rows = rows.withColumn("level", lookup("riskLevel", R.RISK_LEVELS, 1))
    rows = top_k(rows, ["rawItemId"], [F.desc("level"), F.desc(F.size("claimIds")), "title"], k)
    item = F.struct("id", "watchlistKey", compact_text("title", 56).alias("title"), compact_text("summary", 128).alias("summary"), F.slice("relatedTickers", 1, 6).alias("relatedTickers"), F.slice("claimIds", 1, 5).alias("claimIds"), "riskLevel")
    return gather(rows, ["rawItemId"], "rank", item, "watchlistInsights")


def chips(summaries: DataFrame, claims: DataFrame, entities: DataFrame, k: int = 8) -> DataFrame:
    """Labels of assets, then claims' tickers, then entities; each once, first ``k``."""
    e = entities.withColumn("alias", F.explode(F.array_compact(F.concat(F.array("canonicalName", "ticker"), "aliases"))))
    by_name = e.groupBy("rawItemId", F.lower("alias").alias("low")).agg(F.min_by(F.struct("type", "ticker"), "id").alias("known"))
    assets = summaries.select(F.col("id").alias("rawItemId"), F.lit(0).alias("stage"), F.posexplode("mentionedAssets").alias("n", "label"))
    tickers = claims.select("rawItemId", F.lit(1).alias("stage"), F.col("id").alias("cid"), F.explode("tickers").alias("label"))
    tickers = tickers.groupBy("rawItemId", "stage", "label").agg(F.min("cid").alias("cid")).withColumn("n", F.row_number().over(Window.partitionBy("rawItemId").orderBy("cid", "label")))
    rows = assets.unionByName(tickers.select(assets.columns)).withColumn("low", F.lower("label")).join(by_name, ["rawItemId", "low"], "left")
    ticker = F.when(F.col("stage") == 1, F.col("label")).otherwise(F.col("known.ticker"))
    rows = rows.select("rawItemId", "stage", "n", F.trim("label").alias("label"), F.coalesce("known.type", F.lit("ticker")).alias("type"), ticker.alias("ticker"))
    own = entities.filter(F.col("type").isin(R.CHIP_TYPES))
    own = own.select("rawItemId", F.lit(2).alias("stage"), F.row_number().over(Window.partitionBy("rawItemId").orderBy("id")).alias("n"), F.trim(F.coalesce("ticker", "canonicalName")).alias("label"), "type", "ticker")
    rows = rows.unionByName(own).filter("label <> ''")
    first = Window.partitionBy("rawItemId", F.lower("label"), F.lower(F.coalesce("ticker", F.lit("")))).orderBy("stage", "n")
    rows = rows.withColumn("r", F.row_number().over(first)).filter("r = 1")
    rows = top_k(rows, ["rawItemId"], ["stage", "n"], k)
    return gather(rows, ["rawItemId"], "rank", F.struct("label", "type", "ticker"), "entityChips")


def enrich(summaries: DataFrame, claims: DataFrame, insights: DataFrame, entities: DataFrame) -> DataFrame:
    """Summaries with their optional lists (null where empty), newest first."""
    rows = summaries
    for t in (evidence(claims), top_insights(insights), chips(summaries, claims, entities)):
        rows = rows.join(t.withColumnRenamed("rawItemId", "id"), "id", "left")
    return rows.orderBy(F.desc("publishedAt"), "id")


def index(enriched: DataFrame, now: Column, disclaimer: str, timezone: str = "Asia/Taipei") -> DataFrame:
    """The single index row. For publication only: it gathers all summaries."""
    lists = enriched.agg(F.sort_array(F.collect_list(F.struct("publishedAt", "id", F.struct(*enriched.columns).alias("s"))), asc=False).alias("l"))
    return lists.select(now.alias("generatedAt"), F.lit(timezone).alias("timezone"), F.lit(disclaimer).alias("disclaimer"), F.transform("l", lambda x: x.s).alias("summaries"))


# -- queries over enriched summaries ---------------------------------------------------


def search(rows: DataFrame, text: str | None = None, show: str | None = None) -> DataFrame:
    """Newest first; of one show; with a keyword anywhere in the searchable text."""
    if show and show != "all":
        rows = rows.filter(F.col("sourceSlug") == show)
    if text and text.strip():
        lists = [c for c, k in rows.dtypes if k.startswith("array") and c in ("topics", "mentionedAssets", "evidenceClaims", "watchlistInsights", "entityChips")]
        flat = F.concat_ws(" ", "title", "excerpt", *[F.to_json(c) if dict(rows.dtypes)[c] != "array<string>" else F.array_join(c, " ") for c in lists])
        rows = rows.filter(F.lower(flat).contains(text.strip().lower()))
    return rows.orderBy(F.desc("publishedAt"), "id")


def by_id(rows: DataFrame, wanted: str) -> DataFrame:
    return rows.filter(F.col("id") == wanted)


def stats(rows: DataFrame) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))), F.lit(0)).alias
    return rows.agg(F.countDistinct("sourceId").alias("sources"), F.count("*").alias("summaries"), count("evidenceClaims")("claims"), count("watchlistInsights")("insights"))


def cards(rows: DataFrame) -> DataFrame:
    some = F.size(F.coalesce("entityChips", F.array().cast(dict(rows.dtypes)["entityChips"]))) > 0
    labels = F.when(some, F.transform("entityChips", lambda c: c.label)).otherwise(F.col("mentionedAssets"))
    return rows.select(
        "id", "title", compact_text("excerpt", 180).alias("excerpt"), F.slice("topics", 1, 4).alias("topics"), F.slice(labels, 1, 4).alias("chips"),
        F.nullif(F.coalesce(F.size("evidenceClaims"), F.lit(0)), F.lit(0)).alias("n_claims"), F.nullif(F.coalesce(F.size("watchlistInsights"), F.lit(0)), F.lit(0)).alias("n_insights"),
    )


def claim_list(rows: DataFrame) -> DataFrame:
    c = rows.select("id", F.posexplode("evidenceClaims").alias("n", "c"))
    return c.select("id", "n", "c.claim", "c.claimType", "c.sentiment", F.round(F.col("c.confidence") * 100).cast("int").alias("percent"), clock("c.evidence.start").alias("at"), F.slice(F.concat("c.tickers", "c.entities"), 1, 6).alias("labels"))


def insight_list(rows: DataFrame) -> DataFrame:
    i = rows.select("id", F.posexplode("watchlistInsights").alias("n", "i"))
    return i.select("id", "n", "i.title", "i.riskLevel", F.size("i.claimIds").alias("n_claims"))


def labelled(rows: DataFrame, column: str, labels: dict[str, str], out: str) -> DataFrame:
    """A display label by table; unknown values as they are."""
    return rows.withColumn(out, lookup(column, labels, F.col(column)))


def display_text(c) -> Column:
    """Variants that remain in texts, in their display form."""
    return fold_replacements(c, R.DISPLAY_VARIANTS)


def display(rows: DataFrame) -> DataFrame:
    """Labels and tones of claims, insights and summaries for those of the columns claimType, sentiment, riskLevel and sourceTextQuality that are there."""
    tables = [
        ("claimType", R.CLAIM_TYPE_LABELS, "claimTypeLabel"), ("sentiment", R.SENTIMENT_LABELS, "sentimentLabel"), ("sentiment", R.SENTIMENT_TONES, "sentimentTone"),
        ("riskLevel", R.RISK_LABELS, "riskLevelLabel"), ("riskLevel", R.RISK_TONES, "riskTone"), ("sourceTextQuality", R.QUALITY_LABELS, "sourceTextQualityLabel"),
    ]
    for column, labels, out in tables:
        if column in rows.columns:
            rows = labelled(rows, column, labels, out)
    return rows
