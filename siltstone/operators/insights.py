"""Watchlist insights: which items touch a watchlist, through which claims, at what risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import rules as R
from siltstone.functions.match import any_term, matched_terms
from siltstone.functions.scoring import cascade, lookup
from siltstone.functions.text import normalize_sentence


def union_keys(*tables: DataFrame, key: str = "rawItemId") -> DataFrame:
    """Distinct keys of any table."""
    return reduce(lambda a, b: a.unionByName(b), [t.select(key) for t in tables]).distinct()


def risk_points(kind: Column, sentiment: Column) -> Column:
    return F.coalesce(lookup(kind, R.RISK_POINTS), F.lit(0)) + F.when(sentiment.isin("bearish", "mixed"), 2).otherwise(0)


def risk_level(rows_high: Column, rows_medium: Column, told: Column) -> Column:
    return F.when(rows_high, "high").when(rows_medium | told, "medium").otherwise("low")


#: fixed values: what a risk level says, and what the best claim says, the first that fits
RISK_WORDS = {"high": "風險訊號偏高，適合列入優先追蹤。", "medium": "具備後續追蹤價值。", "low": "目前偏資訊整理，先保留觀察。"}
CLAIM_THEMES = [("risk", "bearish", "主張顯示風險或壓力升高"), ("catalyst", "bullish", "主張顯示可能的催化或偏多線索"), ("macro", None, "主張聚焦總經變數")]


def claim_theme(claim: str) -> Column:
    """What a claim (a struct) is about, with up to three of its entities and tickers."""
    c = F.col(claim)
    rules = [((c.claimType == kind) | (c.sentiment == mood) if mood else c.claimType == kind, words) for kind, mood, words in CLAIM_THEMES]
    names = F.slice(F.concat(c.entities, c.tickers), 1, 3)
    return F.concat(cascade(rules, "主張提供後續觀察線索"), F.when(F.size(names) > 0, F.concat(F.lit("，涉及 "), F.array_join(names, "、"))).otherwise(""), F.lit("。"))


def listed(head: str, c, k: int, tail: str) -> Column:
    return F.concat(F.lit(head), F.array_join(F.slice(c, 1, k), "、"), F.lit(tail))


def ordered(rows: DataFrame) -> DataFrame:
    """Insights of an item by watchlist."""
    return rows.orderBy("rawItemId", "watchlistKey")


def insights(summaries: DataFrame, claims: DataFrame, entities: DataFrame, watchlists: list[dict], guards: dict | None = None) -> DataFrame:
    """One insight per (item, watchlist) that a claim, an entity or the summary touches and whose guard holds."""
    guards = R.GUARDS if guards is None else guards
    claim_text = F.concat_ws(" ", "claim", "claimType", "sentiment", F.array_join("entities", " "), F.array_join("tickers", " "))
    entity_text = F.concat_ws(" ", "canonicalName", "ticker", "type", F.array_join("aliases", " "))
    join = lambda c: F.array_join(c, " ")
    told = F.concat_ws(" ", "title", "excerpt", join("keyPoints"), join("topics"), join("mentionedAssets"), join("risks"))
    out = []
    for w in watchlists:
        terms, guard = w["terms"], guards.get(w["key"], {})
        c = claims.withColumn("found", matched_terms(claim_text, terms, "letters")).filter(F.size("found") > 0)
        c = c.withColumn("points", risk_points(F.col("claimType"), F.col("sentiment")))
        rank = F.row_number().over(Window.partitionBy("rawItemId").orderBy(F.desc("points"), F.desc("confidence"), "id"))
        c = c.withColumn("rank", rank).groupBy("rawItemId").agg(
            F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "id")))).alias("ids"),
            F.min_by(F.struct("claim", "claimType", "sentiment", "entities", "tickers"), "rank").alias("best"),
            F.array_distinct(F.flatten(F.collect_list("found"))).alias("claim_terms"),
            F.array_distinct(F.flatten(F.collect_list("tickers"))).alias("claim_tickers"),
            F.bool_or((F.col("claimType") == "risk") | (F.col("sentiment") == "bearish") | ((F.col("sentiment") == "mixed") & (F.col("confidence") >= 0.85))).alias("high"),
            F.bool_or(F.col("claimType").isin("macro", "forecast", "catalyst")).alias("medium"),
        )
        known = F.upper(F.coalesce("ticker", F.lit(""))).isin(guard.get("tickers", [])) | F.col("canonicalName").rlike(guard.get("names", "(?!)"))
        e = entities.withColumn("found", matched_terms(entity_text, terms, "letters")).filter(F.size("found") > 0).groupBy("rawItemId").agg(
            F.array_distinct(F.flatten(F.collect_list("found"))).alias("entity_terms"),
            F.array_compact(F.collect_set("ticker")).alias("entity_tickers"),
            F.transform(F.sort_array(F.collect_set(F.struct("type", "canonicalName", "ticker"))), lambda x: x.canonicalName).alias("names"),
            F.bool_or(known).alias("known"),
        )
        s = summaries.select(
            F.col("id").alias("rawItemId"),
            matched_terms(told, terms, "letters").alias("summary_terms"),
            F.exists("risks", lambda r: any_term(r, terms, "letters")).alias("risk_told"),
            F.get(F.filter("topics", lambda t: any_term(t, terms, "letters")), F.lit(0)).alias("topic"),
            F.get(F.filter(F.transform(F.concat("keyPoints", "risks"), lambda x: normalize_sentence(x)), lambda x: (F.length(x) >= 12) & any_term(x, terms, "letters")), F.lit(0)).alias("sentence"),
        )
        rows = union_keys(c, e, s.filter(F.size("summary_terms") > 0))
        for t in (c, e, s):
            rows = rows.join(t, "rawItemId", "left")
        rows = rows.withColumn("first_entity", F.get("names", F.lit(0)))
        none = F.array().cast("array<string>")
        some = lambda x: F.coalesce(x, none)
        has_claim = F.col("best").isNotNull()
        evidence = F.array_union(some("claim_terms"), some("entity_terms"))
        if "claim_terms" in guard:
            ok = has_claim & F.exists(evidence, lambda t: F.lower(t).isin(guard["claim_terms"]))
        elif guard:
            ok = has_claim | F.coalesce("known", F.lit(False))
        else:
            ok = has_claim | F.col("entity_terms").isNotNull()
        found = F.array_sort(F.array_union(some("summary_terms"), evidence))
        tickers = F.array_sort(F.array_union(some("claim_tickers"), F.array_union(some("entity_tickers"), F.array_intersect(found, F.array(*map(F.lit, guard.get("tickers", ["-"])))))))
        if "only_tickers" in guard:
            tickers = F.array_intersect(tickers, F.array(*map(F.lit, guard["only_tickers"])))
        level = risk_level(F.coalesce("high", F.lit(False)), F.coalesce("medium", F.lit(False)), F.coalesce("risk_told", F.lit(False)))
        named = F.lit(None).cast("string")
        if "subject" in guard:  # (pattern, subject): what the title is about if a term matches
            named = F.when(F.exists(found, lambda t: t.rlike(f"(?i){guard['subject'][0]}")), F.lit(guard["subject"][1]))
        subject = F.coalesce(named, F.nullif(F.array_join(F.slice("relatedTickers", 1, 3), "、"), F.lit("")), "first_entity", "topic", F.array_join(F.slice(found, 1, 2), " / "))
        told_risk = lookup("riskLevel", RISK_WORDS)
        codes = F.when(F.size("relatedTickers") > 0, listed("相關代號：", "relatedTickers", 8, "。")).otherwise("")
        label = F.array_join(F.slice(found, 1, 4), "、")
        begin = F.concat(F.when(has_claim, claim_theme("best")).otherwise(F.col("sentence")), F.lit(" "))
        begin = F.when(begin.isNotNull(), begin)
        begin = begin.when(F.size("names") > 0, F.concat(listed("本集提及 ", "names", 3, "，與「"), label, F.lit("」觀察清單相關。")))
        begin = begin.otherwise(F.concat(F.lit("本集摘要與「"), label, F.lit("」觀察清單相關。")))
        summary = F.concat(begin, codes, told_risk)
        if "claim_summary" in guard:
            summary = F.when(has_claim, F.concat(F.lit(guard["claim_summary"]), codes, told_risk)).otherwise(summary)
        rows = rows.filter(ok).withColumn("relatedTickers", F.slice(tickers, 1, 8)).withColumn("riskLevel", level)
        out.append(
            rows.select(
                F.concat_ws("-", "rawItemId", F.lit(w["key"])).alias("id"),
                "rawItemId",
                F.lit(w["key"]).alias("watchlistKey"),
                F.concat(F.lit(f"{w['name']} 觀察："), subject).alias("title"),
                F.trim(summary).alias("summary"),
                "relatedTickers",
                F.transform(F.array_compact(F.coalesce("ids", F.array().cast("array<struct<rank: int, id: string>>"))), lambda x: x.id).alias("claimIds"),
                "riskLevel",
            )
        )
    return reduce(lambda a, b: a.unionByName(b), out)
