"""Integrity constraints and the content gate: every rule yields failure rows (table, id, check, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import rules as R
from siltstone.functions.text import any_pattern, guarded, without_lines

#: fixed value: what bullets are compared without
BULLET_MARKS = r"(?U)[\s，。！？；：、,.!?;:「」『』()（）【】]"
FAILURE = "array<struct<check: string, detail: string>>"


def failure(condition: Column, check: str, detail) -> Column:
    detail = detail if isinstance(detail, Column) else F.lit(detail)
    return F.when(condition, F.struct(F.lit(check).alias("check"), detail.cast("string").alias("detail")))


def collect_failures(rows: DataFrame, table: str, key: str, rules: list[Column]) -> DataFrame:
    """A row for each rule that a row breaks; one pass, no shuffle."""
    found = rows.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("id"), F.explode(F.array_compact(F.array(*rules))).alias("f"))
    return found.select("table", "id", "f.check", "f.detail")


def duplicates(rows: DataFrame, table: str, keys: list[str]) -> DataFrame:
    n = rows.groupBy(*keys).count().filter("count > 1")
    return n.select(F.lit(table).alias("table"), F.concat_ws("|", *keys).alias("id"), F.lit("duplicate-key").alias("check"), F.col("count").cast("string").alias("detail"))


def orphans(rows: DataFrame, table: str, key: str, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """References without a parent."""
    p = parents.select(F.col(parent_key).alias(column)).distinct()
    lost = rows.filter(F.col(column).isNotNull()).join(p, column, "left_anti")
    return lost.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("id"), F.lit("unknown-reference").alias("check"), F.col(column).cast("string").alias("detail"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_entities(entities: DataFrame) -> DataFrame:
    empty = collect_failures(entities, "entities", "id", [failure(F.size("evidenceSegmentIds") <= 0, "no-evidence", F.col("canonicalName"))])
    keyed = entities.withColumn("ticker", F.coalesce("ticker", F.lit("")))
    return union_all([duplicates(keyed, "entities", ["rawItemId", "canonicalName", "ticker", "type"]), empty])


def check_claims(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """One join with the segments serves the references and the quotes."""
    s = segments.select(F.col("id").alias("segmentId"), F.col("text").alias("segment_text"), F.lit(True).alias("known"))
    quote = F.col("evidence.quote")
    rules = [
        failure(F.col("known").isNull() & F.col("segmentId").isNotNull(), "unknown-reference", F.col("segmentId")),
        failure(F.coalesce(F.trim(quote), F.lit("")) == "", "empty-quote", ""),
        failure(~F.coalesce(F.col("segment_text").contains(quote), F.lit(True)), "quote-not-in-segment", quote),
        failure(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence-range", F.col("confidence")),
    ]
    return union_all([duplicates(claims, "claims", ["id"]), collect_failures(claims.join(s, "segmentId", "left"), "claims", "id", rules)])


def check_insights(insights: DataFrame, claims: DataFrame) -> DataFrame:
    refs = insights.select("id", F.explode("claimIds").alias("claimId"))
    rules = [failure((F.coalesce("title", F.lit("")) == "") | (F.coalesce("summary", F.lit("")) == ""), "empty-text", "")]
    return union_all([
        duplicates(insights, "insights", ["id"]),
        duplicates(insights, "insights", ["rawItemId", "watchlistKey"]),
        orphans(refs, "insights", "id", "claimId", claims, "id"),
        collect_failures(insights, "insights", "id", rules),
    ])


def check_summaries(summaries: DataFrame, gate: dict | None = None) -> DataFrame:
    """The content gate over id, keyPoints, body, excerpt, risks."""
    g = R.GATE | (gate or {})
    none = F.array().cast("array<string>")
    points, risks = F.coalesce("keyPoints", none), F.coalesce("risks", none)
    body = F.coalesce("body", F.lit(""))
    rows = summaries.withColumn("points", points).withColumn("text", without_lines(F.concat_ws("\n", "excerpt", F.array_join(points, "\n"), body), g["allowed_line"]))
    bullets = F.size(F.filter(F.split(body, "\n"), lambda x: x.startswith("- ")))
    tldr = F.regexp_extract(body, rf"(?m)^{g['body_start']}(.+)$", 1)
    plain = lambda x: F.lower(F.regexp_replace(x, BULLET_MARKS, ""))
    bullet_keys = F.transform(F.col("points"), plain)
    simple = F.size(F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(f"({guarded(p)})"), F.lit(1)) for p in g["simplified"]])))
    filler = F.size(F.filter("points", lambda p: any_pattern(p, g["fillers"])))
    spoken = [R.ascii_edges(p) for p in g["transcript_like"]]
    rules = [
        failure(F.size("points") < g["min_points"], "structure", F.size("points")),
        failure(~body.startswith(g["body_start"]), "structure", "body-start"),
        *[failure(~body.contains(s), "structure", s) for s in g["sections"]],
        failure(bullets != F.size("points"), "structure", bullets),
        failure((tldr != "") & (plain(tldr) == plain(F.coalesce(F.get("points", F.lit(0)), F.lit("")))), "template-duplication", tldr),
        failure(~F.exists(risks, lambda r: reduce(lambda a, b: a | b, [r.contains(c) for c in g["caution"]])), "structure", "caution"),
        failure(any_pattern("text", g["sponsors"]), "sponsor-leakage", ""),
        failure(simple > g["max_simplified"], "simplified-chinese-drift", simple),
        failure(F.size(bullet_keys) != F.size(F.array_distinct(bullet_keys)), "duplicate-bullets", ""),
        failure(filler > g["max_filler"], "filler-bullets", filler),
        failure(F.exists("points", lambda p: F.length(p) > g["max_point_chars"]), "transcript-like-keypoint", "length"),
        failure(F.exists("points", lambda p: any_pattern(p, spoken)), "transcript-like-keypoint", "pattern"),
        failure(F.exists("points", lambda p: ~F.trim(p).rlike(f"[{g['ends']}]$")), "structure", "point-end"),
    ]
    return collect_failures(rows, "summaries", "id", rules)


def check_index(index: DataFrame, disclaimer: str) -> DataFrame:
    rules = [failure(~F.col("disclaimer").eqNullSafe(F.lit(disclaimer)), "structure", "disclaimer"), failure(F.col("summaries").isNull(), "structure", "summaries")]
    return collect_failures(index.withColumn("name", F.lit("index")), "index", "name", rules)


def require_none(failures: DataFrame, show: int = 20) -> None:
    """Raise if there is any failure, naming some."""
    found = failures.take(show)
    if found:
        raise ValueError("; ".join(f"{r.table} {r.id}: {r.check} {r.detail}" for r in found))


