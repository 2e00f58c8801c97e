"""Queries: joins, set operations, integrity, ranking, votes, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.catalog import query, table
from siltstone.functions.scoring import lookup, vote
from siltstone.functions.text import first_non_empty, text_or_blank
from siltstone.operators import digest, quality, summaries, transcripts
from siltstone.operators.insights import union_keys
from siltstone.streaming import incremental


@query("""
SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, lang,
  CASE WHEN length(coalesce(text, '')) > 240 THEN 'show-notes' ELSE 'metadata-only' END AS quality FROM documents""")
def scan_project_raw_items(spark, d):
    docs = table(spark, d, "documents")
    title = F.split_part(text_or_blank("text"), F.lit("\n"), F.lit(1)).alias("title")
    return docs.select("doc_id", title, "lang", summaries.text_quality(F.lit(None), text_or_blank("text")).alias("quality"))


@query("""
SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), nullif(url, ''), 'untitled') AS title FROM pages""")
def coalesce_first_nonempty(spark, d):
    pages = table(spark, d, "pages")
    found = [F.regexp_extract("html", f"<{t}>([^<]*)</{t}>", 1) for t in ("h1", "title")]
    return pages.select("page_id", first_non_empty(*found, "url", F.lit("untitled")).alias("title"))


@query("""
SELECT user_id, event_id, ts, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 3""")
def source_limit_newest(spark, d):
    return digest.top_k(table(spark, d, "events"), ["user_id"], [F.desc("ts"), "event_id"], 3).select("user_id", "event_id", "ts", "rank")


@query("""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, l.doc_id IS NOT NULL AS labelled
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_join_optional_labels(spark, d):
    labels = table(spark, d, "labels").withColumn("labelled", F.lit(True))
    rows = table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("""
WITH k AS (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier)
SELECT k.k AS key, c.c_custkey IS NOT NULL AS is_customer, o.n IS NOT NULL AS has_orders, s.s_suppkey IS NOT NULL AS is_supplier, coalesce(o.n, 0) AS n_orders
FROM k LEFT JOIN customer c ON c.c_custkey = k.k LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = k.k LEFT JOIN supplier s ON s.s_suppkey = k.k""")
def full_outer_key_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(True).alias("c"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(True).alias("s"))
    rows = union_keys(c, o, s, key="key")
    for t in (c, o, s):
        rows = rows.join(t, "key", "left")
    return rows.select("key", F.col("c").isNotNull().alias("is_customer"), F.col("n").isNotNull().alias("has_orders"), F.col("s").isNotNull().alias("is_supplier"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_resume(spark, d):
    return incremental.not_done(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_referenced(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("""
SELECT 'lineitem-orders' AS relation, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders-customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer-nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'nation-region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)""")
def fk_integrity(spark, d):
    relations = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    counts = []
    for child, fk, parent, pk in relations:
        lost = quality.orphans(table(spark, d, child), child, fk, fk, table(spark, d, parent), pk)
        counts.append(lost.agg(F.count("*").alias("orphans")).select(F.lit(f"{child}-{parent}").alias("relation"), "orphans"))
    return quality.union_all(counts)


@query("""
SELECT doc_id, origin, score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (
    SELECT doc_id, 'labelled' AS origin, CAST(quality AS BIGINT) AS score, 0 AS p FROM labels
    UNION ALL SELECT doc_id, 'raw', n_chars, 1 FROM documents)) WHERE r = 1""")
def priority_union_dedupe(spark, d):
    first = table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("origin"), F.col("quality").cast("long").alias("score"))
    second = table(spark, d, "documents").select("doc_id", F.lit("raw").alias("origin"), F.col("n_chars").alias("score"))
    return transcripts.priority_union([first, second], "doc_id")


@query("""
SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS "sourceName", coalesce(r_name, CAST(s_nationkey AS VARCHAR)) AS "sourceSlug"
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3 LEFT JOIN region ON r_regionkey = n_regionkey""")
def first_match_lookup(spark, d):
    known = table(spark, d, "nation").filter("n_regionkey < 3").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sources = known.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("slug"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("sourceId"))
    return summaries.with_source(rows, sources).drop("sourceId")


@query("""
WITH k AS (
  SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS key FROM part),
best AS (SELECT key, max(p_partkey) AS p_partkey FROM k GROUP BY key)
SELECT l.key, b.p_partkey, p.p_name FROM (SELECT DISTINCT key FROM k) l JOIN best b USING (key) JOIN part p ON p.p_partkey = b.p_partkey""")
def multi_key_lookup(spark, d):
    parts = table(spark, d, "part").select(F.lit("all").alias("rawItemId"), F.col("p_partkey").alias("id"), F.col("p_name").alias("canonicalName"), F.col("p_brand").alias("ticker"), F.col("p_type").alias("type"))
    rows = parts.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array("canonicalName", "ticker", "type")))))
    return rows.groupBy("key").agg(F.max_by(F.struct("id", "canonicalName"), "id").alias("e")).select("key", F.col("e.id").alias("p_partkey"), F.col("e.canonicalName").alias("p_name"))


POLARITY = {"purchase": "bullish", "signup": "bullish", "error": "bearish", "click": "neutral", "view": "neutral"}


@query("""
SELECT user_id, up, flat, down, CASE WHEN up > 0 AND down > 0 THEN 'mixed' WHEN down > up THEN 'bearish' WHEN up > down AND up > flat THEN 'bullish' WHEN flat > 0 THEN 'neutral' ELSE 'insufficient' END AS sentiment
FROM (SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS up, count(*) FILTER (event_type IN ('click', 'view')) AS flat, count(*) FILTER (event_type = 'error') AS down FROM events GROUP BY 1)""")
def sentiment_vote(spark, d):
    rows = table(spark, d, "events").withColumn("s", lookup("event_type", POLARITY))
    rows = rows.groupBy("user_id").agg(*[F.count_if(F.coalesce(F.col("s") == s, F.lit(False))).alias(n) for s, n in (("bullish", "up"), ("neutral", "flat"), ("bearish", "down"))])
    return rows.withColumn("sentiment", vote("up", "flat", "down", F.lit(0)))


@query("""
SELECT o_custkey, o_orderkey, points, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY points DESC, o_totalprice DESC, o_orderkey) AS r FROM (
    SELECT o_custkey, o_orderkey, o_totalprice, CASE left(o_orderpriority, 1) WHEN '1' THEN 8 WHEN '2' THEN 7 WHEN '3' THEN 6 WHEN '4' THEN 5 ELSE 4 END + CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS points FROM orders)) WHERE r <= 4""")
def evidence_topk(spark, d):
    points = lookup(F.substring("o_orderpriority", 1, 1), {"1": 8, "2": 7, "3": 6, "4": 5}, 4) + lookup("o_orderstatus", {"F": 2, "P": 1}, 0)
    rows = table(spark, d, "orders").withColumn("points", points)
    return digest.top_k(rows, ["o_custkey"], [F.desc("points"), F.desc("o_totalprice"), "o_orderkey"], 4).select("o_custkey", "o_orderkey", "points", "rank")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem),
l AS (SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY r), ',') AS lines FROM t WHERE r <= 3 GROUP BY 1)
SELECT o_orderkey, o_custkey, c_name, coalesce(lines, '') AS lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def digest_enrich(spark, d):
    top = digest.top_k(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 3)
    lines = digest.gather(top, ["l_orderkey"], "rank", F.col("l_linenumber").cast("string"), "lines")
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", "o_custkey", "c_name", F.coalesce(F.array_join("lines", ","), F.lit("")).alias("lines"))


@query("""
SELECT count(DISTINCT source) AS sources, count(*) AS summaries, CAST(coalesce(sum(quality), 0) AS BIGINT) AS claims, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS insights
FROM documents LEFT JOIN labels USING (doc_id)""")
def stats_card(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("sourceId")).join(table(spark, d, "labels"), "doc_id", "left")
    some = lambda c: F.when(F.col(c) > 0, F.array_repeat(F.lit("x"), F.col(c))).otherwise(F.array().cast("array<string>"))
    return digest.stats(rows.withColumn("evidenceClaims", some("quality")).withColumn("watchlistInsights", some("toxic")))


@query("""
WITH s AS (
  SELECT o_custkey AS k, 0 AS stage, o_orderkey AS n, lower(o_orderpriority) AS label FROM orders
  UNION ALL SELECT o_custkey, 1, o_orderkey, lower(o_orderstatus) FROM orders
  UNION ALL SELECT c_custkey, 2, 0, lower(c_mktsegment) FROM customer),
f AS (SELECT k, label, stage, n, row_number() OVER (PARTITION BY k, label ORDER BY stage, n) AS r FROM s),
g AS (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY stage, n) AS r FROM f WHERE r = 1)
SELECT k AS c_custkey, array_to_string(list(label ORDER BY r), '|') AS chips FROM g WHERE r <= 8 GROUP BY 1""")
def entity_chips(spark, d):
    o = table(spark, d, "orders")
    part = lambda stage, label: o.select("o_custkey", F.lit(stage).alias("stage"), F.col("o_orderkey").alias("n"), F.lower(label).alias("label"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(2).alias("stage"), F.lit(0).cast("long").alias("n"), F.lower("c_mktsegment").alias("label"))
    rows = part(0, "o_orderpriority").unionByName(part(1, "o_orderstatus")).unionByName(c).withColumnRenamed("o_custkey", "c_custkey")
    return summaries.first_seen(rows, ["c_custkey"], ["stage", "n"], "label", 8, "chips").withColumn("chips", F.array_join("chips", "|"))


@query("""
SELECT p_brand, p_type, count(*) AS count FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    found = quality.duplicates(table(spark, d, "part"), "part", ["p_brand", "p_type"])
    key = F.split("id", r"\|")
    return found.select(F.get(key, F.lit(0)).alias("p_brand"), F.get(key, F.lit(1)).alias("p_type"), F.col("detail").cast("long").alias("count"))


@query("""
SELECT o_custkey AS customer, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS status, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY 1""")
def single_valued_key(spark, d):
    from siltstone.operators.entities import single_key

    rows = single_key(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file"), "o_orderstatus"), "o_orderstatus", "file")
    return rows.select(F.col("file").cast("long").alias("customer"), F.col("o_orderstatus").alias("status"), "conflict")


@query("""
SELECT doc_id, coalesce(toxic, 0) AS toxic, CASE coalesce(quality, -1) WHEN 1 THEN 'good' WHEN 0 THEN 'poor' ELSE '-1' END AS label FROM documents LEFT JOIN labels USING (doc_id)""")
def display_labels(spark, d):
    rows = left_join_optional_labels(spark, d).withColumn("q", F.col("quality").cast("string"))
    return digest.labelled(rows, "q", {"1": "good", "0": "poor"}, "label").select("doc_id", "toxic", "label")


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY g DESC) AS r FROM (
  SELECT event_id, user_id, event_type, 0 AS g FROM events WHERE event_id % 2 = 0 OR event_type <> 'view'
  UNION ALL SELECT event_id, user_id, 'changed', 1 FROM events WHERE event_type = 'view')) WHERE r = 1""")
def upsert_by_key(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    new = rows.filter("event_type = 'view'").withColumn("event_type", F.lit("changed"))
    return incremental.upsert(rows.filter("event_id % 2 = 0 or event_type <> 'view'"), new, "event_id")
