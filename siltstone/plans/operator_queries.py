"""Queries: operators of the corpus that the other modules don't show, on tables shaped as they expect them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.catalog import query, table
from siltstone.functions import match, text
from siltstone.operators import chunkplan, claims, digest, entities, insights, quality, segments, summaries, transcripts, units
from siltstone.sources import audio, feeds
from siltstone.streaming import incremental

SPACE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def docs(spark, d):
    return table(spark, d, "documents").withColumn("text", text.text_or_blank("text"))


# -- settings and values ------------------------------------------------------------

SETTINGS = "CASE o_orderkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN '-3' WHEN 2 THEN '0' WHEN 3 THEN 'Yes' WHEN 4 THEN '12.75' WHEN 5 THEN '-40' WHEN 6 THEN '-35DB' WHEN 7 THEN 'on' END"


@query(f"""
WITH s AS (SELECT o_orderkey, {SETTINGS} AS s FROM orders), n AS (SELECT *, try_cast(trim(s) AS DOUBLE) AS x FROM s)
SELECT o_orderkey, CASE WHEN x > 0 THEN x ELSE 7.0 END AS positive, CASE WHEN x >= 0 THEN x ELSE 7.0 END AS not_negative, x AS optional, coalesce(lower(trim(s)) IN ('1', 'true', 'yes', 'on'), false) AS flag,
  CASE WHEN lower(trim(s)) LIKE '%db' THEN trim(s) ELSE trim(s) || 'dB' END AS level, CAST(CASE WHEN floor(x) > 0 THEN floor(x) ELSE 2 END AS INTEGER) AS "limit", CASE WHEN trim(s) <> '' THEN s END AS present,
  coalesce(CASE WHEN trim(s) <> '' THEN s END, 'default') AS first
FROM n""")
def settings(spark, d):
    """Environment settings as text: numbers, flags, decibels, limits, missing values."""
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(SETTINGS).alias("s"))
    return rows.select(
        "o_orderkey", text.positive_number("s", 7).alias("positive"), text.positive_number("s", 7, allow_zero=True).alias("not_negative"), text.optional_number("s").alias("optional"),
        text.boolean_flag("s").alias("flag"), text.decibels("s").alias("level"), text.whole_limit("s", 2).alias("limit"), text.blank_to_null("s").alias("present"), text.first_non_blank("s", F.lit("default")).alias("first"),
    )


@query("""
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS published FROM events""")
def feed_dates(spark, d):
    """Dates as feeds write them, RFC 2822 or ISO 8601, as ISO text."""
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    written = F.when(F.col("event_id") % 2 == 0, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, d, "events").select("event_id", text.iso_text(text.parse_feed_date(written)).alias("published"))


# -- text ---------------------------------------------------------------------------


@query("""
SELECT doc_id, replace(replace(replace(coalesce(text, ''), 'th', 'TH'), 'the', 'x'), 'an', 'en') AS text FROM documents""")
def fold_variants(spark, d):
    """Literal replacements, one after another."""
    return docs(spark, d).select("doc_id", text.fold_replacements("text", [("th", "TH"), ("the", "x"), ("an", "en")]).alias("text"))


@query(r"""
WITH a AS (SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), 'that', 'which'), 'th', 'd'), 'é', 'e'), 'ü', 'u') AS t FROM documents)
SELECT doc_id, t AS text FROM a""")
def phrase_table(spark, d):
    """Longest phrase first; those of one character in one pass."""
    return docs(spark, d).select("doc_id", text.replace_phrases("text", {"é": "e", "th": "d", "ü": "u", "that": "which", "x": "x"}).alias("text"))


@query(rf"""
WITH a AS (SELECT doc_id, translate(coalesce(text, ''), ',;:', '，；：') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{SPACE}*\?', '？', 'g'), '{SPACE}*!', '！', 'g') AS t FROM a)
SELECT doc_id, regexp_replace(regexp_replace(t, '{SPACE}+([，。！？；：])', '\1', 'g'), '([，。！？；：]){SPACE}+', '\1', 'g') AS text FROM b""")
def full_width(spark, d):
    return docs(spark, d).select("doc_id", text.full_width_marks("text").alias("text"))


@query(rf"""
WITH a AS (SELECT doc_id, regexp_replace(trim(regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g'), ' '), '[，；：]+$', '') AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '[。！？.]$') THEN t ELSE t || '。' END AS text FROM a""")
def sentences(spark, d):
    return docs(spark, d).select("doc_id", text.ensure_sentence("text", "。！？.").alias("text"))


@query(r"""
WITH a AS (SELECT doc_id, replace(coalesce(text, ''), ' ', '，') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '[，；、]\s*$', '') AS t FROM a),
c AS (SELECT doc_id, t, substr(t, 1, 78) AS h FROM b),
e AS (SELECT *, CASE WHEN strpos(h, '，') > 0 THEN 78 - strpos(reverse(h), '，') ELSE -1 END AS cut FROM c)
SELECT doc_id, CASE WHEN length(t) <= 78 THEN t ELSE regexp_replace(CASE WHEN cut > 30 THEN substr(h, 1, cut) ELSE h END, '[，；、。]+$', '') || '…' END AS text FROM e""")
def clause_cuts(spark, d):
    """Texts cut at a clause mark."""
    return docs(spark, d).select("doc_id", text.shorten_at_clause(F.replace("text", F.lit(" "), F.lit("，")), 78).alias("text"))


@query(rf"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
SELECT doc_id, array_to_string(list_filter(p, lambda x: NOT starts_with(x, 'The')), chr(10)) AS kept,
  substr(trim(regexp_replace(regexp_replace(trim(regexp_replace(p[1], '{SPACE}+', ' ', 'g'), ' '), '^[-•\s]+', ''), '{SPACE}+', ' ', 'g'), ' '), 1, 120) AS sentence,
  lower(regexp_replace(regexp_replace(p[1], '{SPACE}', '', 'g'), '[，。！？；：、,.!?;:「」『』()（）【】]', '', 'g')) AS bullet FROM l""")
def line_forms(spark, d):
    """Lines left out by prefix; the first line as a sentence and as a comparable bullet."""
    first = F.get(F.split("text", "\n"), F.lit(0))
    return docs(spark, d).select("doc_id", text.without_lines("text", "The").alias("kept"), text.normalize_sentence(first).alias("sentence"), text.normalize_bullet(first).alias("bullet"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([。！？!?；;])\s*', '\1' || chr(10), 'g'), '(\d{1,2}:\d{2})', chr(10) || '\1', 'g') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(list_transform(string_split(t, chr(10)), lambda u: trim(u, ' ' || chr(9) || chr(13))), lambda u: u <> '')) AS INTEGER) AS n FROM a""")
def speech_units(spark, d):
    return docs(spark, d).select("doc_id", F.size(text.split_units("text")).alias("n"))


@query(r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, t, strpos(t, 'license') AS p FROM a),
c AS (SELECT doc_id, t, p, substr(t, p) AS rest FROM b), e AS (SELECT *, list_min(list_filter([strpos(rest, 'the ') - 1, strpos(rest, 'and ') - 1], lambda i: i > 80)) AS n FROM c),
f AS (SELECT doc_id, CASE WHEN p > 0 AND p <= 1600 AND n IS NOT NULL THEN substr(rest, n + 1) ELSE t END AS t FROM e),
u AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([。！？!?；;])\s*', '\1' || chr(10), 'g'), '(\d{1,2}:\d{2})', chr(10) || '\1', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND (NOT contains(x, 'license') OR length(x) > 500)) AS u FROM f)
SELECT doc_id, trim(regexp_replace(array_to_string(u, ' '), '[\s\x0B\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS text FROM u""")
def promotions_stripped(spark, d):
    """Promotions cut: to an anchor well after the first, then unit by unit."""
    return docs(spark, d).select("doc_id", text.strip_promotions("text", ["license"], [], ["the ", "and "], []).alias("text"))


@query(r"""
WITH k AS (SELECT conv_id, turn, regexp_replace(lower(coalesce(text, '')), '[\s!-/:-@\[-`{-~]+', '', 'g') AS k FROM conversations),
g AS (SELECT *, CASE WHEN length(k) <= 6 THEN [k] ELSE list_distinct(list_transform(range(1, length(k) - 4), lambda i: substr(k, i, 6))) END AS g FROM k),
p AS (SELECT a.conv_id, a.turn, a.k AS ka, b.k AS kb, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS t FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn - 2)
SELECT conv_id, turn, contains(ka, kb) OR contains(kb, ka) OR i / (t - i) >= 0.1 AS alike FROM p""")
def similar_turns(spark, d):
    """Whether a message is like the speaker's last one."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.quote_key(text.text_or_blank("text")).alias("k"))
    last = rows.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("k").alias("kb"))
    return rows.join(last, ["conv_id", "turn"]).select("conv_id", "turn", text.similar_quotes(F.col("k"), F.col("kb"), 0.1).alias("alike"))


@query("""
SELECT doc_id, contains(lower(coalesce(text, '')), lower(source)) OR contains(lower(coalesce(text, '')), coalesce(lang, '')) AND coalesce(lang, '') <> '' AS named FROM documents""")
def names_mentioned(spark, d):
    return docs(spark, d).select("doc_id", match.mentioned(F.col("text"), F.array("source", F.coalesce("lang", F.lit("")))).alias("named"))


@query(r"""
SELECT doc_id, regexp_matches(t, '^\s*EP\d+\s*\|\s*$') OR length(regexp_replace(t, '[\s|。！？!?]', '', 'g')) <= 6 AS weak FROM (SELECT doc_id, split_part(coalesce(text, ''), ' ', 1) AS t FROM documents)""")
def weak_titles(spark, d):
    return docs(spark, d).select("doc_id", units.weak_title(F.split_part("text", F.lit(" "), F.lit(1))).alias("weak"))


@query(r"""
SELECT doc_id, CASE WHEN contains(t, 'license') THEN 'terms' WHEN regexp_matches(t, '[0-9]{5}') THEN 'numbers' WHEN contains(t, 'copyright') AND contains(t, 'all') THEN 'rights' ELSE 'none' END AS wording FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def editorial_wording(spark, d):
    """The wording of the first rule that fits, with a further pattern where a rule has one."""
    from siltstone.functions.scoring import editorial

    rules = [("license", None, "terms"), ("[0-9]{5}", None, "numbers"), ("copyright", "all", "rights")]
    return docs(spark, d).select("doc_id", editorial("text", rules, F.lit("none")).alias("wording"))


# -- feeds and audio ----------------------------------------------------------------


@query("""
SELECT 's-' || strftime(ts, '%Y-%m-%d') || '-g' || event_id AS id, event_type AS title, 'http://a/' || event_id || '.mp3' AS "audioUrl" FROM events""")
def feed_items(spark, d):
    """Items of RSS documents, one for each event."""
    date = F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    xml = F.concat(F.lit("<rss><channel><item><guid isPermaLink='false'>g"), "event_id", F.lit("</guid><title>"), "event_type", F.lit("</title><pubDate>"), date, F.lit("</pubDate><enclosure url='http://a/"), "event_id", F.lit(".mp3'/></item></channel></rss>"))
    rows = table(spark, d, "events").select(F.lit("s").alias("sourceId"), F.lit("2024-01-01T00:00:00.000Z").alias("fetchedAt"), xml.alias("xml"))
    return feeds.rss_items(rows).select("id", "title", "audioUrl")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS seconds, CASE WHEN o_orderstatus <> 'P' THEN 'mp3' END AS codec,
  CASE WHEN o_orderstatus = 'P' THEN 'probe failed' ELSE '' END AS warning FROM orders""")
def probe_metadata(spark, d):
    """Duration and codec from the JSON that a media probe prints."""
    probe = F.format_string('{"format":{"duration":"%s"},"streams":[{"codec_type":"video"},{"codec_type":"audio","codec_name":"mp3","sample_rate":"44100","channels":2}]}', F.col("o_totalprice").cast("string"))
    rows = table(spark, d, "orders").withColumn("probe", F.when(F.col("o_orderstatus") == "P", "no json").otherwise(probe))
    return audio.probe_metadata(rows).select("o_orderkey", F.col("metadata.durationSeconds").alias("seconds"), F.col("metadata.codec").alias("codec"), F.array_join("metadata.warnings", ",").alias("warning"))


class Echo:
    """A provider that needs no network: the name of the file backwards; part files fail."""

    def transcribe(self, file, options):
        if "PART" in file:
            raise OSError("no such part")
        return {"text": file[::-1]}


@query("""
SELECT p_partkey, CASE WHEN NOT contains(f, 'PART') THEN reverse(f) END AS text, CASE WHEN contains(f, 'PART') THEN 'no such part' END AS error FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'PART' ELSE p_brand END AS f FROM part)""")
def transcribe_chunks(spark, d):
    """Chunks through a provider; those that fail are reported."""
    files = F.when(F.col("p_partkey") % 5 == 0, "PART").otherwise(F.col("p_brand"))
    return audio.transcribe_all(table(spark, d, "part").select("p_partkey", files.alias("file")), Echo()).select("p_partkey", "text", "error")


@query("""
SELECT c_custkey, CAST(i AS INTEGER) AS index, 'f' || i AS file, CASE WHEN c_custkey % 3 = 1 THEN i * 10.0::DOUBLE END AS start FROM customer, unnest(range(0, 2)) AS t(i)""")
def planned_files(spark, d):
    """Planned chunks beside the files that were made; where the numbers differ the plan's times go."""
    planned = F.transform(F.sequence(F.lit(0), F.when(F.col("c_custkey") % 3 == 1, 1).otherwise(2)), lambda i: F.struct((i * 10.0).alias("start"), (i * 10.0 + 10).alias("end")))
    rows = table(spark, d, "customer").select("c_custkey", planned.alias("planned"), F.array(F.lit("f0"), F.lit("f1")).alias("files"))
    return audio.zip_chunks(rows, "planned", "files").select("c_custkey", F.explode("zipped").alias("z")).select("c_custkey", "z.index", "z.file", "z.start")


@query("""
SELECT o_custkey, list_sort(list(DISTINCT m)) AS middles FROM (SELECT o_custkey, floor((o_totalprice + o_orderkey) / 2 * 1000 + 0.5) / 1000 AS m FROM orders WHERE (o_totalprice + o_orderkey) / 2 > 0.001 AND (o_totalprice + o_orderkey) / 2 < 100000 - 0.001) GROUP BY 1""")
def silence_middles(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").cast("double").alias("start"), F.col("o_totalprice").alias("end"))).alias("s"))
    return rows.select("o_custkey", chunkplan.midpoints(F.col("s"), F.lit(100000.0)).alias("middles")).filter(F.size("middles") > 0)


# -- transcripts and segments ---------------------------------------------------------


@query("""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'legacy' END AS provider, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE reverse(coalesce(text, '')) END AS text, 1 AS n_segments FROM documents""")
def transcript_adapters(spark, d):
    """Raw transcripts first, legacy ones in their shape where there is no raw one; each with a segment."""
    old = docs(spark, d).select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("rawItemId"), F.col("source").alias("sourceId"), F.lit("m").alias("model"), F.col("lang").alias("language"),
        F.lit("2024").alias("transcribedAt"), F.lit("u").alias("audioUrl"), F.reverse("text").alias("text"),
    )
    old = transcripts.from_legacy(old)
    raw = old.filter("id % 2 = 0").withColumn("provider", F.lit("raw")).join(docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("t")), "id").withColumn("text", F.col("t")).select(old.columns)
    rows = transcripts.with_segments(transcripts.priority_union([raw, old], "id"))
    return rows.select("id", "provider", "text", F.size("segments").alias("n_segments"))


@query(r"""
SELECT CAST(count(*) AS BIGINT) AS corrections FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS w FROM documents) WHERE w IN ('that', 'this', 'with')""")
def corrections_total(spark, d):
    """Corrections of all normalised transcripts together."""
    from siltstone import schemas

    rows = docs(spark, d).select(F.col("doc_id").alias("id"), "text", F.array().cast(f"array<{schemas.SEGMENT}>").alias("segments"))
    glossary = [{"name": "the", "aliases": ["that", "this"], "kind": "article"}, {"name": "and", "aliases": ["with"], "kind": "link"}]
    return spark.createDataFrame([(transcripts.total_corrections(transcripts.normalize_transcripts(rows, glossary)),)], "corrections long")


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS at FROM documents""")
def unchanged_stamps(spark, d):
    """The old time stamp where the content is as it was."""
    rows = docs(spark, d).select("doc_id", "text", F.lit("new").alias("at"))
    old = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), F.lit("old").alias("at"))
    return transcripts.keep_unchanged(rows, old, "doc_id", ["text"], "at").select("doc_id", "at")


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def whole_fallback(spark, d):
    """A second table where the first has no row at all."""
    rows = docs(spark, d).select("doc_id", "lang")
    return transcripts.table_fallback(rows.filter("doc_id < 0"), rows.filter("lang is not null"))


@query("""
SELECT doc_id, CASE WHEN len(a) >= 2 OR m THEN 'high' WHEN len(a) > 0 OR len(t) > 0 THEN 'medium' ELSE 'low' END AS importance FROM (
  SELECT doc_id, list_filter(['that', 'license'], lambda k: contains(lower(coalesce(text, '')), k)) AS a, list_filter(['und', 'les'], lambda k: contains(lower(coalesce(text, '')), k)) AS t, contains(lower(coalesce(text, '')), 'copyright') AS m FROM documents)""")
def segment_importance(spark, d):
    named = lambda terms: match.matched_terms("text", terms, "substring_ci")
    return docs(spark, d).select("doc_id", segments.importance(named(["und", "les"]), named(["that", "license"]), match.any_term("text", ["copyright"], "substring_ci")).alias("importance"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 25")
def bounded_run(spark, d):
    """The next items of a run with a limit (the limit is the feature)."""
    left = incremental.not_done(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")
    return incremental.next_items(left.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("publishedAt")), 25).select("id")


# -- claims, insights, digest -----------------------------------------------------------

CLAIMS = """SELECT CAST(l_orderkey AS VARCHAR) AS "rawItemId", CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'claim ' || l_partkey AS claim,
  CASE l_linenumber % 4 WHEN 0 THEN 'risk' WHEN 1 THEN 'macro' WHEN 2 THEN 'fact' ELSE 'opinion' END AS kind, CASE l_returnflag WHEN 'R' THEN 'bearish' WHEN 'A' THEN 'bullish' ELSE 'mixed' END AS mood,
  0.6 + l_discount * 3 AS confidence, l_quantity AS said_at FROM lineitem"""


def claim_rows(spark, d):
    rows = table(spark, d, "lineitem")
    item = F.col("l_orderkey").cast("string")
    kind = F.when(F.col("l_linenumber") % 4 == 0, "risk").when(F.col("l_linenumber") % 4 == 1, "macro").when(F.col("l_linenumber") % 4 == 2, "fact").otherwise("opinion")
    mood = F.when(F.col("l_returnflag") == "R", "bearish").when(F.col("l_returnflag") == "A", "bullish").otherwise("mixed")
    said = F.concat(F.lit("claim "), F.col("l_partkey").cast("string"))
    return rows.select(
        item.alias("rawItemId"), F.concat_ws("-", item, *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), said.alias("claim"), kind.alias("claimType"), mood.alias("sentiment"),
        (F.lit(0.6) + F.col("l_discount") * 3).alias("confidence"), F.array(F.col("l_shipmode")).alias("entities") if "l_shipmode" in rows.columns else F.array(F.lit("e")).alias("entities"),
        F.array(F.col("l_returnflag")).alias("tickers"), F.struct(F.col("l_quantity").alias("start"), (F.col("l_quantity") + 1).alias("end"), said.alias("quote")).alias("evidence"),
    )


@query(f"""
WITH c AS ({CLAIMS}), p AS (SELECT *, 1000 * (CASE kind WHEN 'risk' THEN 8 WHEN 'macro' THEN 6 WHEN 'fact' THEN 3 ELSE 2 END + CASE mood WHEN 'bullish' THEN 1 ELSE 2 END) + CAST(round(confidence * 10000) AS BIGINT) AS points FROM c WHERE confidence >= 0.72),
r AS (SELECT *, row_number() OVER (PARTITION BY "rawItemId" ORDER BY points DESC, confidence DESC, id) AS r FROM p)
SELECT "rawItemId", array_to_string(list(id ORDER BY r), ',') AS ids FROM r WHERE r <= 4 GROUP BY 1""")
def evidence_claims(spark, d):
    """The four best claims of an item as the digest shows them."""
    return digest.evidence(claim_rows(spark, d)).select("rawItemId", F.array_join("evidenceClaims.id", ",").alias("ids"))


@query(f"""
WITH c AS ({CLAIMS}), p AS (SELECT *, 1000 * (CASE kind WHEN 'risk' THEN 8 WHEN 'macro' THEN 6 WHEN 'fact' THEN 3 ELSE 2 END + CASE mood WHEN 'bullish' THEN 1 ELSE 2 END) + CAST(round(confidence * 10000) AS BIGINT) AS points FROM c WHERE confidence >= 0.72),
r AS (SELECT *, row_number() OVER (PARTITION BY "rawItemId" ORDER BY points DESC, confidence DESC, id) AS r FROM p)
SELECT "rawItemId" AS id, CAST(r - 1 AS INTEGER) AS n, claim, kind AS "claimType", CAST(round(round(confidence, 2) * 100) AS INTEGER) AS percent, CAST(floor(said_at / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(said_at) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS "at" FROM r WHERE r <= 4""")
def evidence_list(spark, d):
    """Claims of one detail page: wording, percent, clock."""
    rows = digest.evidence(claim_rows(spark, d)).withColumnRenamed("rawItemId", "id")
    return digest.claim_list(rows).select("id", "n", "claim", "claimType", "percent", "at")


@query(f"""
WITH c AS ({CLAIMS}), k AS (SELECT "rawItemId", CASE kind WHEN 'risk' THEN 4 WHEN 'macro' THEN 2 ELSE 0 END + CASE WHEN mood IN ('bearish', 'mixed') THEN 2 ELSE 0 END AS points, kind, mood, confidence FROM c)
SELECT "rawItemId", CAST(max(points) AS INTEGER) AS points, CASE WHEN bool_or(kind = 'risk' OR mood = 'bearish' OR (mood = 'mixed' AND confidence >= 0.85)) THEN 'high' WHEN bool_or(kind = 'macro') THEN 'medium' ELSE 'low' END AS level FROM k GROUP BY 1""")
def risk_levels(spark, d):
    rows = claim_rows(spark, d).withColumn("points", insights.risk_points(F.col("claimType"), F.col("sentiment")))
    high = (F.col("claimType") == "risk") | (F.col("sentiment") == "bearish") | ((F.col("sentiment") == "mixed") & (F.col("confidence") >= 0.85))
    level = insights.risk_level(F.bool_or(high), F.bool_or(F.col("claimType") == "macro"), F.lit(False))
    return rows.groupBy("rawItemId").agg(F.max("points").alias("points"), level.alias("level"))


@query(f"""
WITH c AS ({CLAIMS}), n AS (SELECT "rawItemId", count(*) FILTER (mood = 'bullish') AS up, count(*) FILTER (mood = 'bearish') AS down, count(*) FILTER (mood = 'mixed') AS torn FROM c GROUP BY 1)
SELECT "rawItemId", CASE WHEN torn > 0 OR (up > 0 AND down > 0) THEN 'mixed' WHEN down > up THEN 'bearish' WHEN up > down AND up > 0 THEN 'bullish' ELSE 'insufficient' END AS sentiment FROM n""")
def item_sentiment(spark, d):
    return summaries.sentiment_of(claim_rows(spark, d))


@query(f"""
WITH c AS ({CLAIMS}) SELECT id, kind || '|' || mood AS keys, CASE kind WHEN 'risk' THEN '風險' WHEN 'macro' THEN '總經' WHEN 'fact' THEN '事實' ELSE '觀點' END AS "claimTypeLabel",
  CASE mood WHEN 'bullish' THEN '偏多' WHEN 'bearish' THEN '偏空' ELSE '混合' END AS "sentimentLabel", CASE mood WHEN 'bullish' THEN 'neutral' WHEN 'bearish' THEN 'violet' ELSE 'amber' END AS "sentimentTone" FROM c""")
def claim_labels(spark, d):
    rows = digest.display(claim_rows(spark, d).select("id", "claimType", "sentiment"))
    return rows.select("id", F.concat_ws("|", "claimType", "sentiment").alias("keys"), "claimTypeLabel", "sentimentLabel", "sentimentTone")


@query(f"""
WITH c AS ({CLAIMS}) SELECT 'claims' AS "table", id, 'confidence-range' AS "check", CAST(NULL AS VARCHAR) AS ref FROM c WHERE confidence > 0.8
UNION ALL SELECT 'claims', id, 'duplicate-key', NULL FROM c GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'claims', id, 'unknown-reference', 'seg-' || "rawItemId" FROM c WHERE CAST("rawItemId" AS BIGINT) % 7 = 0
UNION ALL SELECT 'claims', id, 'quote-not-in-segment', NULL FROM c WHERE CAST("rawItemId" AS BIGINT) % 7 <> 0 AND claim NOT LIKE '%1%'""")
def claim_constraints(spark, d):
    """Failures of claims against their segments."""
    rows = claim_rows(spark, d).withColumn("segmentId", F.concat(F.lit("seg-"), "rawItemId")).withColumn("confidence", F.when(F.col("confidence") > 0.8, 1.5).otherwise(F.col("confidence")))
    rows = rows.withColumn("evidence", F.struct(F.when(F.col("claim").contains("1"), "1").otherwise("absent").alias("quote")))
    seg = table(spark, d, "orders").filter("o_orderkey % 7 <> 0").select(F.concat(F.lit("seg-"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("1").alias("text"))
    found = quality.check_claims(rows, seg)
    return found.select("table", "id", "check", F.when(F.col("check") == "unknown-reference", F.col("detail")).alias("ref"))


@query("""
SELECT s_suppkey AS id, CAST(i AS INTEGER) AS n, 'insight ' || i AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'low' END AS "riskLevel", CAST(i + 1 AS INTEGER) AS n_claims FROM supplier, unnest(range(0, 2)) AS t(i)""")
def insight_lists(spark, d):
    """Insights of one detail page."""
    level = F.when(F.col("s_suppkey") % 2 == 0, "high").otherwise("low")
    one = lambda i: F.struct(F.lit(f"insight {i}").alias("title"), level.alias("riskLevel"), F.array_repeat(F.lit("c"), i + 1).alias("claimIds"))
    return digest.insight_list(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(one(0), one(1)).alias("watchlistInsights")))


@query("""
WITH i AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS l, 'title ' || o_orderkey AS t, o_orderkey % 3 AS n FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l DESC, n DESC, t) AS r FROM i)
SELECT o_custkey AS "rawItemId", array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY r), ',') AS ids FROM r WHERE r <= 3 GROUP BY 1""")
def top_insights(spark, d):
    level = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("rawItemId"), F.col("o_orderkey").cast("string").alias("id"), F.lit("w").alias("watchlistKey"), F.concat(F.lit("title "), F.col("o_orderkey").cast("string")).alias("title"), F.lit("s").alias("summary"),
        F.array(F.lit("T")).alias("relatedTickers"), F.array_repeat(F.lit("c"), (F.col("o_orderkey") % 3).cast("int")).alias("claimIds"), level.alias("riskLevel"),
    )
    return digest.top_insights(rows).select("rawItemId", F.array_join("watchlistInsights.id", ",").alias("ids"))


@query("""
WITH k AS (SELECT c_custkey, c_name AS key FROM customer UNION SELECT c_custkey, c_mktsegment FROM customer UNION SELECT c_custkey, CAST(c_custkey AS VARCHAR) FROM customer)
SELECT c_custkey AS "rawItemId", key, CAST(c_custkey AS VARCHAR) AS entity FROM k""")
def entity_lookup(spark, d):
    """Entities of an item by id, name and ticker."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("rawItemId"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("canonicalName"), F.col("c_mktsegment").alias("ticker"), F.lit("company").alias("type"))
    return summaries.entity_keys(rows).select("rawItemId", "key", F.col("entity.id").alias("entity"))


@query("""
SELECT n_nationkey AS id, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'Whisper 逐字稿' ELSE 'Metadata 摘要' END AS label FROM nation WHERE n_nationkey = 3""")
def detail_page(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, "transcript").otherwise("metadata-only").alias("sourceTextQuality"))
    return digest.by_id(digest.display(rows), 3).select("id", "title", F.col("sourceTextQualityLabel").alias("label"))


@query("""
SELECT o_orderkey AS id, o_clerk_ AS title, CASE WHEN length(e) <= 180 THEN e END AS excerpt, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS INTEGER) AS n_claims FROM (SELECT o_orderkey, o_orderpriority AS o_clerk_, o_orderpriority || ' ' || o_orderstatus AS e FROM orders)""")
def digest_cards(spark, d):
    """Cards of the list: cut excerpts, chips or assets, counts that are not zero."""
    none = F.array().cast("array<struct<label: string>>")
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("excerpt"), F.array(F.lit("t")).alias("topics"), F.array(F.lit("a")).alias("mentionedAssets"),
        none.alias("entityChips"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("evidenceClaims"), F.array().cast("array<string>").alias("watchlistInsights"),
    )
    return digest.cards(rows).select("id", "title", "excerpt", "n_claims")


@query("""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, 'structure' AS "check", CAST(len(p) AS VARCHAR) AS detail FROM l WHERE len(p) < 3
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'transcript-like-keypoint', 'length' FROM l WHERE len(list_filter(p, lambda x: length(x) > 220)) > 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'sponsor-leakage', '' FROM l WHERE len(list_filter(p, lambda x: regexp_matches(x, '(?i)https?://'))) > 0""")
def content_gate(spark, d):
    """The content gate on documents whose lines are the key points; the checks that this shape can fail."""
    points = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    body = F.concat(F.lit("TL;DR：x\n重點摘要：\n內容品質：x\n"), F.array_join(F.transform(points, lambda x: F.concat(F.lit("- "), x)), "\n"))
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), points.alias("keyPoints"), body.alias("body"), F.lit("").alias("excerpt"), F.array(F.lit("不構成投資建議")).alias("risks"))
    found = quality.check_summaries(rows).drop("table")
    return found.filter("check = 'sponsor-leakage' or (check = 'structure' and detail rlike '^[0-9]+$') or (check = 'transcript-like-keypoint' and detail = 'length')")


@query("""
WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT 'entities' AS "table", user_id || '|' || event_type || '||' || 't' AS id, 'duplicate-key' AS "check", CAST(n AS VARCHAR) AS detail FROM e WHERE n > 1
UNION ALL SELECT 'entities', CAST(event_id AS VARCHAR), 'no-evidence', event_type FROM events WHERE event_type = 'error'""")
def entity_constraints(spark, d):
    proof = F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array(F.lit("s")))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("rawItemId"), F.col("event_type").alias("canonicalName"), F.lit(None).cast("string").alias("ticker"), F.lit("t").alias("type"), proof.alias("evidenceSegmentIds"))
    return quality.check_entities(rows)


@query()
def metadata_summaries(spark, d):
    """A summary of every document from its first line and text alone."""
    return summaries.metadata_summaries(_raw(spark, d), _sources(spark), F.lit("now")).select("id", "excerpt", "body", F.size("keyPoints").alias("n"), "sourceTextQuality")


@query("""
WITH l AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, source AS "sourceName", CASE WHEN regexp_matches(t, '\\S') THEN 'transcript' ELSE 'metadata-only' END AS "sourceTextQuality", 'insufficient' AS sentiment, CAST(3 AS INTEGER) AS n FROM l""")
def ungrounded_summaries(spark, d):
    """Summaries of items without a single claim."""
    from siltstone import schemas

    none = lambda schema: spark.createDataFrame([], schema)
    rows = summaries.grounded_summaries(_raw(spark, d), none(schemas.CLAIM), none(schemas.ENTITY + ", rawItemId string"), _sources(spark), F.lit("now"))
    return rows.select("id", "sourceName", "sourceTextQuality", "sentiment", F.size("keyPoints").alias("n"))


def _raw(spark, d):
    return docs(spark, d).select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("sourceId"), F.lit("x").alias("externalId"), F.lit("podcast").alias("medium"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.lit("").alias("description"),
        F.lit("2024").alias("publishedAt"), F.lit("u").alias("url"), F.col("text").alias("transcript"),
    )


def _sources(spark):
    return spark.createDataFrame([], "id string, name string, slug string")


@query()
def claims_of_segments(spark, d):
    """Candidate quotes of every message with their signals; a rule of code, held by unit tests."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.text_or_blank("text").alias("text"), F.array(F.lit("the")).alias("names"))
    return claims.candidates(rows, patterns=["that", "with"]).select("conv_id", "turn", "index", "quote")


@query("""
SELECT conv_id, turn, name, type FROM conversations, (VALUES ('that', 'word', 'that'), ('MIT', 'ticker', 'MIT')) AS r(name, type, alias) WHERE regexp_matches(coalesce(text, ''), '(^|[^A-Za-z0-9])' || alias || '([^A-Za-z0-9]|$)')""")
def segment_mentions(spark, d):
    """Entities of each message by rule, and tokens in capitals that no rule stands for."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("rawItemId"), F.col("turn").alias("id"), F.lit("").alias("title"), text.text_or_blank("text").alias("text"), F.array().cast("array<string>").alias("topics"), F.array().cast("array<string>").alias("mentionedAssets"))
    rules = [{"name": "that", "aliases": [], "type": "word", "ticker": None, "exchange": None}]
    return entities.segment_mentions(rows, rules, ["MIT"], []).select(F.col("rawItemId").alias("conv_id"), F.col("segmentId").alias("turn"), "name", "type")
