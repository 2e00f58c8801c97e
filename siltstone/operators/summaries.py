"""Summaries grounded in claims: selection, key points, topics, assets, risks, sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import rules as R
from siltstone.functions.match import matched_terms, matched_topics
from siltstone.functions.scoring import editorial, lookup, vote
from siltstone.functions.text import compact_whitespace, ensure_sentence, fingerprint, fold_replacements, normalize_text, shorten_at_clause, split_units, strip_promotions
from siltstone.operators import units


def resolve_transcripts(raw: DataFrame, normalized: DataFrame, legacy: DataFrame) -> DataFrame:
    """raw items with ``transcript``: the normalised text if there is such a row, else the legacy one; blank ones go."""
    n = normalized.select("id", F.struct("text").alias("n"))
    old = legacy.select("id", F.struct("text").alias("l"))
    rows = raw.join(n, "id", "left").join(old, "id", "left").withColumn("transcript", F.coalesce("n", "l")["text"]).drop("n", "l")
    return rows.filter(F.regexp_replace("transcript", r"(?U)\s", "") != "")


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Name and slug of the source; its id where it is unknown. Sources are a list of settings: they go to the rows,
    which would else be dealt out, texts and all, by a few sources."""
    s = sources.select(F.col("id").alias("sourceId"), F.col("name").alias("sourceName"), F.col("slug").alias("sourceSlug"))
    rows = rows.join(F.broadcast(s), "sourceId", "left")
    return rows.withColumns({c: F.coalesce(c, "sourceId") for c in ("sourceName", "sourceSlug")})


def text_quality(transcript: Column, notes: Column, least: int = 240) -> Column:
    return F.when(F.trim(F.coalesce(transcript, F.lit(""))) != "", "transcript").when(F.length(notes) > least, "show-notes").otherwise("metadata-only")


def keep_first_by(rows: DataFrame, keys: list[str], mark: str, order: list) -> DataFrame:
    """Of rows with the same mark in a group, the first in order."""
    w = Window.partitionBy(*keys, mark).orderBy(*order)
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def without_promotions(c) -> Column:
    return strip_promotions(c, R.PROMOTIONS, R.BOILERPLATE, R.ANCHORS, R.CUES)


def clean_claim(c) -> Column:
    """The wording of a claim without promotions, openings and fillers; some variants in their usual form."""
    x = without_promotions(c)
    for opening in R.CLAIM_OPENINGS:
        x = F.regexp_replace(x, opening, "")
    return compact_whitespace(fold_replacements(F.regexp_replace(x, R.CLAIM_FILLERS, ""), R.CLAIM_VARIANTS))


def useful_claims(claims: DataFrame, top: int = 8, phrases: dict[str, str] | None = None) -> DataFrame:
    """Confident claims of enough length, best first, one per fingerprint, at most ``top`` an item; adds ``rank``,
    ``clean`` and ``wording`` (cleaned again, as it is shown)."""
    said = normalize_text(F.coalesce(F.nullif("claim", F.lit("")), F.col("evidence.quote")), phrases or {})
    rows = claims.filter(F.col("confidence") >= R.MIN_CONFIDENCE).withColumn("said", said).withColumn("clean", clean_claim("said"))
    rows = rows.filter((F.length("clean") >= R.MIN_CLAIM_CHARS) & (F.length(without_promotions("clean")) >= R.MIN_CLAIM_CHARS))
    rows = rows.withColumn("wording", clean_claim("clean"))
    rows = rows.withColumn("points", F.round(F.col("confidence") * 1000).cast("long") + 100 * F.coalesce(lookup("claimType", R.CLAIM_PRIORITY), F.lit(0)))
    order = [F.desc("points"), "id"]
    rows = keep_first_by(rows.withColumn("mark", fingerprint("wording")), ["rawItemId"], "mark", order)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("rawItemId").orderBy(*order)))
    return rows.filter(F.col("rank") <= top).drop("mark", "points", "said")


def first_by_fingerprint(lines: Column) -> Column:
    """An array without the elements whose fingerprint an earlier one has."""
    marked = F.transform(lines, lambda x: F.struct(x.alias("t"), fingerprint(x).alias("m")))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: k.m == x.m), kept).otherwise(F.concat(kept, F.array(x)))
    return F.transform(F.aggregate(marked, F.slice(marked, 1, 0), step), lambda x: x.t)


def entity_keys(entities: DataFrame) -> DataFrame:
    """(rawItemId, key, entity): by id, name and ticker; of several entities the last in order has the key."""
    rows = entities.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array("id", "canonicalName", "ticker")))))
    return rows.groupBy("rawItemId", "key").agg(F.max_by(F.struct("id", "canonicalName", "ticker", "type"), "id").alias("entity"))


def assets_of(claims: DataFrame, entities: DataFrame, cap: int = 8) -> DataFrame:
    """Assets that ranked claims name: tickers, then entities of asset types; first seen first."""
    tickers = claims.select("rawItemId", "rank", F.lit(0).alias("kind"), F.posexplode("tickers").alias("n", "label"))
    keys = claims.select("rawItemId", "rank", F.lit(1).alias("kind"), F.posexplode("entities").alias("n", "key"))
    named = keys.join(entity_keys(entities), ["rawItemId", "key"]).filter(F.col("entity.type").isin(R.ASSET_TYPES))
    named = named.select("rawItemId", "rank", "kind", "n", F.coalesce("entity.ticker", "entity.canonicalName").alias("label"))
    return first_seen(tickers.unionByName(named), ["rawItemId"], ["rank", "kind", "n"], "label", cap, "mentionedAssets")


def first_seen(rows: DataFrame, keys: list[str], order: list[str], value: str, cap: int, out: str) -> DataFrame:
    """Distinct values per group in the order they first appear, at most ``cap``."""
    firsts = rows.filter(F.trim(value) != "").groupBy(*keys, F.trim(value).alias("v")).agg(F.min(F.struct(*order)).alias("at"))
    lists = firsts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("l"))
    return lists.select(*keys, F.slice(F.transform("l", lambda x: x.v), 1, cap).alias(out))


def sentiment_of(claims: DataFrame) -> DataFrame:
    counts = claims.groupBy("rawItemId").agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in ("bullish", "neutral", "bearish", "mixed")])
    return counts.select("rawItemId", vote("bullish", "neutral", "bearish", "mixed").alias("sentiment"))


#: fixed values: what key points and risks begin with, by type
POINT_PREFIX = {"risk": "風險線索", "catalyst": "催化因素", "macro": "總經脈絡", "valuation": "估值觀察", "forecast": "後續觀察", "fact": "事實整理", "opinion": "觀點整理"}
RISK_PREFIX = {"risk": "需留意", "macro": "總經變數"}
#: fixed values: words and talk by which units of a text are scored
KEYWORDS = ["市場", "美股", "台股", "AI", "ETF", "利率", "通膨", "關稅", "比特幣", "半導體", "台積電", "輝達", "風險", "資金", "估值", "就業", "經濟"]
SMALL_TALK = "^[我你他]|覺得|開心|吃|喝|飯店|品酒|孩子"
ENDS = "。！？…"


def listed(head: str, c, k: int, tail: str) -> Column:
    return F.concat(F.lit(head), F.array_join(F.slice(c, 1, k), "、"), F.lit(tail))


def appended(points: Column, condition: Column, line: Column, most: int) -> Column:
    """``points`` with one more line where the condition holds and there are fewer than ``most``."""
    return F.when(condition & (F.size(points) < most), F.concat(points, F.array(line))).otherwise(points)


def bulleted(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda x: F.concat(F.lit("- "), x)), "\n")


def lines(*parts: Column | str) -> Column:
    """Lines of a body; null ones are left out, empty ones stay."""
    return F.array_join(F.array_compact(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])), "\n")


def metadata_summaries(raw: DataFrame, sources: DataFrame, now: Column, phrases: dict[str, str] | None = None) -> DataFrame:
    """One summary per raw item with ``transcript``, from its title and transcript or description alone."""
    zh = lambda c: normalize_text(c, phrases or {})
    spoken = F.coalesce(F.regexp_replace("transcript", r"(?U)\s", "") != "", F.lit(False))
    text = F.when(spoken, F.col("transcript")).otherwise(F.coalesce(F.nullif("description", F.lit("")), F.col("title")))
    rows = with_source(raw, sources).withColumn("spoken", spoken).withColumn("zh_title", zh(F.col("title"))).withColumn("zh_text", zh(text))
    rows = rows.withColumn("zh_notes", zh(F.coalesce(F.nullif("description", F.lit("")), F.col("title"))))
    rows = rows.withColumn("cleaned", without_promotions("zh_text"))
    whole = F.concat_ws(" ", "zh_title", "cleaned")
    rows = rows.withColumn("topics", matched_topics(whole, R.SUMMARY_TOPICS)).withColumn("mentionedAssets", matched_terms(whole, R.SUMMARY_ASSETS, "substring"))
    rows = rows.withColumn("u", units.best_units(whole, KEYWORDS, R.SUMMARY_TOPICS, SMALL_TALK, R.CUES, not_in=R.PROMOTIONS)).withColumn("n_units", F.size("u"))
    macro = F.array_contains("topics", "總經")
    found = F.transform("u", lambda x: F.coalesce(units.themes(x, R.EVIDENCE_THEMES), F.when(macro, F.lit(R.MACRO_THEME))))
    rows = rows.withColumn("found", F.coalesce(F.array_distinct(F.array_compact(found)), F.array().cast("array<string>")))
    subject = F.when(F.size("topics") > 0, F.array_join(F.slice("topics", 1, 4), "、")).otherwise(F.lit("本集主題"))
    weak = units.weak_title(F.col("zh_title"))
    opening = F.when(~weak, F.concat(F.lit("本集聚焦「"), F.col("zh_title"), F.lit("」，主軸可先放在 "), subject, F.lit("。")))
    opening = opening.when(F.size("found") > 0, F.get("found", F.lit(0))).otherwise(F.concat(F.lit("本集主軸可先放在 "), subject, F.lit("。")))
    points = F.slice(F.array_distinct(F.concat(F.array(opening), F.col("found"))), 1, 4)
    rows = rows.withColumn("points", points)
    asset_line = listed("節目中可追蹤的資產 / 公司包含：", "mentionedAssets", 5, "；這裡僅作內容索引，不代表買賣建議。")
    rows = rows.withColumn("points", appended(F.col("points"), F.size("mentionedAssets") > 0, asset_line, 4))
    policy = F.lit("總經與政策變數會影響風險偏好；若內容提到關稅、利率或資金流，應搭配後續市場反應觀察。")
    rows = rows.withColumn("points", appended(F.col("points"), macro | F.col("zh_title").contains("關稅"), policy, 4))
    head = F.get(split_units(F.coalesce(F.nullif(without_promotions("zh_notes"), F.lit("")), F.col("zh_title")), R.CUES), F.lit(0))
    see = F.when(head.isNotNull() & (head != F.col("zh_title")), F.concat(F.lit("（可參考："), ensure_sentence(head), F.lit("）"))).otherwise(F.lit("。"))
    limited = F.concat(F.lit("目前可用內容有限，系統保守整理為標題 / show notes 摘要；建議回原節目確認完整脈絡"), see)
    rows = rows.withColumn("points", appended(F.col("points"), ~F.col("spoken") | (F.col("n_units") < 2), limited, 99))
    rows = rows.withColumn("points", F.slice(F.filter(F.transform("points", lambda p: ensure_sentence(p)), lambda p: p != ""), 1, 4))
    pad = F.lit(None).cast("string")
    for names, words in reversed(R.FALLBACK_POINTS):
        pad = F.lit(words) if not names else F.when(F.arrays_overlap("topics", F.array(*map(F.lit, names))), F.lit(words)).otherwise(pad)
    rows = rows.withColumn("keyPoints", F.concat("points", F.array_repeat(pad, F.greatest(F.lit(3) - F.size("points"), F.lit(0)))))
    first = F.regexp_replace(F.regexp_replace(F.get("keyPoints", F.lit(0)), "[。！？]$", ""), "^本集", "")
    few = F.when(F.size("topics") > 0, F.array_join(F.slice("topics", 1, 3), "、")).otherwise(F.lit("主要財經議題"))
    short = F.when(~weak, F.concat(F.lit("本集從 "), few, F.lit(" 切入，重點是把標題事件放回資金流、產業鏈與風險管理脈絡中理解。")))
    short = short.otherwise(F.concat(F.lit("本集重點在於"), first, F.lit("，並搭配風險控管角度閱讀。")))
    quality = F.when(F.col("spoken"), "內容品質：已使用 Whisper 逐字稿，並移除偵測到的業配 / 會員推廣片段後整理。").otherwise("內容品質：使用 RSS show notes，並移除偵測到的業配 / 會員推廣片段後整理。")
    body = lines(F.concat(F.lit("TL;DR："), short), "", "重點摘要：", bulleted(F.col("keyPoints")), "", quality, f"提醒：{R.REMINDER}")
    fixed = lambda texts: F.array(*map(F.lit, texts))
    return rows.select(
        "id", "sourceId", "sourceName", "sourceSlug", F.col("zh_title").alias("title"), "url", "publishedAt", now.alias("summarizedAt"),
        F.array_join("keyPoints", " ").alias("excerpt"), "keyPoints", body.alias("body"), "topics", "mentionedAssets", F.lit("insufficient").alias("sentiment"),
        F.when(F.col("spoken"), fixed(R.TRANSCRIPT_RISKS)).otherwise(fixed(R.METADATA_RISKS)).alias("risks"),
        text_quality(F.col("transcript"), F.col("cleaned")).alias("sourceTextQuality"),
    )


def grounded_summaries(raw: DataFrame, claims: DataFrame, entities: DataFrame, sources: DataFrame, now: Column, phrases: dict[str, str] | None = None) -> DataFrame:
    """One summary per raw item with ``transcript``: from its useful claims, or from metadata and entities alone."""
    ranked = useful_claims(claims, phrases=phrases)
    worded = lambda limit: ensure_sentence(editorial("wording", R.SUMMARY_EDITORIAL, shorten_at_clause("wording", limit)), ENDS)
    point = F.concat(lookup("claimType", POINT_PREFIX, "觀點整理"), F.lit("："), worded(86))
    risky = F.col("claimType").isin("risk", "macro") | F.col("sentiment").isin("bearish", "mixed")
    risk = F.concat(lookup("claimType", RISK_PREFIX, "情緒分歧"), F.lit("："), worded(68))
    lists = ranked.groupBy("rawItemId").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.when(F.col("rank") <= 5, point).alias("t")))).alias("p"),
        F.sort_array(F.collect_list(F.struct("rank", F.when(risky, risk).alias("t")))).alias("q"),
        F.sort_array(F.collect_list(F.struct("rank", F.col("clean").alias("t")))).alias("c"),
        F.flatten(F.collect_list("entities")).alias("claim_keys"),
        F.count("*").alias("n_claims"),
    )
    texts = lambda c: F.array_compact(F.transform(c, lambda x: x.t))
    lists = lists.select("rawItemId", texts("p").alias("points"), F.slice(first_by_fingerprint(texts("q")), 1, 3).alias("risk_lines"), F.array_join(texts("c"), " ").alias("claim_text"), "claim_keys", "n_claims")

    owned = entities.filter(F.col("type").isin(R.ASSET_TYPES)).withColumn("label", F.coalesce("ticker", "canonicalName"))
    owned = first_seen(owned, ["rawItemId"], ["id"], "label", 8, "entity_assets")
    told = entities.filter(F.col("type").isin(R.TOPIC_TYPES)).join(lists.select("rawItemId", "claim_text", "claim_keys"), "rawItemId")
    told = told.filter(F.col("claim_text").contains(F.col("canonicalName")) | F.array_contains("claim_keys", F.col("id")) | F.array_contains("claim_keys", F.col("canonicalName")))
    told = first_seen(told, ["rawItemId"], ["id"], "canonicalName", 99, "topic_names")

    rows = metadata_summaries(raw, sources, now, phrases)
    for t in (lists, assets_of(ranked, entities), owned, told, sentiment_of(ranked).withColumnRenamed("sentiment", "mood")):
        t = t.withColumnsRenamed({"rawItemId": "id", "mentionedAssets": "claim_assets"})
        rows = rows.join(t, "id", "left")
    none = F.array().cast("array<string>")
    some = F.coalesce(F.col("n_claims"), F.lit(0)) > 0
    rows = rows.withColumn("some", some).withColumn("base", F.col("topics"))
    rows = rows.withColumn("mentionedAssets", F.when(F.col("some"), F.coalesce("claim_assets", none)).otherwise(F.coalesce("entity_assets", none)))
    named = matched_topics(F.concat_ws(" ", "title", "claim_text"), R.SUMMARY_TOPICS)
    rows = rows.withColumn("topics", F.when(F.col("some"), F.slice(F.array_distinct(F.concat(named, F.coalesce("topic_names", none), F.col("base"))), 1, 6)).otherwise(F.col("base")))
    assets, topics = F.size("mentionedAssets") > 0, F.size("topics") > 0

    index_note = "，僅作內容索引，不代表買賣建議。"
    good = F.coalesce("points", none)
    good = appended(good, assets, listed("可連結到主張的資產 / 標的包含 ", "mentionedAssets", 5, index_note), 3)
    rows = rows.withColumn("good", good)
    rows = rows.withColumn("good", appended(F.col("good"), topics, listed("主題索引以 ", "topics", 4, " 為主，僅代表本集已萃取出的可檢索脈絡。"), 3))
    filler = F.lit("本摘要僅採用通過信心門檻且可回溯到原文片段的主張，未由逐字稿任意延伸。")
    rows = rows.withColumn("good", F.concat("good", F.array_repeat(filler, F.greatest(F.lit(3) - F.size("good"), F.lit(0)))))
    poor = F.array_compact(F.array(
        F.when(assets, listed("本集可確認的標的 / 資產包含 ", "mentionedAssets", 5, index_note)).otherwise("本集尚未萃取出可確認的標的 / 資產，因此不主動延伸個股或 ETF 結論。"),
        F.when(topics, listed("可檢索主題以 ", "topics", 4, " 為主，後續仍需回原節目確認完整脈絡。")),
        F.lit("本集未產生足夠高信心主張，摘要暫不從逐字稿口語片段推導投資判斷。"),
        F.when(~topics, F.lit("內容品質：保留來源索引與風險提醒，等待後續轉錄與主張萃取品質提升後再擴充。")),
    ))
    rows = rows.withColumn("keyPoints", F.when(F.col("some"), F.slice(first_by_fingerprint(F.col("good")), 1, 5)).otherwise(poor))
    rows = rows.withColumn("risks", F.when(F.col("some"), F.array_distinct(F.concat(F.coalesce("risk_lines", none), F.array(F.lit(R.REMINDER))))).otherwise(F.array(F.lit(R.UNGROUNDED_RISK))))

    about = F.when(topics, F.array_join(F.slice("topics", 1, 4), "、")).otherwise("可驗證主張")
    n = F.col("n_claims").cast("string")
    tldr = F.when(F.col("some"), F.concat(F.lit("TL;DR：本摘要以 "), n, F.lit(" 則通過門檻的主張為核心，聚焦 "), about, F.lit("，避免直接複製逐字稿口語內容。")))
    tldr = tldr.otherwise("TL;DR：本集尚未產生足夠高信心主張，因此僅保留來源索引、可確認標的與風險提醒，不從逐字稿口語內容延伸投資結論。")
    all_assets = lambda head, otherwise: F.when(assets, listed(head, "mentionedAssets", 8, "。")).otherwise(otherwise)
    body = lines(
        tldr,
        "",
        "重點摘要：",
        bulleted(F.col("keyPoints")),
        "",
        F.concat(F.lit("風險 / 分歧："), F.array_join("risks", " ")),
        F.when(F.col("some"), all_assets("涉及資產 / 標的：", "本集未萃取出明確可連結到主張的標的。")).otherwise(all_assets("可確認的標的 / 資產：", "本集未萃取出可確認的標的 / 資產。")),
        F.when(F.col("some"), "內容品質：摘要已套用繁中正規化與業配過濾，並優先採用有證據片段的主張與實體。").otherwise("內容品質：摘要已套用繁中正規化與業配過濾；因可用主張不足，本文採保守整理。"),
        f"提醒：{R.REMINDER}",
        F.when(F.col("some"), "證據說明：重點來自通過門檻的主張與實體；仍請回原節目查核完整脈絡與數字。"),
    )
    return rows.select(
        "id", "sourceId", "sourceName", "sourceSlug", "title", "url", "publishedAt", "summarizedAt", F.array_join(F.slice("keyPoints", 1, 2), " ").alias("excerpt"),
        "keyPoints", body.alias("body"), "topics", "mentionedAssets", F.coalesce("mood", F.lit("insufficient")).alias("sentiment"), "risks", "sourceTextQuality",
    )
