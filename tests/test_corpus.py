"""The corpus operators end to end on a small made-up episode, and sources."""

import pytest
from pyspark.sql import functions as F

from siltstone import rules as R
from siltstone import schemas
from siltstone.operators import claims, digest, entities, insights, quality, segments, summaries, transcripts
from siltstone.sources import audio, feeds, json_tables
from siltstone.streaming import incremental

SAID = [
    "今天來看台積電與輝達的供應鏈，市場預期台積電營收可能會成長，需求帶動股價上漲。",
    "另一方面聯準會的利率政策帶來壓力，通膨風險上升讓美債殖利率走高，成本壓力不確定。",
    "大家好歡迎收聽，記得訂閱我們的頻道。",
]


@pytest.fixture(scope="module")
def corpus(spark):
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  short plans from stage to stage
    pieces = [(f"p{n}", n * 60.0, n * 60.0 + 50, "host", t * 12, None, None) for n, t in enumerate(SAID)]
    raw = spark.createDataFrame([("ep-1", "show", "x", "podcast", "第一集 市場觀察", "說明", "2024-01-02T00:00:00.000Z", "http://e/1", None, None, "2024-01-02T01:00:00.000Z")], schemas.RAW_ITEM)
    t = spark.createDataFrame([("ep-1", "ep-1", "show", "p", "m", "zh", "2024", "u", pieces, "".join(SAID), [])], schemas.RAW_TRANSCRIPT)
    seg = segments.topic_segments(t, raw, R.SEGMENT_TOPICS, ["台積電", "輝達", "美元"], R.MAJOR_TERMS)
    seg = keep(seg)
    ent = keep(entities.roll_up(entities.segment_mentions(seg, R.entity_rules(), R.TICKER_ALLOW, R.TICKER_DENY)))
    cl = keep(claims.extract_claims(seg, ent))
    src = spark.createDataFrame([("show", "Show", "the-show")], "id string, name string, slug string")
    summ = summaries.grounded_summaries(raw.withColumn("transcript", F.lit("".join(SAID))), cl, ent, src, F.lit("2024"))
    summ = keep(summ)
    ins = keep(insights.insights(summ, cl, ent, R.WATCHLISTS))
    return dict(raw=raw, seg=seg, ent=ent, cl=cl, summ=summ, ins=ins)


def test_segments(corpus):
    rows = corpus["seg"].orderBy("position").collect()
    assert rows[0].id == "ep-1-seg-001" and rows[0].importance == "high" and "台積電" in rows[0].mentionedAssets
    assert all(a.end <= b.start or a.end == b.start for a, b in zip(rows, rows[1:]))
    assert all(len(r.text) <= 1200 for r in rows)


def test_entities(corpus):
    by = {r.canonicalName: r for r in corpus["ent"].collect()}
    assert by["台積電"].ticker == "2330" and by["台積電"].id == "entity-company-台積電-2330" and by["聯準會"].type == "macro"
    assert quality.check_entities(corpus["ent"]).count() == 0


def test_claims(corpus):
    rows = corpus["cl"].collect()
    texts = {r.id: r.text for r in corpus["seg"].collect()}
    assert rows and all(r.evidence.quote in texts[r.segmentId] and 0.72 <= r.confidence <= 0.9 for r in rows)
    assert len({r.segmentId for r in rows}) == len(rows)
    assert quality.check_claims(corpus["cl"], corpus["seg"]).count() == 0


def test_summary_gate_insights_digest(spark, corpus):
    s = corpus["summ"].head()
    assert len(s.keyPoints) >= 3 and s.sourceSlug == "the-show" and "2330" in s.mentionedAssets
    assert quality.check_summaries(corpus["summ"]).collect() == []
    ins = corpus["ins"].collect()
    assert {"semis-ai", "macro-rates", "taiwan-market"} <= {i.watchlistKey for i in ins}
    assert quality.check_insights(corpus["ins"], corpus["cl"]).count() == 0
    rich = digest.enrich(corpus["summ"], corpus["cl"], corpus["ins"], corpus["ent"])
    rich = spark.createDataFrame(rich.collect(), rich.schema)
    row = rich.head()
    assert row.evidenceClaims and row.watchlistInsights and row.entityChips[0].label
    assert digest.search(rich, "台積電", "all").count() == 1 and digest.search(rich, "no such word").count() == 0
    assert digest.stats(rich).head().claims == len(row.evidenceClaims)
    assert digest.cards(rich).head().n_insights == len(row.watchlistInsights)
    assert digest.claim_list(rich).count() == len(row.evidenceClaims) and digest.insight_list(rich).count() == len(row.watchlistInsights)
    idx = digest.index(rich, F.lit("2024"), "note")
    assert quality.check_index(idx, "note").count() == 0 and quality.check_index(idx, "other").count() == 1


def test_gate_finds_failures(spark):
    bad = spark.createDataFrame([("b", ["同。", "同。"], "x", "http://a", ["r"])], "id string, keyPoints array<string>, body string, excerpt string, risks array<string>")
    checks = {r.check for r in quality.check_summaries(bad).collect()}
    assert {"structure", "sponsor-leakage", "duplicate-bullets"} <= checks
    with pytest.raises(ValueError):
        quality.require_none(quality.check_summaries(bad))


def test_fallback_summary(spark):
    raw = spark.createDataFrame([("e", "s", "x", "podcast", "標題", "d", "2024", "u", None, None, "f")], schemas.RAW_ITEM).withColumn("transcript", F.lit(None).cast("string"))
    none = lambda schema: spark.createDataFrame([], schema)
    src = spark.createDataFrame([], "id string, name string, slug string")
    s = summaries.grounded_summaries(raw, none(schemas.CLAIM), none(schemas.ENTITY + ", rawItemId string"), src, F.lit("now")).head()
    assert s.sourceTextQuality == "metadata-only" and s.sentiment == "insufficient" and s.sourceName == "s"


def test_grounded_summary_wording(spark):
    raw = spark.createDataFrame([("test-item", "s", "x", "podcast", "市場測試", "只有 metadata 的 fallback 內容", "2026-06-04T00:00:00.000Z", "u", None, None, "f")], schemas.RAW_ITEM)
    raw = raw.withColumn("transcript", F.lit(None).cast("string"))
    said = [
        ("c1", "这波行情走得并不平均，资金集中在台韩市场，美元计价表现明显领先美股大盘。", "macro", ["entity-currency-美元-usd"], ["USD"], "mixed", 0.91),
        ("c2", "这四个议题没那么容易谈拢，布兰特原油价格上涨反映市场仍在评价地缘风险。", "risk", ["entity-commodity-原油"], [], "mixed", 0.9),
    ]
    cl = spark.createDataFrame([(i, "test-item", None, c, k, e, t, s, p, (None, None, "q")) for i, c, k, e, t, s, p in said], "id string, rawItemId string, segmentId string, claim string, claimType string, entities array<string>, tickers array<string>, sentiment string, confidence double, evidence struct<start: double, end: double, quote: string>")
    ent = spark.createDataFrame([("test-item", "entity-currency-美元-usd", "美元", [], "currency", "USD", None, []), ("test-item", "entity-commodity-原油", "原油", [], "commodity", None, None, [])], "rawItemId string, id string, canonicalName string, aliases array<string>, type string, ticker string, exchange string, evidenceSegmentIds array<string>")
    src = spark.createDataFrame([], "id string, name string, slug string")
    s = summaries.grounded_summaries(raw, cl, ent, src, F.lit("now")).head()
    assert s.id == "test-item" and "通過門檻的主張" in s.body and 2 <= len(s.keyPoints) <= 5 and all(p[-1] in "。！？…" for p in s.keyPoints)
    assert "資金表現集中" in " ".join(s.keyPoints) and "这波行情" not in " ".join(s.keyPoints)
    assert sorted(s.mentionedAssets) == ["USD", "原油"] and any("原油" in r for r in s.risks) and s.risks[-1] == R.REMINDER
    rest = summaries.grounded_summaries(raw, cl.limit(0), ent.limit(0), src, F.lit("now")).head()
    assert rest.sourceTextQuality == "metadata-only" and "通過門檻的主張" not in rest.body and len(rest.keyPoints) == 3
    plain = summaries.metadata_summaries(raw.withColumn("transcript", F.lit("融資額度提高，市場今天上漲，半導體族群領軍。台股資金輪動熱絡，ETF 規模持續放大。關稅談判影響市場風險情緒與估值。")), src, F.lit("now")).head()
    assert plain.sourceTextQuality == "transcript" and 3 <= len(plain.keyPoints) <= 4 and plain.keyPoints[0].endswith("延續。") and "Whisper 逐字稿" in plain.body
    assert quality.check_summaries(summaries.grounded_summaries(raw, cl.limit(0), ent.limit(0), src, F.lit("now"))).filter("check <> 'simplified-chinese-drift'").collect() == []


@pytest.mark.parametrize("table, hits", [("sponsors", ["https://x", "NordVPN", "本集節目由甲合作", "贊助商", "限時優惠", "歡迎來信", "維他命"]), ("fillers", ["目前可用內容有限", "資訊不足", "建議搭配原始節目確認完整脈絡"]), ("simplified", ["欢", "台积电"]), ("transcript_like", ["在12:30說", "嗯，就是說"])])
def test_gate_patterns(spark, table, hits):
    assert len(R.GATE[table]) == len(hits)
    for p, h in zip(R.GATE[table], hits):
        assert spark.createDataFrame([(h,)], "h string").filter(F.col("h").rlike(R.ascii_edges(p))).count() == 1


def test_display(spark):
    rows = spark.createDataFrame([("risk", "mixed", "high", "show-notes", "谈拢涨")], "claimType string, sentiment string, riskLevel string, sourceTextQuality string, t string")
    r = digest.display(rows).withColumn("t", digest.display_text("t")).head()
    assert (r.claimTypeLabel, r.sentimentLabel, r.sentimentTone, r.riskLevelLabel, r.riskTone, r.sourceTextQualityLabel, r.t) == ("風險", "混合", "amber", "高", "amber", "Show notes 摘要", "談攏漲")


def test_run_of_all_stages(spark, tmp_path):
    from siltstone.plans import corpus_run

    pieces = [(f"p{n}", n * 60.0, n * 60.0 + 50, "host", t * 12, None, None) for n, t in enumerate(SAID)]
    raw = spark.createDataFrame([("ep-1", "show", "x", "podcast", "第一集 市場觀察", "說明", "2024-01-02T00:00:00.000Z", "http://e/1", None, None, "2024-01-02T01:00:00.000Z")], schemas.RAW_ITEM)
    t = spark.createDataFrame([("ep-1", "ep-1", "show", "p", "m", "zh", "2024", "u", pieces, "".join(SAID), [])], schemas.RAW_TRANSCRIPT)
    src = spark.createDataFrame([("show", "Show", "the-show")], "id string, name string, slug string")
    out = corpus_run.run(spark, raw, t, src, str(tmp_path), corpus_run.RunConfig())
    assert out["digest"].count() == 1 and out["metrics"]["claims"] >= 1 and out["failures"].filter("check in ('quote-not-in-segment', 'duplicate-key')").count() == 0
    assert out["metrics"]["corrections"] >= 0
    again = corpus_run.run(spark, raw, t, src, str(tmp_path), corpus_run.RunConfig(), done=raw.select("id"))
    assert again["digest"].count() == 0


def test_near_copies_keep_first(spark):
    rows = spark.createDataFrame([([(0, "abcdefghij"), (1, "abcdefgh"), (2, "zzzzzzzz"), (3, "xabcdefghijx")],)], "q array<struct<index: int, key: string>>")
    from siltstone.functions.text import shingles

    q = F.transform("q", lambda x: F.struct(x.index.alias("index"), x.key.alias("key"), shingles(x.key).alias("grams")))
    got = rows.select(claims.drop_near_copies(q).alias("k")).head().k
    assert [r["index"] for r in got] == [0, 2]


def test_feeds(spark):
    rss = "<rss><channel><item><guid isPermaLink='false'>g1</guid><title>T</title><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><description>&lt;p&gt;a&lt;/p&gt;</description><enclosure url='http://a/1.mp3'/></item><item><link>http://l</link></item></channel></rss>"
    df = spark.createDataFrame([("s", "2024-02-01T00:00:00.000Z", rss)], "sourceId string, fetchedAt string, xml string")
    a, b = feeds.rss_items(df).orderBy("position").collect()
    assert (a.id, a.audioUrl, a.description) == ("s-2024-01-02-g1", "http://a/1.mp3", "a") and b.externalId == "http://l" and b.publishedAt == "2024-02-01T00:00:00.000Z"
    calls = []

    def get(url):
        calls.append(url)
        if url != "b":
            raise OSError("down")
        return "ok"

    assert feeds.fetch_first(["a", "b"], get, lambda s: None) == "ok" and calls == ["a"] * 3 + ["b"]
    with pytest.raises(RuntimeError):
        feeds.fetch_first(["a"], get, lambda s: None)


def test_audio(spark):
    df = spark.createDataFrame([('{"format":{"duration":"12.5"},"streams":[{"codec_type":"audio","codec_name":"mp3","sample_rate":"44100","channels":2}]}',), ("no json",)], "probe string")
    a, b = [r.metadata for r in audio.probe_metadata(df).collect()]
    assert (a.durationSeconds, a.codec, a.sampleRate, a.warnings) == (12.5, "mp3", 44100, []) and b.durationSeconds is None and b.warnings
    c = audio.AudioConfig.from_env({"ENABLE_AUDIO_VAD": "", "AUDIO_VAD_ENABLED": "true", "AUDIO_MAX_CHUNK_SECONDS": " ", "WHISPER_MAX_CHUNK_SECONDS": "123", "AUDIO_MIN_CHUNK_SECONDS": "999", "AUDIO_VAD_SILENCE_THRESHOLD_DB": "-40"})
    assert (c.vad, c.max_chunk, c.min_chunk, c.silence_db) == (True, 123, 123, "-40dB")
    plain = audio.AudioConfig.from_env({})
    assert (plain.min_chunk, plain.silence_seconds, plain.max_chunk, plain.vad) == (60, 0.6, 900, False)
    log = "silence_start: 89.5\nsilence_end: 91.5 | silence_duration: 2\nsilence_end: 95\nsilence_start: 181\nsilence_end: 183\n"
    on = audio.AudioConfig(vad=True, max_chunk=90, min_chunk=30, tolerance=5)
    assert [x["end"] for x in audio.chunk_plan(lambda args: log, "u", 250, on)["chunks"]] == [90.5, 182, 250]
    assert audio.chunk_plan(lambda args: log, "u", 250, plain) == {"strategy": "fixed", "chunks": [], "silence_count": 0, "warnings": []}
    assert "failed: gone" in audio.chunk_plan(lambda args: (_ for _ in ()).throw(OSError("gone")), "u", 250, on)["warnings"][0]
    assert "90.5,182" in audio.cut_arguments("i", "o", [90.5, 182], c)
    waits, answers = [], iter([(500, {}), (200, {"text": "hi"})])
    p = audio.HttpProvider(lambda f, o: next(answers), sleep=waits.append)
    assert p.transcribe("f", {})["text"] == "hi" and waits == [2.0]
    with pytest.raises(audio.Refused):
        audio.HttpProvider(lambda f, o: (404, {}), sleep=waits.append).transcribe("f", {})
    assert audio.HttpProvider(lambda f, o: (200, {}), sleep=waits.append).transcribe("f", {})["warnings"]

    def run(args):
        if "-segment_times" in args:
            raise OSError("no")
        return ["f0"]

    got = audio.preprocess({"strategy": "silence-aware", "chunks": [{"end": 5.0}, {"end": 9.0}]}, run, "i", "o", c)
    assert got["strategy"] == "fixed" and got["warnings"] and got["chunks"] is None


def test_json_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('[{"id": "1"},\n {"id": "2"}]')
    (tmp_path / "in/b.json").write_text("{broken")
    rows = json_tables.read_items(spark, str(tmp_path / "in"), "id string")
    assert sorted((r.id, r.item_key) for r in rows.collect() if r.id) == [("1", "a"), ("2", "a")]
    assert [tuple(r) for r in json_tables.broken_items(spark, str(tmp_path / "in")).collect()] == [("items", "b", "unreadable", "{broken")]
    assert json_tables.read_optional(spark, str(tmp_path / "none"), "id string").count() == 0
    json_tables.write_items(spark.createDataFrame([("1", None)], "id string, x string"), str(tmp_path / "out"))
    assert '"x"' not in next((tmp_path / "out/item_key=1").glob("*.json")).read_text()


def test_transcript_tables(spark):
    old = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, v string")
    new = spark.createDataFrame([("b", "B2"), ("c", "C")], "id string, v string")
    assert {r.id: r.v for r in transcripts.priority_union([new, old], "id").collect()} == {"a": "A", "b": "B2", "c": "C"}
    assert transcripts.table_fallback(new.limit(0), old).count() == 2
    stamped = lambda df, s: df.withColumn("at", F.lit(s))
    kept = transcripts.keep_unchanged(stamped(old, "new"), stamped(old.replace("B", "X", "v"), "old"), "id", ["v"], "at")
    assert {r.id: r.at for r in kept.collect()} == {"a": "old", "b": "new"}


def test_incremental_stream(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    rows.write.parquet(src)
    run = lambda: incremental.run_available(spark, src, rows.schema, check, incremental.merge_into(out))
    run()
    spark.createDataFrame([("2", "b2"), ("3", "c")], "id string, v string").write.mode("append").parquet(src)
    run()
    assert {r.id: r.v for r in incremental.latest(spark, out).collect()} == {"1": "a", "2": "b2", "3": "c"}
    assert incremental.not_done(rows, rows.filter("id = '1'")).head().id == "2"
    assert incremental.not_done(rows, rows, force=True).count() == 2


def test_units_and_run_config(spark):
    from siltstone.operators import units
    from siltstone.plans.corpus_run import RunConfig

    df = spark.createDataFrame([(1, "市場今天上漲，半導體族群領軍帶動大盤走高。哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈。短句。")], "id int, t string")
    got = units.representative_units(df, "id", "t", ["市場", "半導體"], R.SUMMARY_TOPICS, "^哈").orderBy("rank").collect()
    assert got[0].unit.startswith("市場今天") and len(got) == 2
    weak = lambda t: spark.createDataFrame([(t,)], "t string").select(units.weak_title(F.col("t")).alias("w")).head().w
    assert weak("EP12 | 🦞") and weak("短標題") and not weak("關稅與市場的長期影響")
    points = units.key_points(F.lit("關稅與市場的長期影響"), F.array(F.lit("甲")), F.array(F.lit("總經")), F.array(F.lit("BTC")), ["補一", "補二"])
    assert spark.range(1).select(points.alias("p")).head().p == ["關稅與市場的長期影響。", "甲。", "BTC。"]
    c = RunConfig.parse(["--source", "s", "--limit", "0", "--force"], {"RUN_MAX_ITEMS": "5"}, "now")
    assert (c.source, c.limit, c.max_items, c.force) == ("s", 2, 5, True)


def test_metadata_summaries_in_one_pass(spark):
    """No row is dealt out: not by its few sources, not for its units."""
    raw = spark.range(4).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("sourceId"), F.lit("市場").alias("title"), F.lit("").alias("description"), F.lit("2024").alias("publishedAt"), F.lit("u").alias("url"), F.lit("今天市場").alias("transcript"))
    rows = summaries.metadata_summaries(raw, spark.createDataFrame([], "id string, name string, slug string"), F.lit("now"))
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 4


def test_units_hold_topics_across_their_end(spark):
    """A keyword with a space may begin in a unit and end in the text's head."""
    from siltstone.operators import units

    topics = {"a": ["P Q"], "b": ["半導體"]}
    df = spark.createDataFrame([("Q 市場今天上漲，資金持續流入半導體族群與電子股。",)], "t string")
    new = units.unit_points(F.lit("x P"), F.substring("t", 1, 3), [], topics, seen=F.array(F.lit("b")))
    r = df.select(new.alias("new"), units.unit_points(F.lit("x P"), F.col("t"), [], topics).alias("old")).head()
    assert r.new == r.old == 7 + 80


def test_check_claims_joins_segments_once(spark):
    rows = spark.createDataFrame([("a", "s1", 0.5, ("x",)), ("b", "s2", 1.5, ("y",)), ("b", None, 0.5, (" ",))], "id string, segmentId string, confidence double, evidence struct<quote: string>")
    found = quality.check_claims(rows, spark.createDataFrame([("s1", "z")], "id string, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = sorted((r.id, r.check, r.detail) for r in found.collect())
    assert got == [("a", "quote-not-in-segment", "x"), ("b", "confidence-range", "1.5"), ("b", "duplicate-key", "2"), ("b", "empty-quote", ""), ("b", "unknown-reference", "s2")]


def test_near_copies_against_all_pairs(spark):
    """The pairs of a plain comparison; n-grams meet in one join, and no text travels with its n-grams."""
    import random

    dice = random.Random(5)
    lines = ["".join(dice.choice("abcd") for _ in range(dice.choice([6, 7, 12, 40]))) for _ in range(30)]
    lines += [x[:-1] + "z" for x in lines[:20]] + [x[2:9] for x in lines[:10] if len(x) > 9] + lines[:2]
    data = [(i % 2, i, x) for i, x in enumerate(lines)]
    found = claims.near_copies(spark.createDataFrame(data, "k int, n int, t string"), ["k"], "n", "t")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    grams = lambda x: {x[i : i + 6] for i in range(len(x) - 5)}
    alike = lambda x, y: x in y or y in x or len(grams(x) & grams(y)) >= 0.55 * len(grams(x) | grams(y))
    want = {(k, a, b) for k, a, x in data for j, b, y in data if k == j and a < b and alike(x, y)}
    got = [(r.k, r.a, r.b) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 5
