from pyspark.sql import functions as F

from siltstone.functions import match, scoring, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head().y


def test_missing_values(spark):
    assert one(spark, "", lambda x: text.first_non_empty(x, F.lit("b"))) == "b"
    assert one(spark, " 　", text.blank_to_null) is None
    assert one(spark, "-3", lambda x: text.positive_number(x, 7)) == 7
    assert one(spark, "0", lambda x: text.positive_number(x, 7, allow_zero=True)) == 0
    assert one(spark, "Yes", text.boolean_flag) is True and one(spark, None, text.boolean_flag) is False
    assert one(spark, "-35", text.decibels) == "-35dB" and one(spark, "-35DB", text.decibels) == "-35DB"
    assert one(spark, "x", text.optional_number) is None and one(spark, "1.5", text.optional_number) == 1.5
    assert one(spark, "2.9", lambda x: text.whole_limit(x, 2)) == 2 and one(spark, "-1", lambda x: text.whole_limit(x, 2)) == 2


def test_slugs_and_lengths(spark):
    assert one(spark, "https://A.b/台股 x!", text.slugify) == "a-b-台股-x"
    assert one(spark, "a　 b\n", text.compact_whitespace) == "a b"
    assert one(spark, "abcdef，ghi", lambda x: text.compact_text(x, 7)) == "abcdef…"
    assert one(spark, "一" * 40 + "，" + "二" * 60, lambda x: text.shorten_at_clause(x, 78)) == "一" * 40 + "…"
    assert one(spark, "好，", text.ensure_sentence) == "好。" and one(spark, "好！", text.ensure_sentence) == "好！"


def test_normalisation(spark):
    phrases = {"台积电": "台積電", "积": "積", "电": "電", "同": "同"}
    assert one(spark, "台积电 ,电 ：ＡＢ … ok ?", lambda x: text.normalize_text(x, phrases)) == "台積電，電：AB ... ok？"
    assert one(spark, "<p>a &amp; b</p><script>x<y</script><!-- c -->d", text.clean_html) == "a & b d"
    assert one(spark, "<p>a &eacute; &copy b</p>", text.clean_html) == "a é © b"
    assert one(spark, "a\n內容：x\nb", lambda x: text.without_lines(x, "內容：")) == "a\nb"


def test_html_query_on_cut_references(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    html = ["t = &quot</title>x", "&copy", "&middot &lt b", "a &amp &am &quo", "&amp;lt; &amp;amp; &amp;quot", "&eacute; &#8217;&#39;", "<p>&lt;b&gt;&nbsp;&quot;c&quot; &copy; &middot;", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in entry.queries()["html_clean_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(entry.oracle_sql()["html_clean_text"]).fetchall())
    assert got[0] == "t = &quot x"


def test_units_promotions(spark):
    assert one(spark, "甲。乙！08:30 丙", text.split_units) == ["甲。", "乙！", "08:30 丙"]
    f = lambda x: text.strip_promotions(x, ["業配"], [], ["今天"], [], window=1600)
    assert one(spark, "前言。業配" + "字" * 90 + "。今天市場上漲。", f) == "今天市場上漲。"
    assert one(spark, "12 a，b 3%c", text.fingerprint) == "abc"
    assert one(spark, "abcdefgh", text.shingles) == ["abcdef", "bcdefg", "cdefgh"] and one(spark, "ab", text.shingles) == ["ab"]


def test_dates(spark):
    assert one(spark, "Tue, 02 Jan 2024 03:04:05 GMT", lambda x: text.iso_text(text.parse_feed_date(x))) == "2024-01-02T03:04:05.000Z"
    assert one(spark, "2024-01-02T03:04:05Z", lambda x: text.iso_text(text.parse_feed_date(x))) == "2024-01-02T03:04:05.000Z"
    assert one(spark, "no date", text.parse_feed_date) is None
    assert one(spark, 125.9, text.clock, "double") == "2:05"


def test_four_match_modes(spark):
    hits = lambda v, t: [m for m in match.MODES if one(spark, v, lambda x: match.matches(x, t, m))]
    assert hits("federal rates", "Fed") == ["substring_ci"]
    assert hits("the fed says", "Fed") == ["substring_ci", "letters"]
    assert hits("the Fed says", "Fed") == ["boundary", "substring_ci", "letters", "substring"]
    assert hits("Fed2", "Fed") == ["substring_ci", "letters", "substring"]


def test_tokens_and_rules(spark):
    assert one(spark, "NVDA and AI, TSM NVDA xTSLA", lambda x: match.upper_tokens(x, ["NVDA", "TSM", "AI", "TSLA"], ["AI"])) == ["NVDA", "TSM"]
    rows = spark.createDataFrame([(1, "a Nvidia chip"), (2, "none"), (3, None)], "id int, t string")
    got = match.dictionary_join(rows, "t", [{"name": "輝達", "aliases": ["Nvidia"], "type": "company"}]).collect()
    assert [(r.id, r.name, r.matched) for r in got] == [(1, "輝達", ["Nvidia"])]


def test_vote(spark):
    rows = [((0, 0, 0, 0), "insufficient"), ((1, 0, 1, 0), "mixed"), ((0, 0, 2, 0), "bearish"), ((2, 1, 0, 0), "bullish"), ((1, 1, 0, 0), "neutral"), ((0, 0, 0, 1), "mixed")]
    df = spark.createDataFrame([(*c, e) for c, e in rows], "a int, b int, c int, d int, e string")
    assert all(r.v == r.e for r in df.select("e", scoring.vote("a", "b", "c", "d").alias("v")).collect())


def test_guards_keep_matches(spark):
    assert text.first_characters("(?i)ab|[xy]z|(?<![a-z])\\d:") == {*"aAxXyY0123456789"}
    assert [text.first_characters(p) for p in ("a?b", "(a|b)?c", "^a", "a|", "\\bx", "(?U)a", "(?=a)b", "[^a]b", "[a-c]")] == [None] * 9
    patterns = ["業配|85折", "(?i)nord\\s*vpn", "(嗯|那個).*嗯", "\\bMIT\\b"]
    rows = spark.createDataFrame([("a 85折",), ("NORD  VPN",), ("那個。嗯",), ("85",), ("an MIT x",), ("業",), (None,)], "x string")
    plain = F.col("x").rlike("|".join(f"(?:{p})" for p in patterns))
    got = rows.select(text.any_pattern("x", patterns).alias("a"), plain.alias("b"), text.first_index("x", patterns[:3]).alias("i")).collect()
    assert [r.a for r in got] == [r.b for r in got] == [True, True, True, False, True, False, None]
    assert [r.i for r in got] == [2, 0, 0, -1, -1, -1, -1]
