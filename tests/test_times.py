import random

from pyspark.sql import functions as F

from siltstone.operators import chunkplan, segments, transcripts


def test_silence_log(spark):
    lines = ["silence_start: 89.5", "silence_end: 91.5 | silence_duration: 2", "noise", "silence_start: 181", "silence_end: 183"]
    df = spark.createDataFrame([("a", n, x) for n, x in enumerate(lines)], "k string, n int, line string")
    got = chunkplan.silences(df, ["k"], "n", "line").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(89.5, 91.5), (181, 183)]
    again = spark.createDataFrame([("a", 0, "silence_start: 1"), ("a", 1, "silence_start: 2"), ("a", 2, "silence_end: 3"), ("a", 3, "silence_end: 4")], "k string, n int, line string")
    assert [(r.start, r.end) for r in chunkplan.silences(again, ["k"], "n", "line").collect()] == [(2, 3)]


def test_silence_plan():
    got = chunkplan.plan(250, [90.5, 182], 90, 30, 5)
    assert [(c["end"], c["boundary"]) for c in got["chunks"]] == [(90.5, "silence"), (182, "silence"), (250, "duration")]
    sparse = chunkplan.plan(250, [11], 90, 30, 5)
    assert sparse["strategy"] == "fixed" and sparse["warnings"] and [(c["start"], c["end"]) for c in sparse["chunks"]] == [(0, 90), (90, 180), (180, 250)]
    assert chunkplan.plan(None, [], 90, 30, 5)["chunks"] == []
    mixed = chunkplan.plan(250, [90.5], 90, 30, 5)  # a target without a silence is cut as it is
    assert [(c["end"], c["boundary"]) for c in mixed["chunks"]] == [(90.5, "silence"), (180.5, "fixed"), (250, "duration")]
    assert (mixed["strategy"], mixed["silence_count"]) == ("silence-aware", 1) and got["silence_count"] == 2
    assert chunkplan.plan(130, [30.0], 60, 30, 40)["chunks"][0]["boundary"] == "fixed"  # the least length is exclusive
    short = chunkplan.plan(50, [20.0], 90, 30, 5)
    assert (short["strategy"], [c["end"] for c in short["chunks"]], short["warnings"]) == ("fixed", [50], [])
    assert [(c["end"], c["boundary"]) for c in chunkplan.fixed_plan(185, 60)] == [(60, "fixed"), (120, "fixed"), (180, "fixed"), (185, "duration")]


def test_fixed_plan(spark):
    df = spark.createDataFrame([(185.0,), (None,), (60.0,)], "d double")
    got = chunkplan.fixed_chunks(df, "d", 60).orderBy("d", "index").collect()
    assert [(r.d, r.end, r.boundary) for r in got] == [(60, 60, "duration"), (185, 60, "fixed"), (185, 120, "fixed"), (185, 180, "fixed"), (185, 185, "duration")]


def test_plans_cover_without_overlap():
    rng = random.Random(3)
    for _ in range(200):
        d = rng.uniform(1, 2000)
        mids = sorted(rng.uniform(0, d) for _ in range(rng.randint(0, 40)))
        c = chunkplan.plan(d, mids, 200, 50, 40)["chunks"]
        assert c[0]["start"] == 0 and abs(c[-1]["end"] - d) < 0.01 and all(a["end"] == b["start"] for a, b in zip(c, c[1:]))


def test_monotonic_equals_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(k, n, rng.choice([None, rng.uniform(-5, 50)]), rng.choice([None, rng.uniform(-5, 60)])) for k in range(5) for n in range(40)]
    df = spark.createDataFrame(rows, "k int, n int, s double, e double")
    got = {(r.k, r.n): (r.mono_start, r.mono_end) for r in transcripts.monotonic_times(df, ["k"], ["n"], "s", "e").collect()}
    for k in range(5):
        before = 0.0
        for _, n, s, e in [r for r in rows if r[0] == k]:
            a = max(s if s is not None else before, before)
            b = max(e if e is not None else a, a)
            assert got[k, n] == (a, b), (k, n)
            before = b


def test_pack_matches_python_rule(spark):
    rng = random.Random(9)
    rows = [(k, n, rng.randint(0, 1500)) for k in range(20) for n in range(rng.randint(1, 15))]
    got = {(r.k, r.n): r.pack for r in segments.pack_rows(spark.createDataFrame(rows, "k int, n int, size int"), ["k"], "n", "size").collect()}
    for k in range(20):
        mine = [r for r in rows if r[0] == k]
        assert [got[k, n] for _, n, _ in mine] == segments.pack([s for *_, s in mine])


def test_pack_sentences():
    text = "甲" * 480 + "。" + "乙" * 400 + "。" + "丙" * 1300 + "。" + "丁" * 50
    parts = segments.pack_sentences(text)
    assert "".join(p.replace(" ", "") for p in parts) == text
    assert [len(p) for p in segments.pack_sentences("甲" * 480 + "乙" * 0 + "。" + "丙" * 1299 + "。")] == [1331, 450]
    assert segments.split_time(0, 10, 1, 2) == (5, 10) and segments.split_time(3, 3, 1, 2) == (3.001, 3.002)


def test_pack_rows_keeps_repeated_rows(spark):
    rows = [("a", 1, 900, "x"), ("a", 1, 900, "x"), ("a", 2, 10, None), (None, 1, 5, "y"), ("b", None, None, "z")]
    got = segments.pack_rows(spark.createDataFrame(rows, "k string, n int, size int, t string"), ["k"], "n", "size").collect()
    assert len(got) == 5 and sorted(r.pack for r in got if r.k == "a") == [0, 1, 2] and {r.pack for r in got if r.k != "a"} == {0}


def test_nearest(spark):
    t = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 99.0)], "k int, t double")
    p = spark.createDataFrame([(1, 9.0), (1, 11.0), (1, 22.0), (2, 99.0)], "k int, p double")
    got = {r.t: r.nearest for r in chunkplan.nearest(t, p, ["k"], "t", "p", 3.0).collect()}
    assert got == {10.0: 9.0, 20.0: 22.0, 99.0: None}


def test_nearest_broadcasts_nothing(spark):
    t = spark.range(1, 3).select(F.col("id").alias("k"), F.explode(F.array(*[F.lit(float(i)) for i in range(10)])).alias("t"))
    p = spark.range(1, 4).select(F.ceil(F.col("id") / 2).alias("k"), F.element_at(F.array(F.lit(0.4), F.lit(8.6), F.lit(3.5)), F.col("id").cast("int")).alias("p"))
    rows = chunkplan.nearest(t, p, ["k"], "t", "p", 0.5)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.k, r.t): r.nearest for r in rows.filter("nearest is not null").collect()} == {(1, 0.0): 0.4, (1, 9.0): 8.6, (2, 3.0): 3.5, (2, 4.0): 3.5}
    assert rows.count() == 20


def test_glossary_counts():
    g = transcripts.Glossary([{"name": "台積電", "aliases": ["台積", "TSMC"], "kind": "asset"}, {"name": "聯準會", "aliases": ["Fed"], "kind": "macro"}])
    out, found = g.apply("台積電與台積、TSMC，federal Fed")
    assert out == "台積電與台積電、台積電，federal 聯準會"
    assert [(c["from"], c["count"]) for c in found] == [("TSMC", 1), ("台積", 1), ("Fed", 1)]


def test_midpoints(spark):
    df = spark.createDataFrame([([(1.0, 2.0), (1.0, 2.0), (99.0, 101.0)],)], "s array<struct<start: double, end: double>>")
    assert df.select(chunkplan.midpoints(F.col("s"), F.lit(100.0)).alias("m")).head().m == [1.5]
