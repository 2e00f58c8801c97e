"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, decontaminate, langid, mixing, mpeg_audio, neardup, token_counts, token_output, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, ids string, start string, tokens string, node string, `Score` string, epoch string"
RNG = random.Random(11)
LONG = " ".join(f"word{RNG.randint(0, 5000)}" for _ in range(20000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away today"),
    (2, "the quick brown fox jumps over the lazy dog and runs away today"),
    (3, "The quick brown fox jumps over the lazy dog and runs away now"),
    (3, "The quick brown fox jumps over the lazy dog and runs away now"),
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "one"),
    (10, "one"),
    (None, "one"),
    (None, None),
    (11, "completely different words here 12345 a@b.co"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][n % 3], ["a", "a", None][n % 3], 0, "k", "i", "s", "t", "n", "x", "e") for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def plain_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    ids = [i for i, _ in rows]
    comp = list(ids)
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if ids[a] is not None and ids[b] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted((i, len(s), c, c is None or c == i) for i, s, c in zip(ids, sets, comp)) if None not in ids else {(i, len(s), c, c is None or c == i) for i, s, c in zip(ids, sets, comp)}


def test_neardup(spark, docs, none):
    got = neardup.near_duplicates(docs, k=2).collect()
    assert len(got) == len(ROWS) and {tuple(r) for r in got} == plain_components(ROWS, 2, 80)
    assert neardup.near_duplicates(none, k=2).count() == 0


@pytest.mark.parametrize("small", [0, 1 << 40])
def test_neardup_family_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)  # what leaders leave: by blocks, or as joined rows
    monkeypatch.setattr(neardup, "LEADERS", (2,))
    monkeypatch.setattr(neardup, "STRAYS", 7)
    monkeypatch.setattr(neardup, "MEMBERS", 16)
    rng = random.Random(2)
    base = [f"w{n}" for n in range(60)]
    rows = []
    for i in range(150):  # edited copies of which many pairs are under the limit, and unrelated texts
        w = list(base) if i % 3 else [f"u{rng.randint(0, 500)}" for _ in range(40)]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        rows.append((1000 - i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    assert sorted(tuple(r) for r in got.collect()) == plain_components(rows, 2, 80)


def test_keep_one(docs):
    kept = neardup.keep_one(docs, k=2)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 11] and ids.count(None) == 2


def test_keep_one_of_rows_that_share_ids(spark):
    rng = random.Random(12)
    a, b, c, d, e = (" ".join(f"w{rng.randint(0, 5000)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a), (3, a + " end"), (3, b), (3, b), (5, b + " end"), (7, c), (7, c + " end"), (9, d), (9, e), (9, None), (9, ""), (9, ""), (None, a), (None, a)]
    table = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, number long, tie string").repartition(3)
    kept = neardup.keep_one(table, k=2)
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text if r.doc_id != 7 else c) for r in kept.collect()]
    want = [(1, a), (3, b), (7, c), (9, d), (9, e), (9, None), (9, ""), (None, a), (None, a)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_token_output(spark, docs, none):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_output.default_tokenizer())
    got = token_output.round_trip(docs, keep_ids=True).orderBy("start").collect()
    assert len(got) == len(ROWS) and [r.doc_id for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) and r.ids[-1] == 1
        start += r.n_tokens
    want = sorted(tk.encode(t or "", add_special_tokens=False).ids + [1] for _, t in ROWS)
    assert sorted(r.ids for r in got) == want
    assert token_output.round_trip(none).count() == 0


def test_token_encodings(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    import pyarrow.parquet as pq

    for encoding, name in (("delta", "DELTA_BINARY_PACKED"), ("dictionary", "RLE_DICTIONARY")):
        path = str(tmp_path / encoding)
        token_output.write_tokens(docs, path, metadata=("source", "ids"), encoding=encoding)
        f = next(p for p in (tmp_path / encoding).glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
        column = next(c for c in (pq.ParquetFile(f).metadata.row_group(0).column(i) for i in range(9)) if c.path_in_schema.startswith("ids.") )
        assert name in column.encodings or "PLAIN_DICTIONARY" in column.encodings and encoding == "dictionary"
        assert column.has_offset_index
        assert token_output.read_tokens(spark, path).count() == len(ROWS)


def test_token_counts(spark, docs, none):
    pytest.importorskip("public_tokenizers")
    count = token_counts.counter()
    for r in token_counts.edited_counts(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = r.text or ""
        assert r.n_tokens == count(text)
        edits = token_counts.redactions(text)
        for a, b, new in edits:
            text = text[:a] + new + text[b:]
        assert (r.n_tokens_edited, r.n_edits, r.n_chars_edited) == (count(text), len(edits), len(text))
    assert token_counts.edited_counts(none).count() == 0
    trees = token_counts.build_trees(docs.filter("doc_id in (1, 4, 7)"))
    edits = spark.createDataFrame([(1, 2, 0, 3, None), (1, 1, 4, 9, "slow"), (7, 1, 100, 9000, "gap "), (4, 1, 0, 0, "new"), (99, 1, 0, 0, "x"), (None, 1, 0, 0, "x")], "doc_id long, seq int, start int, stop int, replacement string")
    after = {r.doc_id: r for r in token_counts.apply_edits(trees, edits).collect()}
    assert after[1].text == " slow" + ROWS[0][1][9:] and after[4].text == "new" and after[7].text == LONG[:100] + "gap " + LONG[9000:]
    assert all(r.n_tokens == count(r.text) == sum(r.leaf_tokens) and sum(r.leaf_chars) == len(r.text) for r in after.values())


def test_media(docs, none):
    got = mpeg_audio.round_trip(docs).collect()
    assert len(got) == len(ROWS)
    texts = {i: (t or "").encode() for i, t in ROWS if i is not None}
    for r in got:
        if r.doc_id is not None:
            p = mpeg_audio.padded(texts[r.doc_id])
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    by = {r.doc_id: r for r in got}
    assert by[1].media_sha256 == by[2].media_sha256 and by[1].feature == by[2].feature
    probed = mpeg_audio.probe(mpeg_audio.store_texts(docs)).filter("doc_id = 7").head()
    assert probed.duration_us == probed.n_frames * 24000 and len(probed.frame_offsets) == probed.n_frames
    assert mpeg_audio.round_trip(none).count() == 0


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([("q1", "Quick brown fox"), ("q2", "over the lazy dog and runs away today my friend again"), (None, "one"), ("q3", None), ("q4", ""), ("q1", "quick brown fox")], "item_id string, text string, spans string".replace(", spans string", ""))
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (3, 1, True) and got[9].contaminated and got[9].n_items == 0
    assert (got[4].n_words, got[4].items_sha256) == (0, hashlib.sha256(b"").hexdigest()) and not got[7].contaminated
    small = {r.doc_id: r.n_hit for r in decontaminate.scan(docs, bench, shard_words=3).select("doc_id", F.aggregate("spans", F.lit(0), lambda s, x: s + x.b - x.a).alias("n_hit")).collect()}
    assert all(small[i] == r.n_hit for i, r in got.items())
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {4, 5, 6, 7, 8, None, 11}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, max_coverage=0.5).collect()}
    assert cut[1] == "the  jumps over the lazy dog and runs away today" and 9 not in cut
    assert decontaminate.report(none, bench).count() == 0 and decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontaminate_pass_by_pass(spark, docs, monkeypatch):
    items = [(f"q{n}", t) for n, t in enumerate(["Quick brown fox", "the lazy dog and", "runs away today", "runs away now", "completely different", "words here"])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(map(str, decontaminate.scan(docs, bench).collect()))
    cut = sorted(map(str, decontaminate.decontaminate(docs, bench, max_coverage=0.9).collect()))
    built, passes = [], []
    init, write = decontaminate.ItemAutomaton.__init__, decontaminate.materialize

    def build(*a):
        built.append(len(passes))
        init(*a)

    def written(*a):
        passes.append(len(built))
        return write(*a)

    monkeypatch.setattr(decontaminate.ItemAutomaton, "__init__", build)
    monkeypatch.setattr(decontaminate, "materialize", written)
    got = decontaminate.scan(docs, bench, shard_words=3, held=2).collect()
    assert sorted(map(str, got)) == want and max(built.count(n) for n in built) <= 2 and len(passes) == 2 and len(built) == 6
    got = decontaminate.decontaminate(docs, bench, max_coverage=0.9, shard_words=3, held=1)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == cut


def test_toxicity(spark, none):
    rng = random.Random(3)
    rows = [(i, " ".join([f"w{rng.randint(0, 200)}" for _ in range(30)] + (["vile"] if i % 4 == 0 else []))) for i in range(800)]
    docs = spark.createDataFrame([*rows, (None, "vile"), (900, None)], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([*[(i, int(i % 4 == 0)) for i in range(800)], (5, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    test = [i for i in range(800) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in test) and not got[None].held_out
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in test]) > 0.97
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    assert toxicity.train(docs, labels.limit(0)) is None and {r.score for r in toxicity.score(docs, None).collect()} == {0.5}
    assert toxicity.score(none, model).count() == 0


def test_language(spark, docs, none):
    words = {"en": ["the", "thing", "with", "other", "weather"], "de": ["der", "ding", "nicht", "wetter", "schon"]}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i in range(300) for x in [["en", "de"][i % 2]]]
    table = spark.createDataFrame([*rows, (400, None, "en"), (401, "123", "en"), (None, "the other", None)], "doc_id long, text string, lang string")
    model = langid.train(table)
    got = {r.doc_id: r for r in langid.identify(table, model).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows) and got[400].lang_pred == got[401].lang_pred == "und" and got[401].score == 0
    assert got[None].lang_pred == "en" and 0 <= got[None].score <= 1 and not got[None].held_out
    assert {r.lang_pred for r in langid.identify(table, langid.train(none)).collect()} == {"und"} and langid.identify(none, model).count() == 0


def test_language_of_left_out_rows(spark):
    left_out = [i for i in range(1000, 1100) if langid.hash_fold(i) == 0 and zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, ["the thing with other weather", "der ding nicht wetter schon"][i % 2], ["en", "de"][i % 2]) for i in range(60)]
    rare = [(left_out[0], "vreme nije dobro danas ovde", "sr"), (5000, "vreme danas nije dobro", None)]
    table = spark.createDataFrame([*rows, *rare], "doc_id long, text string, lang string")
    model = langid.train(table)
    assert model.langs == ["de", "en", "sr"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(table, model).collect()}
    assert got[left_out[0]] == got[5000] == "sr" and all(got[i] == x for i, _, x in rows)
    only = langid.train(spark.createDataFrame([(i, "the other thing", "en") for i in left_out[:3]], "doc_id long, text string, lang string"))
    assert only.langs == ["en"]


def test_warc(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u v\r\n", ""), (5, "h", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "é", "é" * 3000), (None, "n", "<p>x</p>"), (7, "l", LONG)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string").repartition(2)
    for split in (300, 8 << 20):
        got = {r.page_id: r for r in warc.round_trip(df, split=split).collect()}
        assert len(got) == len(pages) and all(r.intact for r in got.values())
        assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[2].refers_to) == ("revisit", 2, "response", None)
        assert (got[3].refers_to, got[4].record_type, got[None].record_type, got[None].refers_to) == (4, "response", "revisit", 2)
        import base64

        for i, _, h in pages:
            raw = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {r.record_type for r in warc.round_trip(df, min_payload=100).filter("page_id < 3").collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_tasks_and_join_plans(spark, monkeypatch):
    df = spark.createDataFrame([(n, f"http://{n}", "x" * (n % 7) * 50) for n in range(400)], "page_id long, url string, html string").repartition(2)
    want = sorted(warc.round_trip(df).collect())
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)  # payloads are shuffled to their groups
    assert sorted(warc.round_trip(df).collect()) == want
    monkeypatch.setattr(warc, "MOST_RANGES", 6)
    path = warc.scratch_path(spark, "warc")
    warc.write_archives(warc.plan_records(df), path)
    ranges, tasks = warc._ranges(spark, path, 100)
    assert 6 <= tasks <= 8 and ranges.count() == tasks and warc._dealt(ranges, tasks).rdd.getNumPartitions() == tasks
    got = warc.read_archives(spark, path, 100)
    assert got.count() == 400 and got.filter("intact").count() == 400


def test_mixing(spark, docs, none):
    rows = [(i, " ".join(["t"] * (1 + i % 7)), "big" if i < 600 else f"s{i % 5}") for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = mixing.count_tokens(table)
    shares = mixing.source_tokens(counted)
    p = np.array([r.share for r in shares.collect()])
    a = mixing.solve_exponent(shares, entropy=0.95)
    h = lambda x: -(w := p**x / (p**x).sum()) @ np.log(w) / np.log(len(p))
    assert 0 < a < 1 and h(a) >= 0.95 - 1e-5 and h(a + 1e-4) < 0.95
    b = mixing.solve_exponent(shares, max_repeat=3, budget_ratio=None)
    assert max((p / p.max()) ** (b - 1)) == pytest.approx(3, abs=1e-3)
    got = mixing.plan_mix(table, block_tokens=100).collect()
    total = sum(r.tokens for r in counted.collect())
    use: dict = {}
    for r in got:
        use[r.source] = use.get(r.source, 0) + r.tokens
    assert all(abs(use[r.source] - r.weight * total) <= 8 for r in got) and abs(sum(use.values()) - total) < 50
    for s in use:  # starts are prefix sums in (epoch, key) order
        at = 0
        for r in sorted((r for r in got if r.source == s), key=lambda r: (r.epoch, r.block_key)):
            assert r.start == at
            at += r.tokens
    mixed = mixing.mix(docs, max_repeat=2)
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} == set(ROWS)
    assert mixing.mix(none).count() == 0 and mixing.plan_mix(none).count() == 0


def test_mixing_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    rows = [(i, " ".join(["t"] * (1 + i % 7)), "big" if i < 300 else f"s{i % 5}") for i in range(400)]
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]})
    con = duckdb.connect()
    con.register("documents", documents)
    cursor = con.execute(mixing.ORACLE)
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(r) for r in cursor.fetchall())
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(tuple(r) for r in got.select(names).collect()) == want and len(want) > 400


CHAT = [
    (1, 0, "user", "Hello there\nHow are you?"),
    (1, 1, "assistant", "> hello  THERE\nFine."),
    (1, 2, "user", "On Monday X wrote:\n> Fine.\n>> Hello there\nGood to hear"),
    (1, 3, "user", "Another topic"),
    (1, 4, "assistant", "> Hello there\n> How are you?\nLate reply"),
    (1, 5, "assistant", "> never said\nHm"),
    (2, 0, "user", None),
    (2, 1, None, ""),
    (2, 1, None, ""),
    (None, 0, "user", "> Hello there"),
    (3, None, "user", "x"),
]


def test_chat(spark):
    df = spark.createDataFrame([(*r, "e") for r in CHAT], "conv_id long, turn long, role string, text string, level string")
    got = {(r.conv_id, r.turn): r for r in chat.conversations(df).collect()}
    assert [got[1, t].reply_to for t in range(6)] == [None, 0, 1, None, 0, None]
    assert [got[1, t].thread_root for t in range(6)] == [0, 0, 0, 3, 0, 5]
    assert [got[1, t].reply_pos for t in range(6)] == [1, 2, 3, 5, 4, 6]
    assert got[1, 2].own_text == "Good to hear" and got[1, 2].n_quoted == 2 and got[1, 1].rendered == "<|assistant|>\nFine.\n"
    assert got[None, 0].reply_to is None and got[3, None].reply_pos == 1 and chat.conversations(df).count() == len(CHAT)
    text = chat.transcripts(chat.conversations(df), 4).filter("conv_id = 1 and part = 0").head().text
    assert text.count("<|") == 4 and ">" not in text.replace("|>", "")
    assert chat.conversations(df.limit(0)).count() == 0


def test_chat_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    rng = random.Random(7)
    rows = []
    for c in range(12):
        said: list[str] = []
        for t in range(rng.randint(1, 12)):
            own = f"line {rng.randint(0, 6)}"
            quoted = "".join(f"{'>' * rng.randint(1, 2)} {rng.choice(said)}\n" for _ in range(rng.randint(0, 2))) if said else ""
            rows.append((c, t, "user", quoted + own))
            said.append(own)
    con = duckdb.connect()
    table = pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows)))))
    con.register("conversations", table)
    con.register("sent", table)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for sql, messages in (("WITH RECURSIVE " + chat.ORACLE_LINKS.lstrip(), df), (chat.ORACLE, chat.with_quotes(df))):
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        want = sorted(map(str, cursor.fetchall()))
        got = chat.conversations(messages).select(names)
        assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_chat_passages(spark):
    rows = [
        (1, 0, "a", "same\nfirst line\nsecond line\n\nlast"),
        (1, 1, "b", "same\nother"),
        (1, 2, "c", "On Monday a wrote:\n> same\n> first line\n> second line\nI agree"),  # "same" alone would be turn 1
        (1, 3, "d", "Am Dienstag c schrieb:\n>> second line\n> I agree\nSo do I"),
        (1, 4, "e", "> same\nWhich?"),
        (1, 5, "f", "> " + "word " * 50_000 + "\n" + "line\n" * 3000),
        (1, 5, "f", "> " + "word " * 50_000 + "\n" + "line\n" * 3000),
    ]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {r.turn: r for r in got}
    assert [by[t].reply_to for t in range(6)] == [None, None, 0, 2, 1, None] and by[3].own_text == "So do I" and len(got) == 7
    plain = spark.createDataFrame([(1, t, "u", f"text {t}\nline {t}") for t in range(9)] + [(2, 5, "u", "alone"), (None, 1, "u", "x"), (3, None, "u", None)], "conv_id long, turn long, role string, text string")
    links = {r.turn: r.reply_to for r in chat.conversations(chat.with_quotes(plain)).filter("conv_id = 1").collect()}
    assert links == {t: None if t == 0 else t - 2 if t % 3 == 2 else t - 1 for t in range(9)}
    assert chat.with_quotes(plain).count() == 12


def test_pipeline(spark, tmp_path):
    """Stages against plain versions: what each keeps, and the rows of the last."""
    pytest.importorskip("public_tokenizers")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    word = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    texts = [word(60) for _ in range(120)]
    leak = word(15)
    for n in range(120):
        if n % 10 == 1:
            texts[n] += " vile vilest"
        if n % 10 == 2:
            texts[n] = texts[n + 1] + " end"
        if n % 10 == 5:
            texts[n] += " " + leak
    documents = [(n, t, "en", "big" if n % 3 else "small", len(t)) for n, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(n, 1, int(n % 10 == 1)) for n in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = [n for n in range(120) if n % 10 not in (1, 3, 5)]  # toxic, near copies of a smaller id, leaks
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "token_output":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        if name == "decontamination":
            assert sorted(r.doc_id for r in docs.collect()) == left
        if name == "source_mixing":
            assert sorted({r.doc_id for r in docs.collect()}) == left and docs.count() > len(left)
            mixed = [r.doc_id for r in docs.collect()]
    rows = docs.orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(mixed) and rows[-1].start + rows[-1].n_tokens == sum(len(r.ids) for r in rows)


def test_pipeline_stages_on_odd_rows(spark, docs, none, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables in every stage."""
    pytest.importorskip("public_tokenizers")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = str(tmp_path)
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("q", None), (None, "completely different words here")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    rows, empty = docs, none
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, d)
        out.write.parquet(f"{d}/{name}")
        rows = spark.read.parquet(f"{d}/{name}")
        sizes.append(rows.count())
        assert stage(spark, empty, d).count() == 0
        assert name == "token_output" or out.columns == docs.columns
    # all; one each of (1, 2, 3, 3), (7, 8), (9, 10); without id 11; small sources again
    assert sizes[:3] == [len(ROWS), 9, 8] and sizes[3] == sizes[4] >= 8
    ids = {r.doc_id for r in rows.collect()}
    assert ids == {1, 4, 5, 6, 7, 9, None}


def test_select_tokens_reads_a_range(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    path = str(tmp_path / "t")
    token_output.write_tokens(docs, path, metadata=("lang",))
    got = token_output.select_tokens(spark, path, 4, 7, ("lang", "n_tokens"))
    assert got.columns == ["doc_id", "lang", "n_tokens"] and sorted(r.doc_id for r in got.collect()) == [4, 5, 6, 7]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_repeated_ids_do_not_grow_the_samples(spark):
    a, b = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(a, f"text {n % 4}", "en") for n in range(200)] + [(b, "der text", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.sample_ids(table, 400).count() == 2
    assert toxicity.train(table, spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, toxic int")) is not None
    many = spark.createDataFrame([(n, "x", "en") for n in range(5000)], "doc_id long, text string, lang string")
    got = {r.doc_id for r in langid.sample_ids(many, 20).collect()}
    kept = many.filter("crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id", F.xxhash64("doc_id").alias("o")).orderBy("o").limit(20)
    assert got == {r.doc_id for r in kept.collect()}
