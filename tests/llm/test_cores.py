"""Algorithms against plain versions; no Spark."""

import math
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import _shared, decontaminate, langid, mpeg_audio, neardup, token_counts, token_output, toxicity, warc


# -- decontamination -----------------------------------------------------------


def plain_hits(words, items, window):
    hit, found = set(), set()
    for i, item in enumerate(items):
        k = min(window, len(item))
        if not k:
            continue
        windows = {tuple(item[a : a + k]) for a in range(len(item) - k + 1)}
        for p in range(len(words) - k + 1):
            if tuple(words[p : p + k]) in windows:
                hit.update(range(p, p + k))
                found.add(i)
    return hit, found


def test_automaton_equals_window_search():
    rng = random.Random(1)
    for trial in range(60):
        pick = lambda n: [rng.choice(b"abcd").to_bytes() for _ in range(n)]
        items = [pick(rng.randint(0, 14)) for _ in range(rng.randint(0, 6))]
        items += items[:1]
        a = decontaminate.ItemAutomaton([(str(i), x) for i, x in enumerate(items)], window=5)
        docs = [pick(rng.randint(0, 60)) for _ in range(5)]
        numbered = [i for i, x in enumerate(items) if x]
        for words, (spans, found) in zip(docs, a.scan(docs)):
            hit, want = plain_hits(words, items, 5)
            assert {p for s, e in spans for p in range(s, e)} == hit, trial
            assert {numbered[n] for n in found} == want


def test_words_and_cuts():
    assert decontaminate.words_of("Ab-c1 É_ü") == [b"ab", b"c1", "É".encode(), "ü".encode()]
    assert decontaminate.words_of(None) == []
    assert decontaminate.cut_spans("One two, three four.", [(1, 3)]) == "One  four."


# -- near-duplicates ---------------------------------------------------------------


def test_shingle_sets_are_exact():
    texts = ["A b a B a", "one", None, "", "x y z"]
    sets = neardup.shingle_sets(texts, 2)
    assert [len(s) for s in sets] == [2, 1, 0, 0, 2]
    assert len(neardup.shingle_sets(["x y z"], 5)[0]) == 1
    assert np.array_equal(neardup.shingle_sets(["a B"], 2)[0], neardup.shingle_sets(["A  b"], 2)[0])
    assert not np.array_equal(neardup.shingle_sets(["a b"], 2)[0], neardup.shingle_sets(["b a"], 2)[0])


def test_min_max_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    for same in (100, 300, 450):
        pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = np.unique(pool[:500]), np.unique(pool[500 - same : 1000 - same])
        sig = neardup.signatures([a, b], 4000)
        assert abs((sig[0] == sig[1]).mean() - same / (1000 - same)) < 0.05


# -- tokens ----------------------------------------------------------------------------

ODD = ["", "  ", "a b", "...hi!", "İstanbul, ΣΑΣ. don't. it's,", None, "x" * 5000, "<|endoftext|>. a<|endoftext|>b", "12.5, 3", "́a é. ñ,", "a\tb\x1cc\x85d", "ﬁ. ²."]


def test_chunk_encoder_equals_library():
    pytest.importorskip("public_tokenizers")
    e = token_output.ChunkEncoder(token_output.default_tokenizer())
    assert e.chunked
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab é.,'\n 1!?İ́") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    want = [x + [1] for x in e._whole([t or "" for t in texts])]
    assert e.encode(texts).to_pylist() == want and e.encode(texts).to_pylist() == want


def test_chunk_encoder_keeps_case_of_markers(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    path = token_output.default_tokenizer()
    loud = tokenizers.Tokenizer.from_file(path)
    loud.add_special_tokens(["<PAD>"])
    loud.save(str(tmp_path / "loud.json"))
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|StartOfText|>", "<PAD>", "<pad>", "<Pad>", "<|", "End", "A.", "é", " ", "\n"]
    rng = random.Random(9)
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "A <|EndOfText|>. B", "<PAD> <pad>", *["".join(rng.choices(marks, k=rng.randint(1, 8))) for _ in range(300)]]
    for p in (path, str(tmp_path / "loud.json")):
        e = token_output.ChunkEncoder(p)
        assert e.chunked
        for part in (texts, texts[::-1], ["The end", "the END", *texts]):
            assert e.encode(part).to_pylist() == [x + [1] for x in e._whole(part)]


def test_chunk_encoder_holds_little_memory():
    pytest.importorskip("public_tokenizers")
    code = """
import random, resource
from siltstone.llm import token_output
e, rng = token_output.ChunkEncoder(token_output.default_tokenizer()), random.Random(3)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before, letters = peak(), "abcdefghijklmnopqrstuvwxyz"
for _ in range(40):
    e.encode([" ".join("".join(rng.choices(letters, k=6)) + rng.choice(["", ".", ","]) for _ in range(20_000))])
print(peak() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, env=os.environ | {"PYTHONPATH": root})
    assert float(got.stdout) < 220


def test_chunk_encoder_with_a_small_memo(monkeypatch):
    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_output, "MEMO_CHUNKS", 40)
    e, rng = token_output.ChunkEncoder(token_output.default_tokenizer()), random.Random(5)
    for _ in range(30):
        texts = rng.sample(ODD, min(3, len(ODD))) + ["".join(rng.choice("abAB é.,'\n 1!?") for _ in range(rng.randint(0, 80))) for _ in range(8)]
        assert e.encode(texts).to_pylist() == [x + [1] for x in e._whole([t or "" for t in texts])]


def test_full_memo_keeps_used_chunks(monkeypatch):
    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_output, "MEMO_CHUNKS", 200)
    e, learnt, split = token_output.ChunkEncoder(token_output.default_tokenizer()), [], token_output.ChunkEncoder._split
    monkeypatch.setattr(token_output.ChunkEncoder, "_split", lambda self, chunks: learnt.extend(chunks) or split(self, chunks))
    often = [f"{a}{b}" for a in "abcd" for b in "vwxyz"]
    for k in range(40):
        texts = [" ".join([*often, *(f"rare{k}x{i}" for i in range(30))])] * 2
        assert e.encode(texts).to_pylist() == [x + [1] for x in e._whole(texts)]
    assert [learnt.count(w) for w in often] == [1] * len(often)
    assert len(e.memo) < 400  # those seen in one part only went


def test_latin_words_encode_as_by_the_library(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    path = token_output.default_tokenizer()
    e, rng = token_output.ChunkEncoder(path), random.Random(8)
    letters = [c for c in map(chr, range(0x250)) if c.isalpha() and not token_output._NOT_LATIN.search(c)]
    assert len(letters) > 400 and "é" in letters and "İ" not in letters
    words = [*letters, *("a" + c + "B" for c in letters), *("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(3000))]
    assert e.words is not None and e._lowered(words) == e._whole(words)
    ended = [w + "".join(rng.choices(token_output._MARKS + "'\"-", k=rng.randint(1, 4))) for w in words]
    assert e.encode([" ".join(ended)]).to_pylist() == [e._whole([" ".join(ended)])[0] + [1]]
    for added in (["zz", "a!"], ["$$"], []):  # tokens that may lie in a word, or over a word and its mark; another normaliser
        other = tokenizers.Tokenizer.from_file(path)
        other.add_special_tokens(added)
        if not added:
            other.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.NFKC(), tokenizers.normalizers.Lowercase()])
        other.save(str(tmp_path / "other.json"))
        o = token_output.ChunkEncoder(str(tmp_path / "other.json"))
        texts = ["azzb zz, ba! a!! a!? b$$$ c$$, ª ŉ ĳ Ǆ"]
        assert (o.words is None) == (added != ["$$"])
        assert o.encode(texts).to_pylist() == [x + [1] for x in o._whole(texts)]


def test_parts_are_bounded_by_bytes():
    texts = ["é" * 40, None, "", "a" * 500, "b", *["c" * 30] * 7, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for at in (0, 1, 3):  # of a slice too
        parts = list(_shared.sliced(batch.slice(at), rows=4, size=100))
        assert [t for p in parts for t in p.column("text").to_pylist()] == texts[at:]
        held = [[len((t or "").encode()) for t in p.column("text").to_pylist()] for p in parts]
        assert all(len(h) <= 4 and (sum(h) <= 100 or len(h) == 1) for h in held) and any(sum(h) > 100 for h in held)
    assert list(_shared.sliced(batch.slice(0, 0))) == []


def test_token_tree_follows_edits():
    pytest.importorskip("public_tokenizers")
    count, rng = token_counts.counter(), random.Random(6)
    for _ in range(40):
        text = "".join(rng.choice(["word ", "a", "\n", "  ", "12 ", "é", "don't "]) for _ in range(rng.randint(0, 900)))
        tree = token_counts.TokenTree(text, count)
        for _ in range(10):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 7, 700]))
            new = rng.choice(["", " ", "\n", "x y", "'s", "lorem ipsum " * 60])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.total == count(text) and tree.chars[1] == len(text)
            assert tree.tokens_before(len(tree.leaves) - 1) + count(tree.leaves[-1]) == tree.total
    assert token_counts.TokenTree(None, count).total == 0


def test_redactions():
    text = "a@b.co and 123456\nsame\nsame\nlast"
    for a, b, new in token_counts.redactions(text):
        text = text[:a] + new + text[b:]
    assert text == "[EMAIL] and [NUMBER]\nsame\nlast" and token_counts.redactions(None) == []


# -- toxicity, language --------------------------------------------------------------------


def test_ftrl_learns_and_is_sparse():
    rng = random.Random(8)
    rows = []
    for n in range(600):
        words = [f"w{rng.randint(0, 300)}" for _ in range(40)]
        toxic = n % 5 == 0
        rows.append((" ".join([*words, rng.choice(["vile", "vilest", "vilely"])] if toxic else words), int(toxic)))
    sets = toxicity.feature_sets([t for t, _ in rows])
    model = toxicity.ftrl([(s, y) for s, (_, y) in zip(sets, rows)])
    scores = toxicity.Scorer(model).scores([t for t, _ in rows] + [None, ""])
    assert ((scores[:600] >= 0.7) == np.array([y == 1 for _, y in rows])).mean() > 0.98
    assert scores[600] == scores[601] < 0.7 and len(model[0]) < 5000
    assert toxicity.Scorer(model).scores(["w1 w2 vileness w3"])[0] > 0.5  # the stem carries over
    assert list(toxicity.Scorer(None).scores(["x"])) == [0.5]


def test_kneser_ney_sums_to_one():
    m = langid.KneserNey({"abab": 3, "abc": 2, "cab": 1}, order=3, letters=4)
    for history in ("", "a", "ab", "c"):
        words = [history + c for c in "abc"] + [history]
        codes, sizes = langid._codes(words)
        grams, within = langid._grams(codes, sizes, 3)
        cost = m.costs(grams, within)
        at = np.cumsum(sizes) - sizes + len(history) + 1
        assert np.exp(-cost[at]).sum() == pytest.approx(1, abs=0.02), history


def test_identifier():
    found = langid.Identifier({"en": langid.KneserNey({"the": 5, "thing": 3}), "de": langid.KneserNey({"der": 5, "ding": 3})})
    langs, score, rejected = found.predict(["the thing", "der ding", None, "12 !", "²", ""])
    assert langs == ["en", "de", None, None, None, None] and list(score[2:]) == [0, 0, 0, 0] and rejected[2:].all()
    assert langid.Identifier({}).predict(["x"])[0] == [None]


# -- media, archives ------------------------------------------------------------------------


def test_mpeg_round_trip_and_resync():
    rng = random.Random(3)
    for n in (0, 1, 63, 64, 65, 900, 937, 938, 5000):
        payload = mpeg_audio.padded(rng.randbytes(n).replace(b"\xff", b"\xfe"))
        media = mpeg_audio.store(payload)
        got = mpeg_audio.parse(media)
        assert mpeg_audio.payload_of(media, got) == payload and got["skipped"] == 0 and got["crc_bad"] == 0
        assert got["samples"] == 1152 * len(got["offsets"]) and got["vbr"]["frames"] == len(got["offsets"])
        assert all(media[o : o + 2] == b"\xff\xfa" for o in got["offsets"])
    noisy = b"junk\xff\xfb" + media[media.index(b"\xff\xfa") :] + b"TAG" + bytes(125)
    got = mpeg_audio.parse(noisy)
    assert got["skipped"] == 6 and len(got["offsets"]) == 6 and got["crc_bad"] == 0
    broken = bytearray(media)
    broken[mpeg_audio.parse(media)["offsets"][0] + 4] ^= 1
    assert mpeg_audio.parse(bytes(broken))["crc_bad"] == 1
    assert mpeg_audio.parse(b"")["offsets"] == []


def test_mpeg_tag_letters_in_payload():
    for n in (*range(64, 2049, 64), 20 * mpeg_audio.FULL // 64 * 64):
        plain = mpeg_audio.parse(media := mpeg_audio.store(bytes(n)))
        at = len(media) - 128
        for o, s, f in zip(plain["offsets"], plain["sizes"], plain["free"]):
            if f <= at <= o + s - 3:
                before = sum(o + s - f for o, s, f in zip(plain["offsets"], plain["sizes"], plain["free"]) if o + s <= at)
                payload = bytearray(n)
                payload[before + at - f : before + at - f + 3] = b"TAG"
                payload = bytes(payload[:n])
                got = mpeg_audio.parse(media := mpeg_audio.store(payload))
                assert mpeg_audio.payload_of(media, got) == payload and got["offsets"] == plain["offsets"] and got["skipped"] == 0, n
                tagged = mpeg_audio.parse(media + b"TAG" + bytes(125))
                assert tagged["offsets"] == plain["offsets"] and tagged["skipped"] == 0 and tagged["crc_bad"] == 0
    text = bytes(137) + b"TAG" + bytes(116)
    assert mpeg_audio.store(text)[-128:-125] == b"TAG"
    # small frames after the letters; a real tag after a frame that was cut short
    small = (b"\xff\xfb\x14\xc0" + bytes(92)) * 3
    inside = small[:-128] + b"TAG" + small[-125:]
    assert mpeg_audio.parse(inside)["offsets"] == [0, 96, 192]
    cut = mpeg_audio.parse(small[:-50] + b"TAG" + bytes(125))
    assert cut["offsets"] == [0, 96] and cut["skipped"] == 46


def test_payloads_full_of_sync_words():
    rng = random.Random(14)
    for n in range(40):
        words = [b"\xff\xfb\x90\x00", b"\xff\xfb\x14\xc0", b"\xff", b"TAG", b"ID3", b"Xing", rng.randbytes(5)]
        payload = mpeg_audio.padded(b"".join(rng.choice(words) for _ in range(rng.randint(0, 400))))
        media = mpeg_audio.store(payload)
        got = mpeg_audio.parse(media)
        assert mpeg_audio.payload_of(media, got) == payload and got["crc_bad"] == 0 and got["skipped"] == 0, n


def test_frame_sizes():
    assert mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x00]))[5] == 417
    assert mpeg_audio.header(bytes([0xFF, 0xFB, 0x92, 0x00]))[5] == 418
    assert mpeg_audio.header(b"\xff\xff\xff\xff") is None


def record(payload: bytes, kind=b"resource") -> bytes:
    return b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


def archive_of(tmp_path, data: bytes):
    path = tmp_path / "a.txt"
    path.write_bytes(data)
    return warc.Archive(str(path), len(data))


@pytest.mark.parametrize("window", [100, 1 << 20])
def test_chain_rejects_magic_in_payloads(tmp_path, monkeypatch, window):
    monkeypatch.setattr(warc, "READ", window)
    monkeypatch.setattr(warc, "HEADER", 32)
    rng = random.Random(5)
    fake = record(b"inner")
    for split in (64, 200, 1000, 1 << 20):
        payloads = [rng.randbytes(rng.randint(0, 300)) + (fake if n % 3 == 0 else b"") for n in range(40)]
        data = b"".join(map(record, payloads))
        entry, seen = 0, []
        for start in range(0, len(data), split):
            end = min(start + split, len(data))
            links = dict(warc.links_of(archive_of(tmp_path, data), start, end))
            if start <= entry < end:
                seen += [b for _, _, b in warc.records_from(archive_of(tmp_path, data), entry, end)]
                entry = links[entry]
        assert seen == payloads and entry == len(data)


def test_archive_bytes_are_read_once(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ", 64 << 10)
    rng = random.Random(6)
    data = b"".join(record(rng.randbytes(rng.randint(0, 4000))) for _ in range(500))
    linked = walked = entry = 0
    for start in range(0, len(data), 1 << 18):
        end = min(start + (1 << 18), len(data))
        archive = archive_of(tmp_path, data)
        links = dict(warc.links_of(archive, start, end))
        linked += archive.bytes_read
        archive = archive_of(tmp_path, data)
        assert sum(1 for _ in warc.records_from(archive, entry, end))
        walked += archive.bytes_read
        entry = links[entry]
    assert linked <= 1.2 * len(data) and walked <= 1.2 * len(data)


def test_long_header(tmp_path):
    data = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a/WARC/1.0/" + b"x" * 200_000 + b"\r\nContent-Length: 1\r\n\r\na\r\n\r\n" + record(b"b")
    assert [b for _, _, b in warc.records_from(archive_of(tmp_path, data), 0, len(data))] == [b"a", b"b"]
    links = dict(warc.links_of(archive_of(tmp_path, data), 0, 100))
    assert links[0] == len(data) - len(record(b"b"))


def test_broken_chain(tmp_path):
    data = record(b"a") + b"garbage" + record(b"b")
    assert [b for _, _, b in warc.records_from(archive_of(tmp_path, data), 0, len(data))] == [b"a"]
    assert dict(warc.links_of(archive_of(tmp_path, data), 0, len(data)))[0] == -1


def test_crc_of_ids():
    ids = np.array([1, 49407], "<u4")
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(b"\x01\0\0\0\xff\xc0\0\0")


# -- classifiers against plain versions ------------------------------------------------


def test_ftrl_equals_plain_rule():
    """The per-coordinate rule of FTRL-proximal, one coordinate and row at a time."""
    rng = random.Random(8)
    rows = [(np.array(sorted(rng.sample(range(60), rng.randint(0, 12))), np.int64), int(n % 3 == 0)) for n in range(80)]
    rows = [(np.append(f, 7) if y else f[f != 7], y) for f, y in rows]
    rows = [(np.unique(f), y) for f, y in rows]
    bits, size = 6, 64
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.PASSES):
        for r in order.permutation(len(rows)):
            active, y = [*rows[r][0].tolist(), size], rows[r][1]
            w = {i: weight(i) for i in active}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
            g = (p - y) * (toxicity.WEIGHT if y else 1)
            for i in active:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    live, weights, bias = toxicity.ftrl(rows, bits)
    want = {i: weight(i) for i in range(size) if weight(i)}
    assert live.tolist() == sorted(want) and 7 in want
    assert np.allclose(weights, [want[i] for i in sorted(want)], atol=1e-5) and abs(bias - weight(size)) < 1e-9


def plain_kneser_ney(counts, order, letters):
    """word -> summed cost, from dictionaries of n-grams."""
    padded = {f" {w} ": n for w, n in counts.items()}
    tables = []
    for n in range(1, order + 1):
        c: dict = {}
        if n == order:
            for w, k in padded.items():
                for i in range(1, len(w)):
                    if i >= n - 1:
                        c[w[i - n + 1 : i + 1]] = c.get(w[i - n + 1 : i + 1], 0) + k
        else:
            for gram in {w[i - n : i + 1] for w in padded for i in range(n, len(w))}:
                c[gram[1:]] = c.get(gram[1:], 0) + 1
            for w, k in padded.items():
                if 1 <= n - 1 < len(w):
                    c[w[:n]] = c.get(w[:n], 0) + k
        total: dict = {}
        kinds: dict = {}
        for gram, k in c.items():
            total[gram[:-1]] = total.get(gram[:-1], 0) + k
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
        tables.append((c, total, kinds))

    def cost(word):
        w, out = f" {word} ", 0.0
        for i in range(1, len(w)):
            p = 1 / letters
            for n, (c, total, kinds) in enumerate(tables, 1):
                if i < n - 1:
                    break
                context = w[i - n + 1 : i]
                if context in total:
                    share = max(c.get(context + w[i], 0) - langid.DISCOUNT, 0) / total[context]
                    p = share + min(langid.DISCOUNT * kinds[context] / total[context], 1.0) * p
            out -= math.log(max(p, 1e-12))
        return out

    return cost


def test_kneser_ney_equals_plain_version():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    counts = {word(): rng.randint(1, 9) for _ in range(60)}
    for order in (2, 3, 4):
        model = langid.Identifier({"x": langid.KneserNey(counts, order)})
        plain = plain_kneser_ney(counts, order, 1000)
        texts = [*list(counts)[:20], *(word() for _ in range(30)), "zzz", "a"]
        got = model.totals(texts)[:, 0]
        assert np.allclose(got, [plain(t) for t in texts], rtol=1e-4), order


def test_only_one_memo_is_held():
    a = _shared.worker_memo("a", dict)
    a["x"] = 1
    assert _shared.worker_memo("a", dict) is a
    assert _shared.worker_memo("b", dict) == {} and list(_shared._HELD) == ["b"]
    assert _shared.worker_memo("b", dict, full=lambda m: True) == {}
    _shared.drop_memo()
    assert not _shared._HELD


def test_file_numbers_beyond_five_digits(spark):
    names = [(f"part-{n:05d}-x-c000.snappy.parquet", 10) for n in (99999, 100000, 2, 100001)]
    rows = spark.createDataFrame(names, "file_name string, n_tokens long")
    assert {r.number: r.base for r in token_output.file_starts(rows).collect()} == {2: 0, 99999: 10, 100000: 20, 100001: 30}
