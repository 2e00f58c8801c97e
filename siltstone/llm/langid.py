"""Language identification by interpolated Kneser-Ney character models (operator 9).

One model per learned language over the letters of words with a space on either
side. The highest order uses counts, lower orders continuation counts, each
interpolated with the next; every order is a sorted array of 64-bit n-gram hashes
with the discounted share beside it, and one of contexts with the weight passed
down. A text's cost is its summed cross-entropy over its letters and word ends;
the language with the lowest cost per character wins.

Calibration. A fifth of the sample is left out of the counts; on it a temperature
is chosen for the posterior (``score``), and the lowest score that keeps ``target``
precision is the rejection limit (column ``rejected``). The final models count the
whole sample.

Training uses at most ``per_lang`` rows a language, taken in the order of a hash
of doc_id from rows with a lang and crc32(doc_id) mod 3 not 1; their texts are
used whole (of rows that share doc_id and lang, one). Rows are first thinned by a hash limit
for each language, so that no task ranks all rows of one. Only distinct words and counts of that sample reach the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
rejected. With no training row every text is ``und``. Ties go to the language
first in order. lang, source and doc_id are not inputs; extra columns are ignored. Equal
texts get equal results, repeated rows a row each, no rows none; a text of any length is read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._shared import held_out

ORDER = 4
PER_LANG = 400
DISCOUNT = 0.75
TARGET = 0.99
FOLDS = 5
MEMO_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return [] if text is None else _WORD.findall(text.lower())


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = (h ^ (c + np.uint64(1))) * _M
    return x ^ (x >> np.uint64(32))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words with a space before and after each, and the words' sizes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if words else np.zeros(0, np.uint32)
    return flat.astype(np.uint64), sizes


def _grams(codes: np.ndarray, sizes: np.ndarray, order: int):
    """For n = 1..order: hashes of the n-gram that ends at each position, and where it lies in one word."""
    ends = np.cumsum(sizes)
    within = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    out = []
    for n in range(1, order + 1):
        h = np.full(len(codes), n, np.uint64)
        for j in range(n - 1, -1, -1):
            shifted = np.zeros_like(codes)
            shifted[j:] = codes[: len(codes) - j]
            h = _step(h, shifted)
        out.append((h, within >= n - 1))
    return out, within


class KneserNey:
    """One language: per order, sorted hashes of n-grams and contexts with float32 values."""

    def __init__(self, counts: dict[str, int], order: int = ORDER, letters: int = 1000):
        self.order = order
        words = list(counts)
        codes, sizes = _codes(words)
        weight = np.repeat(np.fromiter((counts[w] for w in words), np.int64, len(words)), sizes)
        grams, within = _grams(codes, sizes, order)
        self.tables, self.floor = [], 1.0 / letters
        for n in range(1, order + 1):
            h, ok = grams[n - 1]
            ok = ok & (within > 0)  # the opening space is given, not predicted
            if n == order:
                keys, where = np.unique(h[ok], return_index=True)
                c = np.bincount(np.searchsorted(keys, h[ok]), weight[ok], len(keys))
            else:  # distinct (n + 1)-grams that end in it; n-grams at a word's start have no left letter and count as they are
                longer, long_ok = grams[n]
                start = ok & (within == n - 1)
                _, first = np.unique(longer[long_ok], return_index=True)
                seen = np.concatenate([h[long_ok][first], h[start]])
                w = np.concatenate([np.ones(len(first)), weight[start]])
                keys = np.unique(seen)
                c = np.bincount(np.searchsorted(keys, seen), w, len(keys))
                where = None
            context = self._contexts(codes, grams, h, ok, keys, n)
            ctx, of = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(of, c, len(ctx)), np.bincount(of, minlength=len(ctx))
            share = np.maximum(c - DISCOUNT, 0) / total[of]
            down = np.minimum(DISCOUNT * kinds / total, 1.0)
            self.tables.append((keys, share.astype(np.float32), ctx, down.astype(np.float32)))

    @staticmethod
    def _contexts(codes, grams, h, ok, keys, n) -> np.ndarray:
        """The context hash of each of ``keys``: the (n - 1)-gram before its last letter."""
        at = np.flatnonzero(ok)
        _, first = np.unique(h[at], return_index=True)
        hashes = np.sort(h[at][first])
        if n == 1:
            return np.zeros(len(keys), np.uint64)
        before = grams[n - 2][0][at[first] - 1]
        return before[np.searchsorted(hashes, keys)]

    def costs(self, grams, within) -> np.ndarray:
        """Minus log probability at each position; 0 at opening spaces."""
        p = np.full(len(within), self.floor)
        for n, (keys, share, ctx, down) in enumerate(self.tables, 1):
            h, ok = grams[n - 1]
            if n == 1:
                c = np.zeros(len(h), np.uint64)
            else:
                c = np.zeros_like(h)
                c[1:] = grams[n - 2][0][:-1]
            i = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            known = ok & (ctx[i] == c)
            j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            p = np.where(known, down[i] * p + np.where(keys[j] == h, share[j], 0), p)
        return np.where(within > 0, -np.log(np.maximum(p, 1e-12)), 0)


class Words(dict):
    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Identifier:
    """Models of all languages with a bounded memo of words' costs."""

    def __init__(self, models: dict[str, KneserNey], heat: float = 1.0, limit: float = 0.0):
        self.langs, self.heat, self.limit = sorted(models), heat, limit
        self.models = [models[x] for x in self.langs]
        self._reset()

    def _reset(self):
        self.memo = Words()
        self.costs = np.zeros((1 << 16, len(self.langs) + 1))

    def _learn(self):
        new, self.memo.new = self.memo.new, []
        start = len(self.memo) - len(new)
        while len(self.memo) > len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            codes, sizes = _codes(part)
            grams, within = _grams(codes, sizes, self.models[0].order)
            first = np.cumsum(sizes) - sizes
            rows = slice(start + at, start + at + len(part))
            for k, m in enumerate(self.models):
                self.costs[rows, k] = np.add.reduceat(m.costs(grams, within), first)
            self.costs[rows, -1] = sizes - 1
            for n, w in enumerate(part):  # signs such as superscripts match \w but are no letters
                if not w.isalpha() and not any(map(str.isalpha, w)):
                    self.costs[start + at + n] = 0

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages + 1): summed cost per language, and the number of characters."""
        if len(self.memo) > MEMO_WORDS:
            self._reset()
        index, sizes = [], []
        for t in texts:
            found = words_of(t)
            index.extend(map(self.memo.__getitem__, found))
            sizes.append(len(found))
        if self.memo.new:
            self._learn()
        out = np.zeros((len(texts), len(self.langs) + 1))
        sizes = np.array(sizes, np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            first = (np.cumsum(sizes) - sizes)[full]
            out[full] = np.add.reduceat(self.costs[np.array(index, np.int64)], first, axis=0)
        return out

    def posterior(self, totals: np.ndarray, heat: float | None = None) -> np.ndarray:
        n = np.maximum(totals[:, -1:], 1)
        x = -(totals[:, :-1] / n) * np.sqrt(n) * (self.heat if heat is None else heat)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]):
        """Languages (None: no letter), scores, rejections."""
        if not self.langs:
            return [None] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        totals = self.totals(texts)
        p = self.posterior(totals)
        best, none = (totals[:, :-1]).argmin(axis=1), totals[:, -1] == 0
        score = np.where(none, 0.0, p[np.arange(len(p)), best])
        return [None if z else self.langs[b] for b, z in zip(best, none)], score, none | (score < self.limit)


SPARE = 4  # times per_lang rows pass the hash limit, on average


def sample_ids(docs: DataFrame, per_lang: int) -> DataFrame:
    """(doc_id, y): for each language the ids with the ``per_lang`` least hashes."""
    known = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    known = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("o"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    limit = sizes.select("lang", F.when(F.col("n") > SPARE * per_lang, SPARE * per_lang / F.col("n")).otherwise(1.0).alias("part"))
    low = F.col("o") / F.lit(2.0**64) + 0.5  # uniform in [0, 1]
    # a row for each language, of each of which the driver holds a model
    ids = known.join(F.broadcast(limit), "lang").filter(low <= F.col("part")).select("doc_id", "lang", "o").distinct()
    w = Window.partitionBy("lang").orderBy("o", "doc_id")
    return ids.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_lang).select("doc_id", F.col("lang").alias("y"))


def train(docs: DataFrame, per_lang: int = PER_LANG, order: int = ORDER, target: float = TARGET) -> Identifier:
    ids = sample_ids(docs, per_lang)
    # at most per_lang ids a language; of rows that share an id one text, that with the least hash
    texts = docs.filter("text is not null").select("doc_id", "text", F.col("lang").alias("y")).join(F.broadcast(ids), ["doc_id", "y"])
    texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")

    def count(batches):
        found = defaultdict(Counter)
        for batch in batches:
            for i, t, y in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                found[y, hash_fold(i)].update(words_of(t))
        for (y, fold), words in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([y] * len(words)), pa.array([fold] * len(words), pa.int32()), pa.array(list(words)), pa.array(list(words.values()), pa.int64())],
                ["y", "fold", "word", "n"],
            )

    counted = texts.mapInArrow(count, "y string, fold int, word string, n long").groupBy("y", "fold", "word").agg(F.sum("n").alias("n")).toArrow()
    counts = sorted(zip(*(counted.column(c).to_pylist() for c in ("y", "fold", "word", "n"))))

    def fitted(folds):
        by: dict = defaultdict(dict)
        for y, fold, word, n in counts:
            if fold in folds:
                by[y][word] = by[y].get(word, 0) + n
        return Identifier({y: KneserNey(words, order) for y, words in by.items() if words})

    found = fitted(range(1, FOLDS))
    if found.langs:
        found = calibrate(found, texts, target)
    heat, limit = found.heat, found.limit
    found = fitted(range(FOLDS))
    found.heat, found.limit = heat, limit
    return found


def hash_fold(doc_id) -> int:
    return zlib.crc32(f"fold {doc_id}".encode()) % FOLDS


def calibrate(found: Identifier, texts: DataFrame, target: float) -> Identifier:
    """Choose the temperature and the rejection limit on the fold that was not counted."""
    shared = texts.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        model = shared.value
        for batch in batches:
            rows = [
                (t.tolist(), y)
                for t, y, i in zip(model.totals(batch.column("text").to_pylist()), batch.column("y").to_pylist(), batch.column("doc_id").to_pylist())
                if hash_fold(i) == 0 and t[-1] > 0 and y in model.langs
            ]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.list_(pa.float64())), pa.array([y for _, y in rows], pa.string())], ["t", "y"])

    rows = texts.mapInArrow(run, "t array<double>, y string").collect()
    if not rows:
        return found
    rows = sorted((r.y, r.t) for r in rows)
    totals = np.array([t for _, t in rows])
    y = np.array([found.langs.index(x) for x, _ in rows])
    at = np.arange(len(y))
    grid = [2.0**k for k in range(-5, 6)]
    found.heat = min(grid, key=lambda g: -np.log(np.maximum(found.posterior(totals, g)[at, y], 1e-9)).mean())
    p, best = found.posterior(totals), totals[:, :-1].argmin(axis=1)
    score, right = p[at, best], best == y
    order = np.argsort(-score)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= target
    # where even the last row keeps the target, nothing argues for more than an even chance
    found.limit = 0.5 if good[-1] else float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    found._reset()
    return found


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    model._reset()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        found = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                langs, score, rejected = found.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([x or "und" for x in langs], pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
