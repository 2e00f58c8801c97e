"""Toxicity by FTRL-proximal logistic regression (operator 4).

Features are hashed and binary: word unigrams, word stems (first four and five
letters, so that inflected forms share weight), bigrams and skip-grams with one
word between. Per-coordinate rates and L1 leave few weights; those are broadcast
as two short arrays (at most 2^bits entries).

Training uses at most ``positives`` + ``negatives`` labelled rows, taken in the
order of a hash of doc_id from rows whose crc32(doc_id) mod 3 is not 1; every
sampled text is used whole. The passes run in one executor task.

Defined results: null and empty texts get the score of the bias alone; without any
training row all scores are 0.5. A label that is null is ignored, several labels
of one document count as their maximum; of rows that share a doc_id one text is
trained on. A null doc_id is not held out. Equal texts get equal scores. Scores read
text alone; extra columns are ignored by :func:`score` and kept by :func:`clean`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._shared import held_out, worker_memo

BITS = 20
POSITIVES, NEGATIVES = 3000, 5000
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 10.0, 0.0, 8
WEIGHT = 4.0  # of a positive row's gradient; toxic rows are the fewer
THRESHOLD = 0.7
MEMO_WORDS = 400_000

_WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """Numbers words as first seen; keeps their hash and those of their stems."""

    def __init__(self):
        self.hashes = np.zeros((1 << 16, 3), np.uint64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        h = xxhash.xxh64_intdigest
        self.hashes[n] = h(word), h(word[:4], 4) if len(word) > 4 else 0, h(word[:5], 5) if len(word) > 5 else 0
        self[word] = n
        return n


def hashed(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all texts, and the text that each belongs to; not yet distinct."""
    words, index, sizes = worker_memo("toxicity", Words, lambda m: len(m) > MEMO_WORDS), [], []
    for t in texts:
        found = _WORD.findall(t.lower()) if t else ()
        index.extend(map(words.__getitem__, found))
        sizes.append(len(found))
    h = words.hashes[np.array(index, np.int64)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    parts, owners = [h[:, 0]], [owner]
    for j in (1, 2):
        some = h[:, j] > 0
        parts.append(h[some, j])
        owners.append(owner[some])
    for gap in (1, 2):
        if len(owner) > gap:
            same = owner[:-gap] == owner[gap:]
            parts.append(((h[:-gap, 0] * _M1) ^ (h[gap:, 0] * _M2 + np.uint64(gap)))[same])
            owners.append(owner[:-gap][same])
    ids = np.concatenate(parts)
    ids = (ids ^ (ids >> np.uint64(29))) * _M1 >> np.uint64(64 - bits)
    return ids.astype(np.int64), np.concatenate(owners)


def feature_sets(texts: list[str | None], bits: int = BITS) -> list[np.ndarray]:
    ids, owner = hashed(texts, bits)
    key = np.unique(owner << bits | ids)
    return np.split(key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(1, len(texts))))


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, bias) after PASSES passes over the rows, each in an order of its own."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) > L1, w, 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for r in rng.permutation(len(rows)):
            i, y = np.append(rows[r][0], size), rows[r][1]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (WEIGHT if y else 1)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    live = np.flatnonzero(w[:-1])
    return live, w[live].astype(np.float32), float(w[-1])


def sample_ids(labels: DataFrame, positives: int, negatives: int) -> DataFrame:
    """(doc_id, y) of the bounded training sample."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).withColumn("o", F.xxhash64("doc_id"))
    picked = [known.filter(F.col("y") == y).orderBy("o", "doc_id").limit(n) for y, n in ((1, positives), (0, negatives))]
    return picked[0].union(picked[1]).select("doc_id", "y")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, bits: int = BITS):
    """(indices, weights, bias), or None if no row is labelled."""
    ids = sample_ids(labels, positives, negatives)
    # at most positives + negatives ids; of rows that share an id one text, that with the least hash
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")

    def extract(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = feature_sets(batch.column("text").to_pylist(), bits)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets).astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), lists], ["doc_id", "y", "f"])

    def fit(batches):
        rows = []
        for batch in batches:
            f = batch.column("f")
            flat, ends = f.values.to_numpy(), f.offsets.to_numpy()
            rows += [(flat[a:b].astype(np.int32), y, str(i)) for a, b, y, i in zip(ends[:-1], ends[1:], batch.column("y").to_pylist(), batch.column("doc_id").to_pylist())]
        if rows:
            rows.sort(key=lambda r: (xxhash.xxh64_intdigest(r[2]), r[2], r[1], len(r[0])))
            i, w, bias = ftrl([(f.astype(np.int64), y) for f, y, _ in rows], bits)
            yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), -1], pa.int64()), pa.array([*map(float, w), bias], pa.float64())], ["i", "w"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(extract, f"doc_id {kind}, y int, f array<int>").repartition(1).mapInArrow(fit, "i long, w double").collect()
    if not found:
        return None
    model = sorted((r.i, r.w) for r in found)
    return (
        np.array([i for i, _ in model[1:]], np.int64),
        np.array([w for _, w in model[1:]], np.float32),
        model[0][1],
    )


class Scorer:
    def __init__(self, model, bits: int = BITS):
        self.bits, self.model = bits, model
        self.dense = np.zeros(1 << bits, np.float32)
        if model:
            self.dense[model[0]] = model[1]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.model:
            return np.full(len(texts), 0.5)
        ids, owner = hashed(texts, self.bits)
        live = self.dense[ids] != 0
        key = np.unique(owner[live] << self.bits | ids[live])
        total = np.bincount(key >> self.bits, self.dense[key & ((1 << self.bits) - 1)], len(texts)) + self.model[2]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value, bits)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                got = scorer.scores(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, model, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shared.value, bits)
        for batch in batches:
            keep = [scorer.scores(batch.column(at_text).slice(at, 1000).to_pylist()) < threshold for at in range(0, batch.num_rows, 1000)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
