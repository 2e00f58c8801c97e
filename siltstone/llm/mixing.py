"""Mixing sources to target weights (operator 1); DataFrame functions only.

Shares of tokens by source are raised to an exponent a in [0, 1] and normalised:
1 keeps natural shares, 0 makes them equal. a is bisected until the weights meet a
target: at least a given share of the largest entropy, or at most a given number of
repetitions of any source's tokens. Each pass over the (small, distributed) table of
sources evaluates the 31 inner points of five bisection levels at once.

Realisation. The budget gives each source a token quota. A source's documents are
permuted afresh in each epoch by a hash, epochs follow one another until the quota is
filled, and the stream is cut into blocks so that every block holds each source in
proportion to its weight. Positions come from two-level prefix sums: documents meet
per (source, epoch, hash bucket), only bucket totals meet per source. Buckets hold ``bucket_docs``
documents on average, or the root of the source's number of documents if that is more, so of a source
with a third of all rows neither many rows nor many totals meet in a task.

Defined results: a null source is a source of its own (null); a null text has 0
tokens; a source without tokens gets weight 0 and no row unless ``keep_all``. Rows
without doc_id are permuted by their text. Repeated rows are emitted each. Extra
columns ride along in :func:`mix` whatever their names. No rows give no rows. A text of
any length is counted whole. Documents of equal key (equal ids) follow one another by id and a
hash of their text. :func:`mix` returns the documents' columns alone, so that block and key of
an emitted row are those of :func:`schedule`, not of a file's order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._shared import materialize, running_total

LEVELS = 5
PRECISION = 1e-7
BLOCK_TOKENS = 65_536
BUCKET_DOCS = 128
SEED = 17
MAX_REPEAT = 4.0
ENTROPY = 0.95  # of the largest


def token_count(text):
    """Runs of characters other than white space (space, tab, newline, vertical tab, form feed, return)."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\u000B\f\r]+"), lambda x: x != "")).cast("long")


def count_tokens(docs: DataFrame, ride: bool = False) -> DataFrame:
    """doc_id, source, tokens and tie of every row; with ``ride`` also the whole row as a struct."""
    cols = ["doc_id", "source", token_count(F.col("text")).alias("tokens"), F.xxhash64("text").alias("tie")]
    return docs.select(*cols, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if ride else []))


def source_tokens(counted: DataFrame) -> DataFrame:
    """source, docs, tokens, share; a row for each source."""
    sums = materialize(counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "sources")
    total = sums.agg(F.sum("tokens")).head()[0]
    return sums.withColumn("share", F.col("tokens") / F.lit(float(total or 1)))


def _measures(shares: DataFrame, points: list[float], budget_ratio: float) -> list[tuple[float, float]]:
    """For each exponent: entropy of the weights, and the largest repetition of a source."""
    p, aggs = F.col("share"), []
    for n, a in enumerate(points):
        aggs += [
            F.sum(F.pow(p, F.lit(a))).alias(f"z{n}"),
            F.sum(F.pow(p, F.lit(a)) * F.log(p) * a).alias(f"h{n}"),
            F.max(F.pow(p, F.lit(a - 1.0))).alias(f"r{n}"),
        ]
    row = shares.filter("share > 0").agg(*aggs).head()
    return [(math.log(row[f"z{n}"]) - row[f"h{n}"] / row[f"z{n}"], budget_ratio * row[f"r{n}"] / row[f"z{n}"]) for n in range(len(points))]


def solve_exponent(
    shares: DataFrame, entropy: float | None = None, max_repeat: float | None = None, budget_ratio: float | None = 1.0
) -> float:
    """The largest exponent in [0, 1] whose weights have at least ``entropy`` of the largest
    entropy, or the least whose repetitions stay within ``max_repeat``.

    ``budget_ratio``: budget over all tokens; None: the budget at which the source with
    the least repetition is used once. Where no exponent in range meets the target, the
    nearer end is taken.
    """
    n = shares.filter("share > 0").count()
    if n < 2:
        return 1.0
    goal = None if entropy is None else entropy * math.log(n)

    def fits(h, r):  # true on the side of 0 for entropy, on the side of 1 for repetition
        return h >= goal if goal is not None else r <= max_repeat

    def measure(points):
        if budget_ratio is not None or goal is not None:
            return _measures(shares, points, budget_ratio or 1.0)
        ends = shares.filter("share > 0").agg(F.min("share"), F.max("share")).head()
        return [(0.0, (ends[0] / ends[1]) ** (a - 1.0)) for a in points]

    low, high = 0.0, 1.0
    first = measure([low, high])
    if goal is not None:
        if fits(*first[1]):
            return 1.0
        if not fits(*first[0]):
            return 0.0
    else:
        if fits(*first[0]):
            return 0.0
        if not fits(*first[1]):
            return 1.0
    while high - low > PRECISION:
        k = 2**LEVELS
        points = [low + (high - low) * i / k for i in range(k + 1)]
        ok = [fits(*m) for m in measure(points[1:-1])]
        at = sum(ok) if goal is not None else len(ok) - sum(ok)
        low, high = points[at], points[at + 1]
    return round(low if goal is not None else high, 6)


def weighted(shares: DataFrame, exponent: float, budget: int | None) -> DataFrame:
    """Adds weight, quota and repeats. budget None: the source with the least repetition is used once."""
    rows = shares.withColumn("power", F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0))
    z, once = rows.agg(F.sum("power"), F.max(F.when(F.col("power") > 0, F.col("tokens") / F.col("power")))).head()
    rows = rows.withColumn("weight", F.col("power") / F.lit(z or 1.0))
    quota = F.col("power") * F.lit(once or 0.0) if budget is None else F.col("weight") * F.lit(budget)
    rows = rows.withColumn("quota", F.round(quota).cast("long"))
    return rows.withColumn("repeats", F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(0.0)).drop("power")


def _key(seed: int, epoch, text):
    """A 60-bit hash that SQL engines agree on."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def schedule(
    counted: DataFrame,
    weights: DataFrame,
    block_tokens: int = BLOCK_TOKENS,
    bucket_docs: int = BUCKET_DOCS,
    seed: int = SEED,
    keep_all: bool = False,
) -> DataFrame:
    """The rows of ``counted``, once for each epoch that uses them, with epoch, key, start and block.

    A document belongs to an epoch if its first token lies within its source's
    quota; ``keep_all`` also keeps every document of epoch 0. ``start``: the tokens of
    the source before it. Within a block, ``key`` is the order.
    """
    budget = weights.agg(F.sum("quota")).head()[0] or 0
    blocks = max(1, -(-budget // block_tokens))
    plan = weights.filter(F.lit(keep_all) | (F.col("quota") > 0)).select(
        F.col("source").alias("s"),
        "quota",
        F.ceil(F.col("docs") / F.greatest(F.lit(float(bucket_docs)), F.sqrt("docs"))).alias("buckets"),
        F.greatest(F.ceil("repeats"), F.lit(1)).alias("epochs"),
    )
    rows = counted.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    rows = rows.withColumn("key", _key(seed, F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.col("tie").cast("string"))))
    bucket = F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("buckets"))
    rows = rows.withColumn("bucket", F.struct("epoch", bucket.alias("part")))
    rows = running_total(rows, ["source"], "bucket", ["key", "doc_id", "tie"], "tokens", "start")
    block = F.least(F.floor(F.col("start") * F.lit(blocks) / F.greatest("quota", F.lit(1))), F.lit(blocks - 1)).cast("long")
    inside = (F.col("start") < F.col("quota")) | (F.lit(keep_all) & (F.col("epoch") == 0))
    return rows.filter(inside).withColumn("block", block).drop("bucket", "buckets", "epochs", "quota")


def plan_mix(docs: DataFrame, entropy: float = ENTROPY, budget_ratio: float = 1.0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The schedule at which the weights reach a share of the largest entropy: narrow rows, no text."""
    counted = count_tokens(docs)
    shares = source_tokens(counted)
    exponent = solve_exponent(shares, entropy=entropy)
    total = shares.agg(F.sum("tokens")).head()[0] or 0
    weights = weighted(shares, exponent, round(total * budget_ratio))
    rows = schedule(counted, weights, block_tokens)
    weight = weights.select(F.col("source").alias("s"), "weight")
    rows = rows.join(weight, F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "source", "tokens", "epoch", "start", "block", F.col("key").alias("block_key"), F.round("weight", 6).alias("weight"))


def mix(docs: DataFrame, max_repeat: float = MAX_REPEAT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of ``docs``, all columns, repeated to the weights that ``max_repeat`` allows; none is lost.

    The source with the least repetition is used once, smaller ones up to ``max_repeat`` times.
    """
    shares = source_tokens(count_tokens(docs))
    exponent = solve_exponent(shares, max_repeat=max_repeat, budget_ratio=None)
    rows = schedule(count_tokens(docs, ride=True), weighted(shares, exponent, None), block_tokens, keep_all=True)
    return rows.select("row.*")


ORACLE = r"""
WITH RECURSIVE c AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	

]+')) AS BIGINT) AS tokens FROM documents),
s0 AS (SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM c GROUP BY source),
s AS MATERIALIZED (SELECT source, docs, tokens, tokens / (SELECT sum(tokens)::DOUBLE FROM s0) AS share FROM s0),
goal AS (SELECT 0.95 * ln(count(*)) AS g FROM s WHERE share > 0),
bi(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h >= g THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= g THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT g FROM goal) AS g,
      (SELECT ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * ln(share)) * (lo + hi) / 2 / sum(pow(share, (lo + hi) / 2)) FROM s WHERE share > 0) AS h
    FROM bi WHERE i < 25)),
nat AS (SELECT -sum(share * ln(share)) AS h FROM s WHERE share > 0),
a AS (SELECT CASE WHEN (SELECT h FROM nat) >= (SELECT g FROM goal) OR (SELECT count(*) FROM s WHERE share > 0) < 2 THEN 1.0 ELSE round(lo, 6) END AS a FROM bi WHERE i = 25),
w AS (SELECT source, docs, tokens, CASE WHEN share > 0 THEN pow(share, (SELECT a FROM a)) ELSE 0 END
    / (SELECT sum(pow(share, (SELECT a FROM a))) FROM s WHERE share > 0) AS weight FROM s),
q AS MATERIALIZED (SELECT source, tokens AS st, weight, CAST(round(weight * (SELECT sum(tokens) FROM s)) AS BIGINT) AS quota FROM w),
nb AS (SELECT greatest(1, CAST(ceil(sum(quota) / 65536.0) AS BIGINT)) AS blocks FROM q),
e AS (SELECT doc_id, c.source, tokens, st, weight, quota, unnest(range(0, CAST(ceil(quota / st) AS BIGINT))) AS epoch
  FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source WHERE quota > 0),
k AS (SELECT *, CAST('0x' || substr(md5('17|' || epoch || '|' || doc_id), 1, 15) AS BIGINT) AS key FROM e),
p AS (SELECT *, CAST(epoch * st + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k)
SELECT doc_id, source, tokens, epoch, start, CAST(least(floor(start * blocks / quota), blocks - 1) AS BIGINT) AS block, key AS block_key, round(weight, 6) AS weight
FROM p, nb WHERE start < quota
"""
