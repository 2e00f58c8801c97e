"""Audio chunk plans: silence logs, fixed and silence-aware cuts, nearest boundaries."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 0.001
PLAN = "strategy string, chunks array<struct<index: int, start: double, end: double, boundary: string>>, silence_count int, warnings array<string>"


def valid_duration(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when((c > EPS) & ~F.isnan(c) & (c != float("inf")), c)


def fixed_chunks(rows: DataFrame, duration: str, size: float) -> DataFrame:
    """One row per chunk: index, start, end, boundary; rows without a valid duration have none."""
    d = valid_duration(F.col(duration).cast("double"))
    last = F.ceil((d - EPS) / size).cast("int") - 1
    rows = rows.withColumn("index", F.explode(F.when(d.isNotNull(), F.sequence(F.lit(0), F.greatest(last, F.lit(0))))))
    end = F.least((F.col("index") + 1) * F.lit(float(size)), F.col(duration).cast("double"))
    boundary = F.when(F.col("index") == F.greatest(last, F.lit(0)), "duration").otherwise("fixed")
    return rows.withColumn("start", F.col("index") * F.lit(float(size))).withColumn("end", F.round(end, 3)).withColumn("boundary", boundary)


def silences(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """(start, end) of silences from ordered log lines: an end takes the latest start not yet taken."""
    number = lambda tag: F.nullif(F.regexp_extract(line, tag + r":\s*([0-9.]+)", 1), F.lit(""))
    rows = lines.withColumn("s", number("silence_start")).withColumn("e", F.when(F.col("s").isNull(), number("silence_end"))).filter("s is not null or e is not null")
    before = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("ps", F.lag("s").over(before))  # events alternate: an end's start is the event just before it
    rows = rows.select(*keys, F.col("ps").try_cast("double").alias("start"), F.col("e").try_cast("double").alias("end"))
    return rows.filter("start is not null and `end` > start")


def midpoints(found: Column, duration: Column) -> Column:
    """Distinct sorted middles of silences that lie inside the recording."""
    mids = F.filter(F.transform(found, lambda s: (s.start + s.end) / 2), lambda m: (m > EPS) & (m < duration - EPS))
    return F.array_sort(F.array_distinct(F.transform(mids, lambda m: F.round(m, 3))))


def rounded(seconds: float) -> float:
    return math.floor(seconds * 1000 + 0.5) / 1000


def merge_tail(chunks: list[dict], least: float, most: float, tolerance: float) -> list[dict]:
    if len(chunks) > 1 and chunks[-1]["end"] - chunks[-1]["start"] < least and chunks[-1]["end"] - chunks[-2]["start"] <= most + tolerance:
        return [*chunks[:-2], chunks[-2] | {"end": chunks[-1]["end"], "boundary": chunks[-1]["boundary"]}]
    return chunks


def usable(duration: float | None) -> bool:
    return duration is not None and math.isfinite(duration) and duration > EPS


def fixed_plan(duration: float | None, size: float) -> list[dict]:
    """Chunks of equal length, the last to the end; none without a usable duration."""
    if not usable(duration):
        return []
    size = max(EPS, size)
    starts = [i * size for i in range(max(1, math.ceil((duration - EPS) / size)))]
    return [{"index": i, "start": rounded(x), "end": rounded(min(x + size, duration)), "boundary": "duration" if x + size >= duration else "fixed"} for i, x in enumerate(starts)]


def plan(duration: float | None, middles: list[float], most: float, least: float, tolerance: float) -> dict:
    """Cuts near every ``most`` seconds, each at the closest silence within ``tolerance`` and more than ``least``
    seconds on, or at the target if there is none; a plan that uses no silence is one of fixed cuts."""
    most, tolerance = max(EPS, most), max(0.0, tolerance)
    least = max(EPS, min(least, most))

    def fixed(warning):
        return {"strategy": "fixed", "chunks": fixed_plan(duration, most), "silence_count": 0, "warnings": [warning]}

    if not usable(duration):
        return fixed("silence-aware chunking skipped: audio duration unavailable")
    if not middles and duration > most:
        return fixed("silence-aware chunking fell back to fixed chunks: no useful silence boundaries detected")
    chunks, at = [], 0.0
    while duration - at > most + EPS:
        target = at + most
        near = [m for m in middles if m > at + least and target - tolerance <= m <= min(duration, target + tolerance)]
        cut = min(near, key=lambda m: (abs(m - target), m), default=target)
        chunks.append({"start": at, "end": rounded(cut), "boundary": "silence" if near else "fixed"})
        at = cut
    if duration - at > EPS:
        chunks.append({"start": rounded(at), "end": rounded(duration), "boundary": "duration"})
    chunks = merge_tail(chunks, least, most, tolerance)
    used = sum(c["boundary"] == "silence" for c in chunks)
    if not used and len(chunks) > 1:
        return fixed("silence-aware chunking fell back to fixed chunks: detected silences were too sparse or outside tolerance")
    chunks = [{"index": i, "start": rounded(c["start"]), "end": rounded(c["end"]), "boundary": c["boundary"]} for i, c in enumerate(chunks)]
    return {"strategy": "silence-aware" if used else "fixed", "chunks": chunks, "silence_count": used, "warnings": []}


def silence_plans(rows: DataFrame, duration: str, middles: str, most: float, least: float, tolerance: float) -> DataFrame:
    """Adds ``plan``; each cut depends on the one before it, so a recording is planned in one call."""
    names = ["strategy", "chunks", "silence_count", "warnings"]

    @F.pandas_udf(PLAN)
    def run(d: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([plan(None if pd.isna(x) else float(x), list(y) if y is not None else [], most, least, tolerance) for x, y in zip(d, m)], columns=names)

    return rows.withColumn("plan", run(F.col(duration).cast("double"), middles))


def nearest(targets: DataFrame, points: DataFrame, keys: list[str], target: str, point: str, tolerance: float) -> DataFrame:
    """Each target with the closest point within tolerance (ties: the smaller), if any.

    A band join as an equi-join: both sides are cut into cells of the tolerance and a
    target looks into its cell and the two beside it. Targets are often exploded from a few
    keys, which Spark's estimates don't see: without the hints it broadcasts them all.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    left = targets.withColumn("cell", F.explode(F.array(cell(target) - 1, cell(target), cell(target) + 1)))
    right = points.select(*keys, F.col(point), cell(point).alias("cell"))
    gap = F.abs(F.col(point) - F.col(target))
    near = left.join(right.hint("merge"), [*keys, "cell"]).filter(gap <= tolerance)
    near = near.groupBy(*keys, target).agg(F.min(F.struct(gap.alias("gap"), F.col(point).alias("p"))).alias("best"))
    return targets.join(near.hint("merge"), [*keys, target], "left").withColumn("nearest", F.col("best.p")).drop("best")
