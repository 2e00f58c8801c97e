"""Topic segments: greedy packing by size, proportional time splits, topics, importance."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.match import any_term, matched_topics
from siltstone.operators.transcripts import monotonic_times
from siltstone.rules import MAX_CHUNK, MIN_CHUNK, TARGET_CHUNK

_SENTENCE_END = re.compile(r"(?<=[。！？!?；;])\s*")


def slices(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def pack_sentences(text: str, least: int = MIN_CHUNK, target: int = TARGET_CHUNK, most: int = MAX_CHUNK) -> list[str]:
    """A text in parts: sentences, those over the limit sliced at the target, are added until the target, or until the
    next would take a part that is long enough over the limit; a small tail joins its neighbour."""
    sentences = filter(None, (s.strip() for s in _SENTENCE_END.split(" ".join(text.split()))))
    pieces = [p for s in sentences for p in (slices(s, target) if len(s) > most else [s])]
    out, now = [], ""
    for piece in pieces:
        if len(now) >= least and len(now) + len(piece) > most:
            out.append(now)
            now = ""
        now += piece
        if len(now) >= target:
            out.append(now)
            now = ""
    return merge_tail(out + [now] * bool(now), least, most)


def merge_tail(parts: list[str], least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[str]:
    if len(parts) > 1 and len(parts[-1]) < least and len(parts[-2]) + len(parts[-1]) <= most:
        return [*parts[:-2], f"{parts[-2]} {parts[-1]}"]
    return parts


def pack(lengths: list[int], target: int = TARGET_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """The pack number of each piece in order. A pack closes when the next piece would take it over
    the limit, or once it has reached the target; a piece over the limit is a pack of its own."""
    out, number, held = [], 0, 0
    for n in lengths:
        if held and (held + n > most or held >= target):
            number, held = number + 1, 0
        out.append(number)
        held += n
    return out


def pack_rows(rows: DataFrame, keys: list[str], order: str, size: str, target: int = TARGET_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """Adds ``pack`` by the greedy rule within each group, in order (equal ones by their content).

    The rule reads a group in sequence; a group's rows come sorted and in batches, so a group may be larger than memory.
    """
    named = [c for c in rows.columns if c not in (*keys, order, size)]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, order, F.xxhash64(size, *named))
    schema = T.StructType([*rows.schema.fields, T.StructField("pack", T.IntegerType())])

    def run(batches):
        group, number, held = None, 0, 0
        for batch in batches:
            packs = []
            for *key, n in zip(*(batch.column(k).to_pylist() for k in (*keys, size))):
                n = n or 0
                if key != group:
                    group, number, held = key, 0, 0
                elif held and (held + n > most or held >= target):
                    number, held = number + 1, 0
                packs.append(number)
                held += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packs, pa.int32())], [*batch.schema.names, "pack"])

    return rows.mapInArrow(run, schema)


def segment_drafts(transcripts: DataFrame) -> DataFrame:
    """item, position, start, end, text, speakers: pieces of ``segments`` packed per transcript; long ones split with
    their time in proportion. A transcript is one row, so one Arrow batch holds whole transcripts."""

    def run(frames):
        for pdf in frames:
            out = []
            for item, pieces in zip(pdf["id"], pdf["segments"]):
                held: list[dict] = []
                drafts: list[tuple] = []

                def flush(held=held, drafts=drafts):
                    if held:
                        starts = [p["start"] for p in held if p["start"] is not None]
                        ends = [p["end"] for p in held if p["end"] is not None]
                        drafts.append((min(starts, default=None), max(ends, default=None), " ".join(p["text"] for p in held), sorted({p["speaker"] for p in held if p["speaker"]})))
                        held.clear()

                for p in pieces:
                    p = {k: (None if isinstance(v, float) and v != v else v) for k, v in p.items()}
                    text = re.sub(r"\s+", " ", p["text"] or "").strip()
                    if not text:
                        continue
                    size = sum(len(x["text"]) for x in held)
                    if held and (size + len(text) > MAX_CHUNK or size >= TARGET_CHUNK):
                        flush()
                    if len(text) > MAX_CHUNK:
                        parts = pack_sentences(text)
                        for n, part in enumerate(parts):
                            a, b = split_time(p["start"], p["end"], n, len(parts))
                            drafts.append((a, b, part, [p["speaker"]] if p["speaker"] else []))
                        continue
                    held.append(p | {"text": text})
                flush()
                if len(drafts) > 1 and len(drafts[-1][2]) < MIN_CHUNK and len(drafts[-2][2]) + len(drafts[-1][2]) <= MAX_CHUNK:
                    a, b = drafts[-2], drafts.pop()
                    ends = [x for x in (a[1], b[1]) if x is not None]
                    drafts[-1] = (a[0] if a[0] is not None else b[0], max(ends, default=None), f"{a[2]} {b[2]}", sorted({*a[3], *b[3]}))
                out += [(item, n, *d) for n, d in enumerate(drafts)]
            yield pd.DataFrame(out, columns=["item", "position", "start", "end", "text", "speakers"])

    ordered = F.array_sort("segments", lambda a, b: F.when(F.coalesce(a["start"], F.lit(0.0)) < F.coalesce(b["start"], F.lit(0.0)), -1).when(F.coalesce(a["start"], F.lit(0.0)) > F.coalesce(b["start"], F.lit(0.0)), 1).otherwise(0))
    slim = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["speaker"].alias("speaker"), s["text"].alias("text")))
    return transcripts.select("id", slim.alias("segments")).mapInPandas(run, "item string, position int, start double, end double, text string, speakers array<string>")


def split_time(start, end, n: int, of: int, step: float = 0.001):
    """Part ``n`` of a span in equal shares; in steps of a millisecond if it has no length."""
    if start is None or end is None:
        return start, end
    share = (end - start) / of if end > start else step
    return start + n * share, start + (n + 1) * share


def proportional_parts(rows: DataFrame, parts: str, start: str, end: str) -> DataFrame:
    """One row per element of ``parts`` with its equal share of the time span; declarative form of split_time."""
    span = F.col(end) - F.col(start)
    rows = rows.withColumn("n_parts", F.size(parts))
    rows = rows.select("*", F.posexplode(parts).alias("part_no", "part"))
    share = F.when(span > 0, span / F.col("n_parts")).otherwise(F.lit(0.001))
    return rows.withColumn("part_start", F.col(start) + F.col("part_no") * share).withColumn("part_end", F.col(start) + (F.col("part_no") + 1) * share)


def fixed_slices(text: Column, size: int = TARGET_CHUNK) -> Column:
    """A text in slices of a fixed size."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0)))
    return F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))


def importance(topics: Column, assets: Column, major: Column) -> Column:
    return F.when((F.size(assets) >= 2) | major, "high").when((F.size(assets) > 0) | (F.size(topics) > 0), "medium").otherwise("low")


def topic_segments(transcripts: DataFrame, titles: DataFrame, topics: dict[str, list[str]], assets: list[str], major: list[str]) -> DataFrame:
    """Segments of each transcript with times, topics, assets, importance, ordinal id and title. ``titles``: id, title."""
    drafts = monotonic_times(segment_drafts(transcripts), ["item"], ["position"], "start", "end", F.col("position") * F.lit(60.0))
    rows = drafts.join(titles.select(F.col("id").alias("item"), F.col("title").alias("episode")), "item", "left")
    found_assets = F.array_sort(F.array_compact(F.array(*[F.when(any_term("text", [a], "substring_ci"), F.lit(a)) for a in assets])))
    rows = rows.withColumn("topics", matched_topics("text", topics, "substring_ci")).withColumn("mentionedAssets", found_assets)
    rows = rows.withColumn("importance", importance(F.col("topics"), F.col("mentionedAssets"), any_term("text", major, "substring_ci")))
    number = F.row_number().over(Window.partitionBy("item").orderBy("position"))
    subject = F.when(F.size("topics") > 0, F.array_join(F.slice("topics", 1, 2), "、")).otherwise(F.concat(F.lit("#"), number))
    return rows.select(
        F.format_string("%s-seg-%03d", "item", number).alias("id"),
        F.col("item").alias("rawItemId"),
        F.concat_ws(" ", "episode", subject).alias("title"),
        F.col("mono_start").alias("start"),
        F.col("mono_end").alias("end"),
        "text",
        F.col("speakers").alias("speakerIds"),
        "topics",
        "mentionedAssets",
        "importance",
        "position",
    )
