"""Audio: probe projection, transcoder arguments, run configuration, transcription providers."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import optional_number
from siltstone.operators import chunkplan
from siltstone.schemas import PROBE


def probe_metadata(rows: DataFrame, column: str = "probe") -> DataFrame:
    """metadata from probe JSON text: the first audio stream; what can't be read becomes a warning."""
    p = F.from_json(column, PROBE)
    rows = rows.withColumn("p", p).withColumn("s", F.try_element_at(F.filter("p.streams", lambda s: s.codec_type == "audio"), F.lit(1)))
    bad = F.when(F.col("p").isNull() | (F.col("p.format").isNull() & F.col("p.streams").isNull()), F.lit("probe failed"))
    none = F.when(bad.isNull() & F.col("s").isNull(), F.lit("no audio stream"))
    meta = F.struct(
        F.coalesce(optional_number("p.format.duration"), optional_number("s.duration")).alias("durationSeconds"),
        F.col("s.codec_name").alias("codec"),
        optional_number("s.sample_rate").cast("int").alias("sampleRate"),
        F.col("s.channels").alias("channels"),
        F.array_compact(F.array(bad, none)).alias("warnings"),
    )
    return rows.withColumn("metadata", meta).drop("p", "s")


@dataclass(frozen=True)
class AudioConfig:
    """Settings of a run; the defaults are fixed values."""

    sample_rate: int = 16000
    channels: int = 1
    bitrate: str = "32k"
    segment_seconds: float = 900.0
    max_chunk: float = 900.0
    min_chunk: float = 60.0
    tolerance: float = 30.0
    silence_db: str = "-35dB"
    silence_seconds: float = 0.6
    vad: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str]) -> AudioConfig:
        """By environment variables, fixed values too; a blank one counts as missing. The minimum is capped by the maximum."""

        def first(*names):
            return next((v.strip() for n in names if (v := env.get(n) or "").strip()), None)

        def number(default, *names, zero=False):
            try:
                x = float(first(*names) or "nan")
            except ValueError:
                return default
            return x if (x >= 0 if zero else x > 0) and x != float("inf") else default

        segment = number(cls.segment_seconds, "AUDIO_SEGMENT_SECONDS", "WHISPER_SEGMENT_SECONDS")
        longest = number(segment, "AUDIO_MAX_CHUNK_SECONDS", "WHISPER_MAX_CHUNK_SECONDS")
        db = first("AUDIO_VAD_SILENCE_THRESHOLD_DB") or cls.silence_db
        return cls(
            sample_rate=int(number(cls.sample_rate, "AUDIO_TARGET_SAMPLE_RATE")),
            channels=int(number(cls.channels, "AUDIO_TARGET_CHANNELS")),
            bitrate=first("AUDIO_TARGET_BITRATE", "WHISPER_AUDIO_BITRATE") or cls.bitrate,
            segment_seconds=segment,
            max_chunk=longest,
            min_chunk=min(number(cls.min_chunk, "AUDIO_MIN_CHUNK_SECONDS"), longest),
            tolerance=number(cls.tolerance, "AUDIO_CHUNK_BOUNDARY_TOLERANCE_SECONDS", zero=True),
            silence_db=db if db.lower().endswith("db") else db + "dB",
            silence_seconds=number(cls.silence_seconds, "AUDIO_VAD_MIN_SILENCE_SECONDS"),
            vad=(first("ENABLE_AUDIO_VAD", "AUDIO_VAD_ENABLED") or "").lower() in ("1", "true", "yes", "on"),
        )


def _encode(c: AudioConfig) -> list[str]:
    return ["-vn", "-ac", str(c.channels), "-ar", str(c.sample_rate), "-b:a", c.bitrate]


def fixed_arguments(source: str, target: str, c: AudioConfig) -> list[str]:
    return ["-y", "-i", source, *_encode(c), "-f", "segment", "-segment_time", f"{c.max_chunk:g}", target]


def cut_arguments(source: str, target: str, cuts: list[float], c: AudioConfig) -> list[str]:
    return ["-y", "-i", source, *_encode(c), "-f", "segment", "-segment_times", ",".join(f"{x:g}" for x in cuts), target]


def silence_arguments(source: str, c: AudioConfig) -> list[str]:
    return ["-i", source, "-af", f"silencedetect=noise={c.silence_db}:d={c.silence_seconds:g}", "-f", "null", "-"]


_EVENT = re.compile(r"silence_(start|end):\s*([0-9.]+)")


def logged_middles(log: str, duration: float | None) -> list[float]:
    """Middles of the silences in a detector's log, see :func:`chunkplan.midpoints`."""
    found, start = set(), None
    for line in log.split("\n"):
        if m := _EVENT.search(line):
            try:
                at = float(m[2])
            except ValueError:
                at = float("nan")
            if m[1] == "end" and start is not None and at > start and duration and chunkplan.EPS < (start + at) / 2 < duration - chunkplan.EPS:
                found.add(chunkplan.rounded((start + at) / 2))
            start = at if m[1] == "start" else None
    return sorted(found)


def chunk_plan(detect: Callable[[list[str]], str], source: str, duration: float | None, c: AudioConfig) -> dict:
    """The plan of a recording; ``detect`` runs the silence detector and returns its log.

    Without voice activity detection, and where the detector fails, it has no chunks and the recording is cut at fixed lengths.
    """
    none = {"strategy": "fixed", "chunks": [], "silence_count": 0, "warnings": []}
    if not c.vad:
        return none
    try:
        log = detect(silence_arguments(source, c))
    except Exception as error:  # noqa: BLE001
        return none | {"warnings": [f"silence-aware chunking fell back to fixed chunks: silencedetect failed: {error}"]}
    return chunkplan.plan(duration, logged_middles(log, duration), c.max_chunk, c.min_chunk, c.tolerance)


def preprocess(plan: dict, run: Callable[[list[str]], list[str]], source: str, target: str, c: AudioConfig) -> dict:
    """Cut by the plan; where that fails, warn, drop the chunk times and cut at fixed lengths."""
    warnings = list(plan.get("warnings", []))
    cuts = [x["end"] for x in plan.get("chunks", [])[:-1]]
    if plan.get("strategy") == "silence-aware" and cuts:
        try:
            return {"strategy": "silence-aware", "files": run(cut_arguments(source, target, cuts, c)), "chunks": plan["chunks"], "warnings": warnings}
        except Exception as error:  # noqa: BLE001
            warnings.append(f"cutting at silences failed: {error}")
    return {"strategy": "fixed", "files": run(fixed_arguments(source, target, c)), "chunks": None, "warnings": warnings}


# -- transcription ----------------------------------------------------------------


class Provider(Protocol):
    def transcribe(self, file: str, options: dict) -> dict: ...


class Refused(Exception):
    """An answer that another attempt won't change."""


@dataclass
class HttpProvider:
    """A provider behind a function that posts a file and returns (status, answer)."""

    post: Callable[[str, dict], tuple[int, dict]]
    attempts: int = 4
    pause: float = 2.0
    sleep: Callable[[float], None] = field(default=time.sleep)

    def transcribe(self, file: str, options: dict) -> dict:
        for attempt in range(1, self.attempts + 1):
            try:
                status, answer = self.post(file, options)
                if 400 <= status < 500:
                    raise Refused(f"status {status}")
                if status >= 500:
                    raise RuntimeError(f"status {status}")
                text = answer.get("text")
                warnings = [] if isinstance(text, str) else ["the answer has no text"]
                return {"text": text if isinstance(text, str) else "", "segments": answer.get("segments"), "warnings": warnings}
            except Refused:
                raise
            except Exception:  # noqa: BLE001
                if attempt == self.attempts:
                    raise
                self.sleep(self.pause * attempt)
        raise AssertionError


def transcribe_all(chunks: DataFrame, provider: Provider, options: dict | None = None) -> DataFrame:
    """text, warnings and error of every chunk (``file``); a failing chunk is reported, others go on."""

    def run(frames):
        for pdf in frames:
            rows = []
            for file in pdf["file"]:
                try:
                    got = provider.transcribe(file, options or {})
                    rows.append((got.get("text", ""), list(got.get("warnings") or []), None))
                except Exception as error:  # noqa: BLE001
                    rows.append((None, [], str(error)))
            yield pdf.assign(text=[r[0] for r in rows], warnings=[r[1] for r in rows], error=[r[2] for r in rows])

    return chunks.mapInPandas(run, chunks.schema.simpleString()[7:-1] + ", text:string, warnings:array<string>, error:string")


def zip_chunks(rows: DataFrame, planned: str, files: str) -> DataFrame:
    """Planned chunks with the produced files, by position; the plan's times are dropped if the counts differ."""
    same = F.size(planned) == F.size(files)
    zipped = F.transform(
        F.sequence(F.lit(0), F.size(files) - 1),
        lambda i: F.struct(i.alias("index"), F.get(files, i).alias("file"), F.when(same, F.get(F.col(planned), i)["start"]).alias("start"), F.when(same, F.get(F.col(planned), i)["end"]).alias("end")),
    )
    return rows.withColumn("zipped", F.when(F.size(files) > 0, zipped))
