"""The corpus analytics run: every stage is written, reread and validated."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone import rules as R
from siltstone.operators import claims, digest, entities, insights, quality, segments, summaries
from siltstone.operators import transcripts as terms
from siltstone.streaming.incremental import next_items, not_done


@dataclass(frozen=True)
class RunConfig:
    """Parameters of a run; from arguments and environment by :meth:`parse`."""

    source: str | None = None
    limit: int = 2
    max_items: int | None = None
    force: bool = False
    now: str = "1970-01-01T00:00:00.000Z"

    @classmethod
    def parse(cls, argv: list[str], env: dict[str, str], now: str) -> RunConfig:
        given = dict(zip((a[2:] for a in argv if a.startswith("--")), [argv[i + 1] if i + 1 < len(argv) and not argv[i + 1].startswith("--") else "" for i, a in enumerate(argv) if a.startswith("--")]))

        def whole(text, default):
            try:
                n = int(float(text))
            except (TypeError, ValueError, OverflowError):
                return default
            return n if n > 0 else default

        return cls(
            source=given.get("source") or env.get("RUN_SOURCE") or None,
            limit=whole(given.get("limit") or env.get("RUN_LIMIT"), cls.limit),
            max_items=whole(given.get("max-items") or env.get("RUN_MAX_ITEMS"), None),
            force="force" in given,
            now=now,
        )


@dataclass
class Run:
    spark: SparkSession
    folder: str
    metrics: dict[str, int] = field(default_factory=dict)

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a stage, note its row count, and go on from what was written."""
        seen = Observation(name)
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.metrics[name] = seen.get["rows"]
        return self.spark.read.parquet(f"{self.folder}/{name}")


def run(spark: SparkSession, raw: DataFrame, transcripts: DataFrame, sources: DataFrame, folder: str, config: RunConfig, done: DataFrame | None = None) -> dict:
    """raw items and transcripts (with segments) to enriched summaries; failures are rows, not exceptions."""
    work = Run(spark, folder)
    if done is not None:
        raw = next_items(not_done(raw, done, "id", config.force), config.limit)
    transcripts = transcripts.join(raw.select("id"), "id", "left_semi")
    transcripts = work.stage("normalized", terms.normalize_transcripts(transcripts, R.GLOSSARY))
    work.metrics["corrections"] = terms.total_corrections(transcripts)
    seg = work.stage("segments", segments.topic_segments(transcripts, raw, R.SEGMENT_TOPICS, [g["name"] for g in R.GLOSSARY if g["kind"] == "asset"], R.MAJOR_TERMS))
    ent = work.stage("entities", entities.roll_up(entities.segment_mentions(seg, R.entity_rules(), R.TICKER_ALLOW, R.TICKER_DENY)))
    cl = work.stage("claims", claims.extract_claims(seg, ent))
    told = raw.join(transcripts.select("id", F.col("text").alias("transcript")), "id")
    summ = work.stage("summaries", summaries.grounded_summaries(told, cl, ent, sources, F.lit(config.now)))
    ins = work.stage("insights", insights.insights(summ, cl, ent, R.WATCHLISTS))
    out = work.stage("digest", digest.enrich(summ, cl, ins, ent))
    failures = [quality.check_entities(ent), quality.check_claims(cl, seg), quality.check_insights(ins, cl), quality.check_summaries(summ)]
    failed = work.stage("failures", quality.union_all(failures))
    return {"digest": out, "failures": failed, "metrics": work.metrics}
