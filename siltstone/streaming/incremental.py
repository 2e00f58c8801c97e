"""Incremental work: resume, bounded runs, idempotent merges, file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def not_done(items: DataFrame, done: DataFrame, key: str = "id", force: bool = False) -> DataFrame:
    """Items without an artifact yet; all with ``force``."""
    return items if force else items.join(done.select(key).distinct(), key, "left_anti")


def next_items(items: DataFrame, limit: int = 2, order: str = "publishedAt") -> DataFrame:
    """The newest items of a run that does so many."""
    return items.orderBy(F.desc(order), "id").limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of the same key; of several new ones the last by ``fetchedAt``."""
    rows = old.withColumn("generation", F.lit(0)).unionByName(new.withColumn("generation", F.lit(1)), allowMissingColumns=True)
    stamp = F.col("fetchedAt") if "fetchedAt" in rows.columns else F.lit(None).cast("string")
    last = Window.partitionBy(key).orderBy(F.desc("generation"), stamp.desc_nulls_last())
    return rows.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r", "generation")


def run_available(spark: SparkSession, source: str, schema, checkpoint: str, each: Callable[[DataFrame, int], None], key: str | None = None, files_per_trigger: int | None = None, fmt: str = "parquet", watermark: tuple[str, str] | None = None) -> None:
    """Process the files that are new since the checkpoint, then stop. ``key``: duplicates by it go, also across runs
    (within the watermark if one is given, which bounds the state)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.load(source)
    if watermark:
        rows = rows.withWatermark(*watermark)
    if key:
        rows = rows.dropDuplicatesWithinWatermark([key]) if watermark else rows.dropDuplicates([key])
    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_into(path: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A batch function that upserts into a Parquet folder; each batch writes a new version and then points to it."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        fs_path = jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
        done = sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
        earlier = [v for v in done if v < epoch]  # a repeated batch starts from the same version again
        new = batch.dropDuplicates([key])
        out = upsert(spark.read.parquet(f"{path}/v={earlier[-1]}"), new, key) if earlier else new
        out.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return each


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that merge_into completed."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/v={max(done)}")
