"""Helpers shared by the training-data operators: scratch tables, splits, prefix sums."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; cuts lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._siltstone_path = path
    return out


SMALL_ROWS = 500_000  # narrow rows of a file


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as few partitions as ``rows`` narrow rows (ids, labels) need, so that rounds over a shrinking graph write no crowds of tiny files."""
    return df.coalesce(max(1, -(-rows // SMALL_ROWS)))


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_siltstone_path", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables and files of these operators; results not yet read are lost."""
    delete_path(spark, f"{shared_dir(spark)}/siltstone")


_HELD: dict = {}


def worker_memo(key, make: Callable, full: Callable | None = None):
    """The one memo that a Python worker keeps from task to task.

    Workers outlive tasks and serve operator after operator: who asks with another ``key``, or
    finds its own memo ``full``, drops what is held, so memos of several operators never add up.
    """
    if key not in _HELD or (full and full(_HELD[key])):
        drop_memo()
        _HELD[key] = make()
    return _HELD[key]


def drop_memo() -> None:
    """For tasks that need no memo, as the worker may hold one of an operator before."""
    _HELD.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Return freed pages, Arrow's and the allocator's, to the system; both keep them otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


PART_ROWS = 2000
PART_BYTES = 2 << 20


def sliced(batch: pa.RecordBatch, text: int | str = "text", rows: int = PART_ROWS, size: int = PART_BYTES):
    """Parts of at most ``rows`` rows and ``size`` bytes of text; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        most = size + (int(ends[at - 1]) if at else 0)
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def held_out(doc_id):
    """Rows whose crc32(doc_id as text) mod 3 is 1; false for a null doc_id."""
    return F.coalesce((F.crc32(doc_id.cast("string")) % 3) == 1, F.lit(False))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken) -> str:
    """A column name that does not clash, without regard to case, with those taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def running_total(
    df: DataFrame, keys: list, bucket: str, order: list, value: str, out: str, source: DataFrame | None = None
) -> DataFrame:
    """Exclusive prefix sum of ``value`` within ``keys`` in (bucket, order) sequence.

    ``bucket`` (not null) must be monotone in the wanted order. Only bucket totals meet per key; rows
    meet per (key, bucket), so one key may hold most of the table without
    making one task read it all. ``source``: a cheaper table with the same keys, buckets and values.
    """
    total, base = fresh("bucket_total", df.columns), fresh("bucket_base", df.columns)
    sums = (df if source is None else source).groupBy(*keys, bucket).agg(F.sum(value).alias(total))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = sums.select(
        *[F.col(k).alias(f"{k}__b") for k in keys],
        F.col(bucket).alias(f"{bucket}__b"),
        F.coalesce(
            F.sum(total).over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias(base),
    )
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = fresh("bucket_within", df.columns)
    rows = df.withColumn(within, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    cond = F.col(bucket) == F.col(f"{bucket}__b")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}__b"))
    return (
        rows.join(sums, cond, "left")
        .withColumn(out, F.col(base) + F.col(within))
        .drop(base, within, f"{bucket}__b", *[f"{k}__b" for k in keys])
    )
