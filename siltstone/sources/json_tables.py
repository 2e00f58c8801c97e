"""Tables kept as one JSON file per key: scans, optional scans, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All objects (or arrays of objects) of a folder, with ``item_key`` from the file name; broken files are left to :func:`broken_items`."""
    corrupt = "_corrupt_record"
    rows = spark.read.schema(f"{schema}, {corrupt} string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumn("item_key", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    return rows.filter(F.col(corrupt).isNull()).drop(corrupt)


def broken_items(spark: SparkSession, path: str) -> DataFrame:
    """Failure rows (table, id, check, detail) of the files that hold no JSON."""
    rows = spark.read.text(path, wholetext=True)
    key = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    rows = rows.select(F.lit("items").alias("table"), key.alias("id"), F.lit("unreadable").alias("check"), F.substring("value", 1, 120).alias("detail"), F.try_parse_json("value").isNull().alias("broken"))
    return rows.filter("broken").drop("broken")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Like :func:`read_items`; a missing folder is an empty table."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, item_key string")
    return read_items(spark, path, schema)


def item_keys(*tables: DataFrame) -> DataFrame:
    """Distinct keys over several tables."""
    out = tables[0].select("item_key")
    for t in tables[1:]:
        out = out.unionByName(t.select("item_key"))
    return out.distinct()


def optional_join(left: DataFrame, right: DataFrame, key: str, arrays: list[str] = ()) -> DataFrame:
    """Left join; named array columns without a partner become empty."""
    out = left.join(right, key, "left")
    kinds = dict(right.dtypes)
    return out.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in arrays})


def write_items(rows: DataFrame, path: str, key: str = "id") -> None:
    """JSON under one folder per key; null fields are left out."""
    rows.withColumn("item_key", F.col(key)).write.mode("overwrite").partitionBy("item_key").json(path)


def write_twice(rows: DataFrame, first: str, second: str) -> None:
    """One computed result to two places."""
    rows = rows.persist()
    try:
        for path in (first, second):
            rows.coalesce(1).write.mode("overwrite").json(path)
    finally:
        rows.unpersist()


def demo_items(spark: SparkSession) -> DataFrame:
    """Two literal rows for trying things out."""
    rows = [("demo-1", "demo", "First demo episode", "2024-01-01T00:00:00.000Z"), ("demo-2", "demo", "Second demo episode", "2024-01-02T00:00:00.000Z")]
    return spark.createDataFrame(rows, "id string, sourceId string, title string, publishedAt string")
