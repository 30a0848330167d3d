"""Writing: deterministic and partitioned tables, write-once outputs, reports, resumable work lists, databases."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.expr import fingerprint


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-independent hash: the sum of row hashes, combined without gathering rows in one place."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n_rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(row).alias("hash_xor"))


def write_sorted(df: DataFrame, path: str, keys: list[str], files: int | None = None) -> None:
    """A table in key order across its files (range partitions, each sorted), zstd; the same rows give the same order."""
    out = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    out.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], salt_rows: int = 2_000_000) -> None:
    """Hive-style partitions. Rows are dealt by partition and a salt, so a partition with most rows is written by many tasks."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    salted.repartition(*by, "__salt").drop("__salt").write.mode("overwrite").option("maxRecordsPerFile", salt_rows).partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int = 32) -> None:
    """A table bucketed and sorted by key: later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_once(df: DataFrame, path: str) -> bool:
    """Write where nothing is; equal contents that are there already are left alone (False), others are an error."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("errorifexists").parquet(path)
        return True
    if table_fingerprint(spark.read.parquet(path)).first() != table_fingerprint(df).first():
        raise ValueError(f"{path} holds something else")
    return False


def write_report(value, path: str) -> None:
    """A small JSON report with sorted keys, replaced in one step; NaN is refused."""
    text = json.dumps(value, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False) + "\n"
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)


def canonical_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON with its keys in order; NULLs are left out."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias(name))


def write_jsonl(df: DataFrame, path: str) -> None:
    canonical_json(df, "value").write.mode("overwrite").text(path)


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of a work list is not finished: resumable without repeating terminal outcomes."""
    return plan.join(done.where("status IN ('OK', 'EMPTY', 'CLIENT_ERROR')").select(*keys).distinct(), keys, "left_anti")


def write_jdbc(df: DataFrame, url: str, table: str, key: str, **options) -> None:
    """Bulk load into a staging table; `key` is the release's fingerprint column, by which a repeated load is told."""
    df.where(F.col(key).isNotNull()).write.format("jdbc").option("url", url).option("dbtable", f"{table}_staging").option("batchsize", 10_000).options(**options).mode("overwrite").save()


def json_schema(df: DataFrame) -> str:
    return df.schema.json()


__all__ = ["canonical_json", "fingerprint", "json_schema", "pending", "table_fingerprint", "write_bucketed", "write_jdbc", "write_jsonl", "write_once", "write_partitioned", "write_report", "write_sorted"]
