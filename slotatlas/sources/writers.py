"""Sinks: partitioned tables, envelopes, snapshots, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotatlas.sources.readers import encode_payload


def write_partitioned(df: DataFrame, path: str, part: str, updated: str) -> None:
    """Table by partition; only the partitions present in ``df`` are replaced."""
    df.withColumn("last_updated", F.lit(updated)).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def envelopes(df: DataFrame, part: str, array_col: str, updated: str, key: str, per_doc: int = 500) -> DataFrame:
    """Envelope documents of about ``per_doc`` records each.

    A big partition becomes many documents, so none grows with the data.
    """
    counts = df.groupBy(part).agg(F.ceil(F.count("*") / per_doc).alias("_docs"))
    cols = [c for c in df.columns if c != part]
    return df.join(counts, part).groupBy(part, F.pmod(F.xxhash64(key), F.col("_docs")).alias("doc")).agg(
        F.collect_list(F.struct(*cols)).alias(array_col)).select(part, "doc", F.lit(updated).alias("last_updated"), array_col)


def encode_documents(df: DataFrame, columns: list[str], out: str = "e") -> DataFrame:
    """Each row's document as JSON, encoded."""
    return df.withColumn(out, encode_payload(F.to_json(F.struct(*columns))))


def write_snapshot(df: DataFrame, path: str, run_id: str) -> None:
    """Current values as the next run's previous ones: one folder per run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_snapshot(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The given run, or the latest one: partitions are pruned when the query runs, nothing runs before."""
    df = spark.read.option("basePath", path).parquet(path)
    latest = df.agg(F.max("run_id")).scalar() if run_id is None else F.lit(run_id)
    return df.filter(F.col("run_id") == latest)


def append_changes(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
