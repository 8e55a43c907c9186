"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotatlas.session import run_dir

#: White space that parts words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words between white space; no word for null, empty or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES_RE), lambda w: w != "")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and safe when executors are lost."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Bind a value once where a lambda uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
