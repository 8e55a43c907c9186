"""Ordered operators that stay exact when one key holds a third of the rows.

A plain window by key puts all rows of a hot key into one task. Here the rows
of a key are cut into chunks along the order (a day, an hour, …): windows run
per (key, chunk), a map-side combined summary of one row per (key, chunk)
carries the state across chunks, and both meet in an equi-join on
(key, chunk). The largest task then holds one chunk, not one key.

``chunk`` must grow with ``order``: rows of an earlier chunk come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the group of the keys. Nulls form a group like in a window or a
    ``groupBy``; a struct key compares them as equal and is still hashed."""
    return left.withColumn("_key", F.struct(*keys)).join(
        right.withColumn("_key", F.struct(*keys)).drop(*keys), "_key", how).drop("_key")


def _keyed(df: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    return df.withColumn("_key", F.struct(*keys, chunk))


def _local(order: list[str]):
    return Window.partitionBy("_key").orderBy(*order)


def _chunks(keys: list[str], chunk: str):
    return Window.partitionBy(*[F.col(f"_key.{k}") for k in keys]).orderBy(F.col(f"_key.{chunk}"))


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def carry_forward(df: DataFrame, keys: list[str], order: list[str], chunk: str, value: Column,
                  out: str) -> DataFrame:
    """Last non-null ``value`` up to and including the row."""
    src = _keyed(df.withColumn("_v", value), keys, chunk)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    summary = src.groupBy("_key").agg(last.alias("_last")).select(
        "_key", F.last("_last", ignorenulls=True).over(_before(_chunks(keys, chunk))).alias("_carry"))
    near = F.last("_v", ignorenulls=True).over(_upto(_local(order)))
    return src.join(summary, "_key", "left").withColumn(out, F.coalesce(near, F.col("_carry"))) \
        .drop("_v", "_carry", "_key")


def lag(df: DataFrame, keys: list[str], order: list[str], chunk: str, columns: dict[str, str]) -> DataFrame:
    """Values of the previous row of the key, ``{column: new name}``."""
    return _shift(df, keys, order, chunk, columns, back=True)


def lead(df: DataFrame, keys: list[str], order: list[str], chunk: str, columns: dict[str, str]) -> DataFrame:
    """Values of the next row of the key, ``{column: new name}``."""
    return _shift(df, keys, order, chunk, columns, back=False)


def _shift(df, keys, order, chunk, columns, back):
    src, row = _keyed(df, keys, chunk), F.struct(*columns)
    edge = F.max_by(row, F.struct(*order)) if back else F.min_by(row, F.struct(*order))
    step = F.lag if back else F.lead
    summary = src.groupBy("_key").agg(edge.alias("_edge")).select(
        "_key", step("_edge").over(_chunks(keys, chunk)).alias("_carry"))
    out = src.join(summary, "_key", "left").withColumn("_row", F.coalesce(step(row).over(_local(order)), F.col("_carry")))
    return out.select(*df.columns, *[F.col("_row")[c].alias(n) for c, n in columns.items()])


def running_sum(df: DataFrame, keys: list[str], order: list[str], chunk: str, value: Column,
                out: str) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including the row."""
    src = _keyed(df.withColumn("_v", value), keys, chunk)
    summary = src.groupBy("_key").agg(F.sum("_v").alias("_sum")).select(
        "_key", F.coalesce(F.sum("_sum").over(_before(_chunks(keys, chunk))), F.lit(0)).alias("_carry"))
    return src.join(summary, "_key", "left") \
        .withColumn(out, F.sum("_v").over(_upto(_local(order))) + F.col("_carry")).drop("_v", "_carry", "_key")


def until_streak(df: DataFrame, keys: list[str], order: list[str], chunk: str, hit: Column, limit: int) -> DataFrame:
    """Rows of a key up to the one that completes ``limit`` hits in a row.

    A chunk is summed up by its length, the hits at its head, its last row without a hit and the first place where a
    run is complete inside. Summaries combine along the chunks: hits that are open at a border are the rows since the
    last row without one, so one window over summaries tells where a run that crosses borders ends.
    """
    near, chunks = _local(order), _chunks(keys, chunk)
    src = _keyed(df.withColumn("_hit", hit), keys, chunk).withColumn("_rn", F.row_number().over(near))
    src = src.withColumn("_miss", F.coalesce(F.max(F.when(~F.col("_hit"), F.col("_rn"))).over(_upto(near)), F.lit(0)))
    run = F.col("_rn") - F.col("_miss")
    summary = src.groupBy("_key").agg(
        F.max("_rn").alias("_n"), F.nullif(F.max("_miss"), F.lit(0)).alias("_last_miss"),
        F.coalesce(F.max(F.when(F.col("_miss") == 0, F.col("_rn"))), F.lit(0)).alias("_head"),
        F.min(F.when(run >= limit, F.col("_rn"))).alias("_inside"))
    before = F.coalesce(F.sum("_n").over(_before(chunks)), F.lit(0))
    summary = summary.withColumn("_start", before).withColumn("_open", F.col("_start") - F.coalesce(
        F.last(F.col("_start") + F.col("_last_miss"), ignorenulls=True).over(_before(chunks)), F.lit(0)))
    missing = F.greatest(F.lit(limit) - F.col("_open"), F.lit(1))
    across = F.when((F.col("_open") > 0) & (F.col("_head") >= missing), missing)
    summary = summary.withColumn("_stop", F.least("_inside", across))
    ended = F.coalesce(F.max(F.col("_stop").isNotNull()).over(_before(chunks)), F.lit(False))
    stops = summary.select("_key", "_stop", ended.alias("_ended")).filter("NOT _ended")
    return src.join(stops, "_key").filter(F.col("_stop").isNull() | (F.col("_rn") <= F.col("_stop"))).select(*df.columns)
