"""Ranks, top-n per group, custom orders and nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotatlas.functions import geo
from slotatlas.functions.timefn import col
from slotatlas.operators.segmented import join_groups
from slotatlas.session import reliable_checkpoint

_PART_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def status_rank(column, order: list[str]) -> Column:
    """Position in a custom order; unknown values come last."""
    pos = F.array_position(F.array(*[F.lit(s) for s in order]), col(column))
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(order)))


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group. Spark limits each group before the shuffle (``row_number <= n``)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n if n else F.lit(True))


def distributed_rank(df: DataFrame, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """1-based rank within groups of any size.

    A range sort by (group, order) spreads even one huge group over many
    partitions. Row positions and one count per (group, partition) give the
    rank. The sorted rows are checkpointed to the shared folder, so both uses
    see the same partitions. ``order`` must be unique within a group.
    """
    cols = df.columns
    rows = reliable_checkpoint(
        df.sort(*group, *order).withColumn("_seq", F.monotonically_increasing_id()))
    rows = rows.withColumn("_slice", F.shiftright("_seq", _PART_BITS))
    counts = rows.groupBy(*group, "_slice").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_slice", "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = join_groups(rows, offsets, [*group, "_slice"])
    return joined.select(*cols, (F.col("_offset") + F.col("_seq") - F.col("_first") + 1).alias(out))


def nearest(df: DataFrame, lat0: float, lng0: float, k: int | None = None, mode: str = "haversine",
            key: str = "id") -> DataFrame:
    """Rows by distance from a point, rounded to 0.1 km; rows without coordinates drop out."""
    fn = geo.planar_km if mode == "planar" else geo.haversine_km
    usable = df.filter((F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lng", F.lit(0.0)) != 0))
    out = usable.withColumn("_km", fn("lat", "lng", F.lit(lat0), F.lit(lng0))).orderBy("_km", key)
    out = out.limit(k) if k else out
    return out.withColumn("km", F.floor(F.col("_km") * 10 + 0.5) / 10).drop("_km")


def priority_fill(df: DataFrame, part: str, priority: list[str], tie: list[str], n: int) -> DataFrame:
    """Up to n rows: partitions in priority order, the rest alphabetically."""
    return df.orderBy(status_rank(part, priority), part, *tie).limit(n)
