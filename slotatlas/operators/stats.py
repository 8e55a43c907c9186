"""Statistics per partition, tag, status and run. All aggregates combine map-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas.functions.price import round_half_up
from slotatlas.functions.timefn import col
from slotatlas.operators.segmented import join_groups


def partition_stats(places: DataFrame, slots: DataFrame, part: str = "part", key: str = "id") -> DataFrame:
    """Places, slots, distinct tags, drop-in count and lowest price per partition.

    Slots are counted per place first and join the slim counts; tags count in
    their own pass, because exploding them would multiply the other columns.
    """
    per_place = slots.groupBy("place_id").agg(F.count("*").alias("_slots"))
    base = places.select(key, part, "drop_in", "single") \
        .join(per_place, F.col(key) == F.col("place_id"), "left").groupBy(part).agg(
            F.count("*").alias("n_places"), F.sum(F.coalesce("_slots", F.lit(0))).alias("n_slots"),
            F.count_if("drop_in").alias("n_drop_in"), F.min("single").alias("min_single"))
    tags = places.select(part, F.explode("styles").alias("tag")).groupBy(part) \
        .agg(F.count_distinct("tag").alias("n_tags"))
    return base.join(tags, part, "left").fillna({"n_tags": 0})


def tag_histogram(df: DataFrame, tags: str, group: list[str] | None = None) -> DataFrame:
    return df.select(*(group or []), F.explode(tags).alias("tag")) \
        .groupBy(*(group or []), "tag").agg(F.count("*").alias("n"))


def distinct_sorted(df: DataFrame, group: str, values: dict[str, Column]) -> DataFrame:
    """Sorted distinct non-empty values per group, in one long column per kind.

    Rows, not one array per group: a group may have millions of values.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.filter(v, lambda x: F.trim(x) != "").alias("vals"))
                      for k, v in values.items()])
    rows = df.select(group, F.inline(kinds)).select(group, "kind", F.explode("vals").alias("value"))
    return rows.select(group, "kind", F.trim("value").alias("value")).distinct()


def price_span(df: DataFrame, part: str, price: str, below: float) -> DataFrame:
    ok = F.when((F.col(price) < below) & (F.col(price) != 0), F.col(price))
    return df.groupBy(part).agg(F.min(ok).alias("lo"), F.max(ok).alias("hi"))


def min_price(df: DataFrame, part: str, price: str) -> DataFrame:
    """Lowest positive price, rounded half up; null when there is none."""
    return df.groupBy(part).agg(
        round_half_up(F.min(F.when(F.col(price) > 0, F.col(price)))).cast("bigint").alias("min_price"))


def global_totals(places: DataFrame, slots: DataFrame, part: str = "part") -> DataFrame:
    """Active places and their slots: one row per partition and a total (part null)."""
    per_place = slots.groupBy("place_id").agg(F.count("*").alias("_n"), F.max("last_checked").alias("_last"))
    j = places.select(part, "id").join(per_place, F.col("id") == F.col("place_id"), "left")
    return j.rollup(part).agg(F.count("*").alias("n_places"), F.sum(F.coalesce("_n", F.lit(0))).alias("n_slots"),
                              F.max("_last").alias("last_updated"))


def duplicates(df: DataFrame, keys: list[str], member: str, named: list[str] | None = None, label: str | None = None) -> DataFrame:
    """Groups with more than one distinct member: how many, and the lowest one (``first_name``: its ``label``).

    Rows where one of the ``named`` keys (default: all) is null or blank belong to no group. The members are not
    collected; :func:`duplicate_members` lists them as rows.
    """
    for key in keys if named is None else named:
        df = df.filter(F.trim(F.col(key).cast("string")) != "")
    first = [] if label is None else [F.min_by(label, member).alias("first_name")]
    return df.groupBy(*keys).agg(F.count_distinct(member).alias("n_members"), F.min(member).alias("first_id"), *first) \
        .filter("n_members > 1")


def duplicate_members(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    return join_groups(df.select(*keys, member).distinct(), duplicates(df, keys, member).select(*keys, "n_members"), keys)


def status_pivot(df: DataFrame, part: str, status: str, values: list[str]) -> DataFrame:
    return df.groupBy(part).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def run_totals(df: DataFrame, part: str, success: Column, rows: Column) -> DataFrame:
    """success / fail / rows per partition."""
    return df.groupBy(part).agg(
        F.count_if(success).alias("success"), F.count_if(~success).alias("fail"),
        F.sum(F.when(success, rows).otherwise(F.lit(0))).cast("bigint").alias("new_rows"))


def method_histogram(df: DataFrame, method: str) -> DataFrame:
    return df.groupBy(F.split_part(col(method), F.lit(":"), F.lit(1)).alias("method")).agg(F.count("*").alias("n"))


def all_unverified(slots: DataFrame, owner: str) -> DataFrame:
    """All rows of owners that have no verified row. A semi join keeps the rows as rows."""
    owners = slots.groupBy(owner).agg(F.bool_or("verified").alias("_v")).filter("NOT _v")
    return slots.join(owners.select(owner), owner, "left_semi")


def children_by_parent(children: DataFrame, parent: str) -> DataFrame:
    return children.groupBy(parent).agg(
        F.count("*").alias("n_children"), F.count_if("verified").alias("n_verified"),
        F.min("day").alias("first_day"), F.max("last_checked").alias("last_checked"))


def issue_groups(df: DataFrame, issue: str) -> DataFrame:
    return df.groupBy(issue).agg(F.count("*").alias("n")).orderBy(F.desc("n"), issue)


def coverage(df: DataFrame, group: list[str], cond: Column) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("n_active"), F.count_if(cond).alias("n_priced")) \
        .withColumn("share", F.col("n_priced") / F.col("n_active"))


def metric_rows(parts: list[DataFrame]) -> DataFrame:
    """Single-row aggregates of several tables as (metric, value) rows."""
    long = [p.unpivot([], p.columns, "metric", "value") for p in parts]
    return reduce(lambda a, b: a.unionByName(b), long)


def weekly_pattern(df: DataFrame, owner: list[str], ts: str, name: str, keep: list[str], key: str) -> DataFrame:
    """Dated rows of several weeks folded to weekly slots; the first row seen is kept."""
    from slotatlas.functions.timefn import day_name
    slot = df.withColumns({"day": day_name(ts), "time_start": F.date_format(ts, "HH:mm"),
                           "_week": F.date_trunc("week", ts)})
    order = F.struct(ts, key)
    return slot.groupBy(*owner, "day", "time_start", name).agg(
        *[F.min_by(c, order).alias(c) for c in keep], F.count_distinct("_week").alias("n_weeks"))
