"""Ordered work per entity and inside one text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas.functions.timefn import col
from slotatlas.operators import segmented
from slotatlas.operators.reconcile import keep_by


def until_miss_streak(df: DataFrame, keys: list[str], order: list[str], chunk: str, failed: Column,
                      limit: int = 6) -> DataFrame:
    """Attempts that were made before giving up.

    A success resets the count; the attempt that completes ``limit`` failures
    in a row is the last one of the entity. A missing outcome is a failure.
    """
    return segmented.until_streak(df, keys, order, chunk, F.coalesce(failed, F.lit(True)), limit)


def first_success(df: DataFrame, keys: list[str], order: list[Column], success: Column) -> DataFrame:
    """First attempt per entity that has a result."""
    return keep_by(df.filter(success), keys, order)


def best_attempt(df: DataFrame, keys: list[str], has_main: Column, n_fields: Column, pos: str) -> DataFrame:
    """Candidates with the main price first, then the fuller one; ties keep the earlier."""
    return keep_by(df, keys, [-has_main.cast("int"), -n_fields, F.col(pos)])


def line_rows(df: DataFrame, text: str, keep: Callable[[Column], Column], columns: Callable,
              keys: list[str]) -> DataFrame:
    """Rows for the kept lines of a text, with columns made from the whole line array.

    ``columns(lines, i)`` returns named Columns. Neighbours come from the array
    inside the row and only kept lines are unfolded, so nothing is shuffled and
    no text is repeated per line.
    """
    lines = F.col("_lines")
    made = F.transform(lines, lambda x, i: F.when(keep(x), F.struct(i.alias("pos"), *columns(lines, i))))
    split = df.select(*keys, F.split(F.col(text), "\n").alias("_lines"))
    return split.select(*keys, F.inline(F.filter(made, lambda r: r.isNotNull())))


def context(lines: Column, i: Column, around: int = 2) -> Column:
    """The line and its neighbours, joined by a blank."""
    first = F.greatest(i - around, F.lit(0))
    return F.array_join(F.slice(lines, first + 1, i + around - first + 1), " ")


def neighbor_fallback(lines: Column, i: Column, own: Column, usable: Callable[[Column], Column],
                      second_longest: int | None = None) -> tuple[Column, Column]:
    """Name: own text, else the previous line, else the next one. Second: the next line (shorter than
    ``second_longest``, if given), unless it is the name."""
    before = F.when(i > 0, F.get(lines, i - 1))
    after = F.get(lines, i + 1)
    name = F.coalesce(own, F.when(usable(before), before), F.when(usable(after), after))
    short = F.length(after) < second_longest if second_longest else F.lit(True)
    second = F.when(usable(after) & short & (after != name), after)
    return name, second


def debounced(df: DataFrame, keys: list[str], ts: str, tie: str, chunk: str, seconds: float) -> DataFrame:
    """Last row of each burst: the next row of the key comes later than ``seconds``."""
    nxt = segmented.lead(df, keys, [ts, tie], chunk, {ts: "_next"})
    gap = F.col("_next").cast("timestamp").cast("double") - col(ts).cast("timestamp").cast("double")
    return nxt.filter(F.col("_next").isNull() | (gap > seconds)).drop("_next")
