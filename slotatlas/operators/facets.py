"""Facet search: predicates, the combined query and its sort orders."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas.functions.text import any_contains
from slotatlas.functions.timefn import col, day_index, minutes
from slotatlas.rules import FEATURE_PATTERNS


def is_active(flag="active") -> Column:
    """Missing means active; only an explicit false is not."""
    return F.coalesce(col(flag), F.lit(True))


def search_text(scalars, arrays, addresses) -> Column:
    """All searchable fields joined by a blank, in lower case."""
    places = F.transform(col(addresses), lambda a: F.concat_ws(" ", a["street"], a["zip"], a["city"]))
    return F.lower(F.concat_ws(" ", *[col(c) for c in scalars], *[col(a) for a in arrays], places))


def matches_search(q: str, scalars=("name", "description"), arrays=("styles", "features", "languages"),
                   addresses="addresses") -> Column:
    return F.contains(search_text(scalars, arrays, addresses), F.lit(q.lower()))


def any_zip(addresses, zip_code: str) -> Column:
    return F.exists(col(addresses), lambda a: F.trim(a["zip"]) == zip_code)


def has_feature(name: str | None) -> Column:
    """Named predicate; an unknown name lets every row pass."""
    if name == "drop_in":
        return F.coalesce(F.col("drop_in"), F.lit(False))
    if name == "english":
        return F.array_contains("languages", "English")
    if name in FEATURE_PATTERNS:
        where, pattern = FEATURE_PATTERNS[name]
        text = F.array_join("features", " ")
        if where == "tags+features":
            text = F.concat(F.array_join("styles", " "), F.lit(" "), text)
        return text.rlike(f"(?i){pattern}")
    return F.lit(True)


@dataclass
class FacetQuery:
    """The filters a visitor can combine; every unset one passes."""

    q: str | None = None
    tag: str | None = None
    tag_option: str | None = None
    zip_code: str | None = None
    feature: str | None = None
    part: str | None = None
    sort: str = "name"
    limit: int | None = None


def predicates(query: FacetQuery) -> list[Column]:
    conds = [is_active()]
    if query.part:
        conds.append(F.col("part") == query.part)
    if query.q:
        conds.append(matches_search(query.q))
    for term in (query.tag, query.tag_option):
        if term and term != "all":
            conds.append(any_contains("styles", term))
    if query.zip_code:
        conds.append(any_zip("addresses", query.zip_code))
    if query.feature:
        conds.append(has_feature(query.feature))
    return conds


def sort_columns(order: str) -> list[Column]:
    """Sort orders with a unique tie-break, so that results repeat."""
    if order == "size":
        return [F.size("styles").desc(), F.col("name"), F.col("id")]
    if order == "zip":
        return [F.get(F.col("addresses"), F.lit(0))["zip"].asc_nulls_last(), F.col("name"), F.col("id")]
    return [F.collate("name", "UNICODE"), F.col("id")]


def facet_query(places: DataFrame, query: FacetQuery, favorites: DataFrame | None = None) -> DataFrame:
    """Filter, optional semi join with a favorites table, sort, optional limit."""
    out = places.filter(reduce(lambda a, b: a & b, predicates(query)))
    if favorites is not None:
        out = out.join(favorites, "id", "left_semi")
    out = out.orderBy(*sort_columns(query.sort))
    return out.limit(query.limit) if query.limit else out


def facet_options(places: DataFrame) -> DataFrame:
    """zip -> city of its first address, for partitions with more than one zip."""
    addr = places.select("part", "id", F.posexplode("addresses").alias("pos", "a")) \
        .select("part", F.trim("a.zip").alias("zip"), F.struct("id", "pos").alias("ord"), F.col("a.city").alias("city")) \
        .filter("zip <> ''")
    options = addr.groupBy("part", "zip").agg(F.min_by("city", "ord").alias("city"))
    counts = options.groupBy("part").agg(F.count("*").alias("n_options")).filter("n_options > 1")
    return options.join(counts, "part")


def schedule_day(slots: DataFrame, day: str, places: DataFrame | None = None, tag: str | None = None,
                 q: str | None = None) -> DataFrame:
    """Slots of a day. The place set restricts only when the caller passes one."""
    out = slots.filter(F.col("day") == day)
    if tag:
        out = out.filter(F.contains(F.lower("class_name"), F.lit(tag.lower())))
    if q:
        hay = F.lower(F.concat_ws(" ", "class_name", "place_name", "teacher", "level"))
        out = out.filter(F.contains(hay, F.lit(q.lower())))
    if places is not None:
        out = out.join(places.select(F.col("id").alias("place_id")), "place_id", "left_semi")
    return out.orderBy(minutes("time_start").asc_nulls_last(), "class_id")


def week_order() -> list[Column]:
    """Monday to Sunday, then clock; unknown days and times last."""
    return [day_index("day"), minutes("time_start").asc_nulls_last(), F.col("class_id")]


def price_comparable() -> Column:
    return is_active() & F.coalesce(F.col("verified"), F.lit(False)) & (F.coalesce(F.col("single"), F.lit(0.0)) != 0)
