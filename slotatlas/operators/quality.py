"""Data-quality rules: fused evaluation into one findings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.functions.text import int_if_whole
from slotatlas.functions.timefn import minutes
from slotatlas.operators import facets


@dataclass
class Rule:
    """A condition on a row and the finding it yields."""

    type: str
    severity: str
    cond: Column
    field: str
    value: Column
    expected: str = ""
    message: str = ""
    source: Column | None = None


def run_rules(df: DataFrame, rules: list[Rule], ids: dict[str, Column]) -> DataFrame:
    """All rules over a table in one narrow pass.

    Each rule adds one nullable struct; only the structs that fired unfold, so
    clean rows cost no output and nothing is shuffled.
    """
    def finding(r: Rule) -> Column:
        return F.when(F.coalesce(r.cond, F.lit(False)), F.struct(
            F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"), F.lit(r.field).alias("field"),
            r.value.cast("string").alias("value"), F.lit(r.expected).alias("expected_range"),
            F.lit(r.message or r.type.replace("_", " ")).alias("message"),
            F.coalesce(F.lit("") if r.source is None else r.source.cast("string"), F.lit("")).alias("source")))

    fired = F.filter(F.array(*[finding(r) for r in rules]), lambda x: x.isNotNull())
    return df.select(*[c.alias(k) for k, c in ids.items()], F.inline(fired))


def name_entities(findings: DataFrame, entities: DataFrame, name: str = "name", part: str = "part") -> DataFrame:
    """Findings with ``entity_name`` and ``part`` of their entity; null where no entity has the id.

    Only findings travel with the two columns; ``entities`` needs a unique ``id``.
    """
    known = entities.select(F.col("id").cast("string").alias("entity_id"), F.col(name).alias("entity_name"), F.col(part).alias("part"))
    return findings.join(known, "entity_id", "left")


def summarize(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("n_findings"))


def two_decimals(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def range_rules(bounds=R.PRICE_RANGES, source: Column | None = None) -> list[Rule]:
    return [Rule("price_out_of_range", "medium", ~F.col(f).between(lo, hi), f"pricing.{f}", int_if_whole(f),
                 f"{lo}-{hi}", source=source) for f, (lo, hi) in bounds.items()]


def ratio_rule(field: str, bounds: tuple, source: Column | None = None) -> Rule:
    ratio = F.col(field) / F.col("single")
    lo, hi = bounds
    cond = (F.col("single") > 0) & (F.col(field) != 0) & ~ratio.between(lo, hi)
    return Rule("price_ratio_unusual", "medium", cond, f"pricing.{field} / pricing.single",
                int_if_whole(two_decimals(ratio)), f"{lo}-{hi}x", source=source)


def order_rule(source: Column | None = None) -> Rule:
    return Rule("trial_exceeds_single", "medium", F.col("trial") > F.col("single"),
                "pricing.trial vs pricing.single", int_if_whole("trial"), "<= single", source=source)


def place_rules(price_source: Column | None = None) -> dict[str, list[Rule]]:
    """Rules of the catalog; all but the price rules look at active places only. ``price_source`` tells where prices are from."""
    active = facets.is_active()
    empty = [F.coalesce(F.col(c), F.lit("")) == "" for c in ("website", "phone", "email")]
    no_city = ~F.exists("addresses", lambda a: F.coalesce(a["city"], F.lit("")) != "")
    outside = ~F.col("lat").between(*R.LAT_BOUNDS) | ~F.col("lng").between(*R.LNG_BOUNDS)
    bad_url = (F.coalesce("website", F.lit("")) != "") & ~F.startswith("website", F.lit("http"))
    return {
        "dq_range": range_rules(source=price_source),
        "dq_ratio_card10": [ratio_rule("card_10", R.RATIO_CARD10, price_source)],
        "dq_ratio_monthly": [ratio_rule("monthly", R.RATIO_MONTHLY, price_source)],
        "dq_order": [order_rule(price_source)],
        "dq_missing_name": [Rule("missing_name", "high", active & (F.trim(F.coalesce("name", F.lit(""))) == ""),
                                 "name", F.col("name"))],
        "dq_no_contact": [Rule("no_contact_info", "medium", active & empty[0] & empty[1] & empty[2],
                               "website/phone/email", F.lit("all empty"))],
        "dq_no_address": [Rule("missing_address", "medium", active & no_city, "addresses", F.size("addresses"))],
        "dq_no_tags": [Rule("no_styles", "low", active & (F.size("styles") == 0), "styles", F.lit(0))],
        "dq_out_of_bounds": [Rule("coordinates_outside", "high", active & outside, "lat/lng",
                                  F.concat_ws(", ", F.col("lat").cast("string"), F.col("lng").cast("decimal(9,5)").cast("string")))],
        "dq_bad_url": [Rule("invalid_url", "low", active & bad_url, "website", F.col("website"))],
    }


def slot_guards() -> tuple[Column, Column, Column]:
    """Guard columns over :func:`with_clocks`: start, end, and whether both parse."""
    start, end = F.col("_start"), F.col("_end")
    parsed = start.isNotNull() & end.isNotNull()
    return start, end, parsed


def with_clocks(slots: DataFrame) -> DataFrame:
    """Start and end in minutes, parsed once for all rules."""
    return slots.withColumns({"_start": minutes("time_start"), "_end": minutes("time_end")})


def slot_rules() -> dict[str, list[Rule]]:
    """Rules of the slots. A bad clock ends the checks of a row, and so does a
    wrong order; the guards say so."""
    start, end, parsed = slot_guards()
    hour = F.floor(start / 60)
    length = end - start
    return {
        "dq_bad_day": [Rule("invalid_day", "high", ~F.coalesce("day", F.lit("")).isin(R.DAYS), "day", F.col("day"))],
        "dq_bad_time": [
            Rule("invalid_time", "medium", start.isNull(), "time_start", F.col("time_start")),
            Rule("invalid_time", "medium", start.isNotNull() & end.isNull(), "time_end", F.col("time_end"))],
        "dq_unusual_hour": [Rule("unusual_class_time", "low", parsed & ((hour < R.MIN_HOUR) | (hour >= R.MAX_HOUR)),
                                 "time_start", F.col("time_start"), f"{R.MIN_HOUR:02d}:00-{R.MAX_HOUR:02d}:00")],
        "dq_end_before_start": [Rule("end_before_start", "high", parsed & (end <= start), "time_end",
                                     F.concat_ws("-", "time_start", "time_end"))],
        "dq_unusual_duration": [Rule("unusual_duration", "medium",
                                     parsed & (length > 0) & ((length < R.MIN_DURATION) | (length > R.MAX_DURATION)),
                                     "duration", F.concat(length.cast("string"), F.lit(" min")),
                                     f"{R.MIN_DURATION}-{R.MAX_DURATION}")],
    }


def orphan_findings(slots: DataFrame, parents: DataFrame, key: str, count_all: bool = False) -> DataFrame:
    """One finding per owner that is unknown, with its slots counted.

    Only slots that passed the clock guards count, unless ``count_all``.
    """
    start, end, parsed = slot_guards()
    rows = slots if count_all else with_clocks(slots).filter(F.coalesce(parsed & (end > start), F.lit(False)))
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    missing = counts.join(parents.select(F.col("id").alias(key)), key, "left_anti")
    rule = Rule("orphan_slot", "high", F.lit(True), "place_id", F.col("n"))
    return run_rules(missing, [rule], {"entity_id": F.col(key).cast("string")})


def duplicate_findings(groups: DataFrame, rule_type: str, severity: str, field: str, ident: str, value: str) -> DataFrame:
    """One finding per group of duplicates (see ``stats.duplicates``); columns ``part`` and ``first_name`` name its lowest member."""
    rule = Rule(rule_type, severity, F.lit(True), field, F.concat(F.col(value), F.lit(" x"), F.col("n_members").cast("string")))
    named = {k: F.col(c) for k, c in (("entity_name", "first_name"), ("part", "part")) if c in groups.columns}
    return run_rules(groups, [rule], {"entity_id": F.col(ident).cast("string"), **named})
