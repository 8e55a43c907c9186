"""Row gates: garbage slots, impossible prices, page classes, robots rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.functions.text import CAMEL_HUMP, GLUED_CLOCK
from slotatlas.functions.timefn import col, minutes


def is_garbage(name="class_name", start="time_start", end="time_end") -> Column:
    """End not after start, a clock glued to a letter, or a long camelCase name."""
    broken_name = col(name).rlike(rf"(?s){GLUED_CLOCK}|^(?=.{{41}}).*{CAMEL_HUMP}")
    return F.coalesce(minutes(end) <= minutes(start), F.lit(False)) | F.coalesce(broken_name, F.lit(False))


def null_impossible(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Null values outside their bounds and count how many a row lost (``n_nulled``)."""
    off = {f: F.coalesce(~F.col(f).between(lo, hi), F.lit(False)) for f, (lo, hi) in bounds.items()}
    count = reduce(lambda a, b: a + b, [c.cast("int") for c in off.values()])
    return df.withColumns({**{f: F.when(~c, F.col(f)) for f, c in off.items()}, "n_nulled": count})


def looks_valid() -> Column:
    """Plausible day, clock and name of an unverified slot."""
    name = F.coalesce(F.col("class_name"), F.lit(""))
    return (F.col("day").isin(R.DAYS) & F.coalesce(F.col("time_start"), F.lit("")).rlike(r"^\d{1,2}:\d{2}")
            & (F.trim(name) != "") & ~F.contains(name, F.lit("TBC")))


def page_signals(html) -> dict[str, Column]:
    """Distinct clock times, day words and topic words of a page."""
    def distinct(pattern, fold=True):
        hits = F.regexp_extract_all(col(html), F.lit(pattern), F.lit(0))
        if fold:
            hits = F.transform(hits, lambda x: F.lower(x))
        return F.size(F.array_distinct(hits))
    return {"n_times": distinct(R.TIME_WORD, False), "n_days": distinct("(?i)" + R.DAY_WORD),
            "n_topics": distinct("(?i)" + R.TOPIC_WORD)}


def page_class(url, http_status, n_times, n_days, n_topics) -> Column:
    """scrapable / dynamic / blocked / error / no_url."""
    rich = (col(n_times) >= 3) & ((col(n_days) >= 2) | (col(n_topics) >= 2))
    return (F.when(F.coalesce(F.trim(col(url)), F.lit("")) == "", F.lit("no_url"))
            .when(col(http_status) == 403, F.lit("blocked"))
            .when(col(http_status).isNull() | (col(http_status) >= 400), F.lit("error"))
            .when(rich, F.lit("scrapable")).otherwise(F.lit("dynamic")))


def robots_disallowed(robots: DataFrame, host="host", body="body") -> DataFrame:
    """Hosts whose ``user-agent: *`` group has the line ``disallow: /``.

    Groups are cut at user-agent lines inside the row, so nothing is shuffled.
    """
    groups = F.split(F.lower(F.col(body)), r"(?m)^\s*(?=user-agent:)")
    closed = F.exists(groups, lambda g: g.rlike(r"(?s)^user-agent: \*[ \t\r]*(?:\n.*)?$")
                      & g.rlike(r"(?m)^[ \t]*disallow: /[ \t\r]*$"))
    return robots.filter(closed).select(host)


def drop_blocked(df: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    return df.join(blocked, key, "left_anti")


def platform_any(platform, urls: list, name: str) -> Column:
    """Platform equals the name, or one of the urls contains it."""
    conds = [F.lower(F.coalesce(col(platform), F.lit(""))) == name.lower()]
    conds += [F.contains(F.lower(F.coalesce(col(u), F.lit(""))), F.lit(name.lower())) for u in urls]
    return reduce(lambda a, b: a | b, conds)
