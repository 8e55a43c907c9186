"""Reconciliation between runs: upserts, merges, overrides, first and best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas.functions.timefn import col
from slotatlas.operators.cleaning import looks_valid


def replace_by_key(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All old rows of an owner give way when there are new rows for it."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def demote(old: DataFrame, attempted: DataFrame, new: DataFrame, owner: str, today: str) -> DataFrame:
    """Attempted owners without new rows keep theirs, unverified and with fresh marks.

    ``attempted``: (owner, url), one row per owner.
    """
    failed = attempted.join(new.select(owner).distinct(), owner, "left_anti").withColumn("_failed", F.lit(True))
    failed = failed.withColumnRenamed("url", "_url")
    hit = F.coalesce(F.col("_failed"), F.lit(False))
    return old.join(failed, owner, "left").withColumns({
        "verified": F.when(hit, F.lit(False)).otherwise(F.col("verified")),
        "last_checked": F.when(hit, F.lit(today)).otherwise(F.col("last_checked")),
        "source": F.when(hit & (F.coalesce("_url", F.lit("")) != ""), F.col("_url")).otherwise(F.col("source")),
    }).drop("_failed", "_url")


def promote_valid(old: DataFrame) -> DataFrame:
    """Unverified rows that look valid become verified; the method is recorded."""
    shape = ~F.col("verified") & looks_valid()
    return old.withColumns({
        "verification_method": F.when(shape, F.lit("shape")).when(F.col("verified"), F.lit("crawl")),
        "verified": F.col("verified") | shape})


def keep_by(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the order. Combines map-side, so a
    hot key never travels row by row; ``order`` should be unique within a key."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return keep_by(df, keys, order)


def last_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Union of sources; on a key the later source overrides."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s)
    return keep_by(out, [key], [F.col("_rank")], last=True).drop("_rank")


def merge_struct(old: DataFrame, new: DataFrame, key: str, fields: list[str], today: str) -> DataFrame:
    """Field-wise: a new value overrides, else the old one stays with its own check date.

    ``old`` brings ``<field>_checked``; a new value sets it to ``today``.
    """
    n = new.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields])
    j = old.join(n, key, "full")
    return j.select(
        key, *[F.coalesce(f"_n_{f}", f).alias(f) for f in fields],
        *[F.when(F.col(f"_n_{f}").isNotNull(), F.lit(today)).otherwise(F.col(f"{f}_checked")).alias(f"{f}_checked")
          for f in fields])


def update_by_key(df: DataFrame, updates: DataFrame, key: str, target: str, status: str) -> DataFrame:
    """Point update of one struct by key; rows without an update stay as they are."""
    u = updates.select(key, F.col(target).alias("_new"), F.lit(True).alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return df.join(u, key, "left").withColumns({
        target: F.when(hit, F.col("_new")).otherwise(F.col(target)),
        "status": F.when(hit, F.lit(status)).otherwise(F.col("status"))}).drop("_new", "_hit")


def unknown_updates(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates whose key is unknown: they change nothing and are reported."""
    return updates.join(df.select(key), key, "left_anti")


def except_stale(published: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Published rows that are no longer produced."""
    return published.join(produced.select(*keys), keys, "left_anti")


def merge_meta(meta, new_status, website, schedule_url, price_source, now, booking_links=None) -> Column:
    """Provenance: new values where present, previous ones elsewhere.

    With ``booking_links`` (an array; null or empty: nothing found) the previous provenance holds some too.
    """
    m = col(meta)
    links = []
    if booking_links is not None:
        found = F.when(F.size(col(booking_links)) > 0, col(booking_links))
        links = [F.coalesce(found, m["booking_links"], F.array()).alias("booking_links")]
    old_urls = F.coalesce(m["source_urls"], F.create_map().cast("map<string,string>"))
    fresh = F.map_filter(
        F.create_map(F.lit("website"), F.coalesce(col(website), F.lit("")),
                     F.lit("schedule"), F.coalesce(col(schedule_url), F.lit("")),
                     F.lit("pricing"), F.coalesce(col(price_source), F.lit(""))),
        lambda k, v: v != "")
    kept = F.map_filter(old_urls, lambda k, v: ~F.map_contains_key(fresh, k))
    return F.struct(
        F.coalesce(col(new_status), m["scrape_status"], F.lit("no_data")).alias("scrape_status"),
        col(now).alias("last_scraped"),
        F.when(col(price_source).isNotNull(), col(now)).otherwise(m["last_price_check"]).alias("last_price_check"),
        *links,
        F.map_concat(kept, fresh).alias("source_urls"))


def stamp_provenance(rows: DataFrame, lookup: DataFrame, key: str, today: str) -> DataFrame:
    """Source, verified and last_checked on every row from a (key, url) lookup."""
    url = F.nullif(F.coalesce("url", F.lit("")), F.lit(""))
    return rows.drop("source").join(lookup, key, "left").withColumns({
        "source": url, "verified": url.isNotNull(), "last_checked": F.lit(today)}).drop("url")
