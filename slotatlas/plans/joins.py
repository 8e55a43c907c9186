"""Joins over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.operators import facets, joins
from slotatlas.plans import sqltext as Q
from slotatlas.plans.registry import query
from slotatlas.plans.standins import (BASE_SQL, places, places_base, slots, table, with_base_slots,
                                      with_both, with_places)

ACTIVE = "coalesce(active, true)"


@query("jn_lookup_left", with_both(
    "SELECT class_id, place_id, p.name AS place_name, p.website, p.single FROM slots s LEFT JOIN places p "
    "ON p.id = s.place_id AND p.segment <> 'BUILDING'"))
def jn_lookup_left(spark, sf):
    p = places(spark, sf).filter("segment <> 'BUILDING'").select(
        F.col("id").alias("place_id"), F.col("name").alias("place_name"), "website", "single")
    return slots(spark, sf).select("class_id", "place_id").join(p, "place_id", "left")


@query("jn_orphans", with_base_slots(
    "SELECT place_id, level, count(*) AS n_children FROM slots WHERE place_id NOT IN "
    "(SELECT id FROM places WHERE segment <> 'BUILDING') GROUP BY place_id, level"))
def jn_orphans(spark, sf):
    parents = places_base(spark, sf).filter("segment <> 'BUILDING'").select(F.col("id").alias("place_id"))
    return joins.orphans(slots(spark, sf), parents, "place_id", ["level"])


@query("jn_semi_count", with_base_slots(
    f"SELECT part, count(*) AS n_children FROM slots JOIN places ON id = place_id WHERE {ACTIVE} GROUP BY part"))
def jn_semi_count(spark, sf):
    parents = places_base(spark, sf).filter(facets.is_active()).withColumnRenamed("id", "place_id")
    return joins.semi_count(slots(spark, sf), parents, "place_id", "part")


@query("jn_unscheduled", with_base_slots(
    f"SELECT id, name FROM places WHERE {ACTIVE} AND (schedule_url <> '' OR website <> '') AND id NOT IN "
    "(SELECT place_id FROM slots WHERE day = 'Monday')"))
def jn_unscheduled(spark, sf):
    shown = slots(spark, sf).filter("day = 'Monday'").select(F.col("place_id").alias("id"))
    p = places_base(spark, sf).filter(facets.is_active()).filter("schedule_url <> '' OR website <> ''")
    return joins.without_children(p, shown, "id").select("id", "name")


@query("jn_missing_children", with_base_slots(
    f"SELECT id, part FROM places WHERE {ACTIVE} AND id NOT IN (SELECT place_id FROM slots WHERE time_start <> '' AND level = 'beginner' AND verified)"))
def jn_missing_children(spark, sf):
    kids = slots(spark, sf).filter("time_start <> '' AND level = 'beginner' AND verified").select(F.col("place_id").alias("id"))
    return joins.without_children(places_base(spark, sf).filter(facets.is_active()), kids, "id").select("id", "part")


@query("jn_missing_price", with_places(
    f"SELECT id, coalesce(status = 'success' AND NOT verified, false) AS scraped_unverified, "
    f"({ACTIVE} AND NOT (verified AND coalesce(single, 0) <> 0)) AS active_unpriced FROM places "
    f"WHERE (status = 'success' AND NOT verified) OR ({ACTIVE} AND NOT (verified AND coalesce(single, 0) <> 0))"))
def jn_missing_price(spark, sf):
    p = places(spark, sf)
    a = (F.col("status") == "success") & ~F.col("verified")
    b = facets.is_active() & ~(F.col("verified") & (F.coalesce("single", F.lit(0.0)) != 0))
    return p.filter(a | b).select("id", a.alias("scraped_unverified"), b.alias("active_unpriced"))


# Research: prices per part seen in the lineitems shipped from 2000 on, keyed like the places.
_RESEARCH = ("SELECT user_id AS id, count(*) > 60 AS verified, CAST(CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat(CAST(floor(max(value)) AS INTEGER), '-400') END AS {s}) AS single, "
             "CAST(CASE WHEN user_id % 8 = 0 THEN 'auf Anfrage' ELSE NULL END AS {s}) AS card_10 FROM {t} GROUP BY user_id")


def research(spark, sf):
    return spark.sql(_RESEARCH.format(s="STRING", t="{e}"), e=table(spark, sf, "events"))


@query("jn_apply_verified", with_places(
    "SELECT p.id, CASE WHEN ok THEN " + Q.sql_parse_price("r.single") + " END AS single, CASE WHEN ok THEN " + Q.sql_parse_price("r.card_10") +
    " END AS card_10, CASE WHEN ok THEN 'verified' WHEN p.single IS NOT NULL OR p.card_10 IS NOT NULL THEN 'removed' ELSE 'unchanged' END AS action "
    "FROM places p LEFT JOIN (SELECT *, verified AND single IS NOT NULL AS ok FROM (" + _RESEARCH.format(s="VARCHAR", t="events") + ")) r ON r.id = p.id"))
def jn_apply_verified(spark, sf):
    return joins.apply_verified(places(spark, sf).select("id", "single", "card_10"), research(spark, sf), "id", ["single", "card_10"])


@query("jn_recover_existing", with_places(
    "SELECT p.id, r.known_price, r.known_price IS NOT NULL AS recovered FROM (SELECT id FROM places WHERE NOT verified) p "
    "LEFT JOIN (SELECT user_id AS id, max(value) AS known_price FROM events GROUP BY user_id HAVING count(*) % 3 <> 0 AND max(value) > 0) r ON r.id = p.id"))
def jn_recover_existing(spark, sf):
    missing = places(spark, sf).filter("NOT verified").select("id")
    known = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.max("value").alias("known_price"), (F.count("*") % 3 != 0).alias("verified"))
    return joins.recover_existing(missing, known, "id", ["known_price"])


# Two runs over all rows: what shipped in even years, and in odd ones.
SNAP = ("SELECT l_partkey AS part_id, min(l_extendedprice / l_quantity) AS lo, max(l_extendedprice / l_quantity) AS hi, "
        "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM {t} "
        "WHERE year(l_shipdate) % 2 = {y} % 2 GROUP BY l_partkey")


def snapshot(spark, sf, year):
    return spark.sql(SNAP.format(t="{li}", y=year), li=table(spark, sf, "lineitem"))


def snap_sql(year):
    return SNAP.format(t="lineitem", y=year)


PAIRS_SQL = ("SELECT o.part_id, f.field, f.old_value, f.new_value FROM (" + snap_sql(1996) + ") o JOIN (" + snap_sql(1997) + ") n ON o.part_id = n.part_id, "
             "LATERAL (VALUES ('lo', o.lo, n.lo), ('hi', o.hi, n.hi), ('mean', o.mean, n.mean)) f(field, old_value, new_value)")


@query("jn_snapshot_diff",
       "SELECT part_id, field, old_value, new_value, pct, (new_value - old_value) / old_value * 100 AS signed_pct, "
       "CASE WHEN pct > 50 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, abs(new_value - old_value) / old_value * 100 AS pct FROM ("
       + PAIRS_SQL + ")) WHERE pct > 20")
def jn_snapshot_diff(spark, sf):
    return joins.snapshot_diff(snapshot(spark, sf, 1996), snapshot(spark, sf, 1997), ["part_id"], ["lo", "hi", "mean"])


@query("jn_field_diff", "SELECT * FROM (" + PAIRS_SQL + ") WHERE old_value <> new_value")
def jn_field_diff(spark, sf):
    return joins.field_diff(snapshot(spark, sf, 1996), snapshot(spark, sf, 1997), ["part_id"], ["lo", "hi", "mean"])


def points(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", *(_coordinate(F.col("embedding")[k].cast("double")).alias(n) for k, n in enumerate("xy")))


def _coordinate(v):
    """Part of the points lie on a coarse grid, so that some share a position."""
    return F.when(F.col("vec_id") % 3 == 0, F.floor(v * 20) / 20).otherwise(v)


POINTS_SQL = ("SELECT vec_id AS id, label, " + ", ".join(
    f"CASE WHEN vec_id % 3 = 0 THEN floor(CAST(embedding[{k}] AS DOUBLE) * 20) / 20 ELSE CAST(embedding[{k}] AS DOUBLE) END AS {n}" for k, n in ((1, "x"), (2, "y"))) + " FROM embeddings")


# Over the raw rows: a pair counts if it is the first of each of two positions, or the first and another one of the same position.
CLOSE_SQL = ("WITH raw AS (" + POINTS_SQL + "), f AS (SELECT *, NOT EXISTS (SELECT 1 FROM raw o WHERE o.label = r.label AND o.x = r.x AND o.y = r.y AND o.id < r.id) AS first, "
             "(SELECT count(*) FROM raw o WHERE o.label = r.label AND o.x = r.x AND o.y = r.y) AS n FROM raw r) "
             "SELECT a.label, a.id AS id_1, b.id AS id_2, CASE WHEN same THEN 1 ELSE a.n END AS n_1, CASE WHEN same THEN 1 ELSE b.n END AS n_2 FROM f a JOIN f b ON a.label = b.label, "
             "LATERAL (SELECT a.x = b.x AND a.y = b.y AS same) WHERE a.first AND abs(a.x - b.x) < 0.01e0 AND abs(a.y - b.y) < 0.01e0 AND a.id < b.id AND (same OR b.first)")


@query("jn_close_pairs", CLOSE_SQL)
def jn_close_pairs(spark, sf):
    return joins.close_pairs(points(spark, sf), "label", "x", "y", "id", eps=0.01)


@query("jn_radius", "SELECT c.center, id, sqrt((x - lat0) * (x - lat0) + (y - lng0) * (y - lng0)) * 111 AS km FROM (" + POINTS_SQL +
       "), (VALUES ('mid', 0.0e0, 0.0e0, 8.0e0), ('east', 0.1e0, 0.1e0, 5.0e0), ('west', -0.1e0, 0.05e0, 6.0e0)) c(center, lat0, lng0, r) "
       "WHERE sqrt((x - lat0) * (x - lat0) + (y - lng0) * (y - lng0)) * 111 <= r")
def jn_radius(spark, sf):
    centers = [("mid", 0.0, 0.0, 8.0), ("east", 0.1, 0.1, 5.0), ("west", -0.1, 0.05, 6.0)]
    return joins.within_radius(points(spark, sf), centers, "x", "y", mode="planar").select("center", "id", "km")


ALIASES = {"NATION_0": "nation-zero", "NATION_1": "nation-one"}


@query("jn_dim_inner",
       "SELECT c_custkey, n_name, CASE n_name WHEN 'NATION_0' THEN 'nation-zero' WHEN 'NATION_1' THEN 'nation-one' ELSE n_name END AS dim_key "
       "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def jn_dim_inner(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region").filter("r_name <> 'ASIA'"),
                                        F.col("n_regionkey") == F.col("r_regionkey"))
    dim = n.select("n_nationkey", "n_name", joins.alias_key("n_name", ALIASES).alias("dim_key"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return c.join(dim, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "dim_key")


@query("jn_dim_left",
       "SELECT n_name AS part, count(c_custkey) AS n_places FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey "
       "AND c_acctbal > 0 GROUP BY n_name")
def jn_dim_left(spark, sf):
    counts = table(spark, sf, "customer").filter("c_acctbal > 0").groupBy("c_nationkey").agg(F.count("*").alias("n_places"))
    n = table(spark, sf, "nation")
    return n.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").fillna({"n_places": 0}) \
        .select(F.col("n_name").alias("part"), "n_places")


@query("jn_override_lookup",
       "SELECT coalesce(a.id, b.id) AS id, coalesce(b.url, a.url) AS url, CASE WHEN b.url IS NOT NULL THEN 'second' ELSE 'first' END AS origin "
       "FROM (SELECT id, schedule_url AS url FROM (" + BASE_SQL + ") WHERE schedule_url <> '') a FULL JOIN "
       "(SELECT user_id AS id, concat('https://ev/', max(event_id)) AS url FROM events WHERE event_type = 'signup' GROUP BY user_id) b ON a.id = b.id")
def jn_override_lookup(spark, sf):
    first = places_base(spark, sf).filter("schedule_url <> ''").select("id", F.col("schedule_url").alias("url"))
    second = table(spark, sf, "events").filter("event_type = 'signup'").groupBy(F.col("user_id").alias("id")) \
        .agg(F.concat(F.lit("https://ev/"), F.max("event_id").cast("string")).alias("url"))
    return joins.override_lookup(first, second, "id", "url")


def _roots_sql(alias="p"):
    rows = ", ".join("('{}', '{}')".format(k, r) for k, rs in R.TAG_ROOTS.items() for r in rs)
    return (f"SELECT DISTINCT {alias}.id, {alias}.part AS city, r.style FROM places {alias}, (VALUES {rows}) r(style, root) "
            f"WHERE len(list_filter({alias}.styles, lambda s: contains(lower(trim(s)), r.root))) > 0")


STYLE_CITY_SQL = "SELECT style, city, count(*) AS n_places FROM (" + _roots_sql() + ") GROUP BY style, city"


def style_city_rows(spark, sf):
    return joins.style_city(places(spark, sf).withColumnRenamed("part", "city"), R.TAG_ROOTS, "styles", "city")


@query("jn_style_city", with_places(STYLE_CITY_SQL))
def jn_style_city(spark, sf):
    return style_city_rows(spark, sf).groupBy("style", "city").agg(F.count("*").alias("n_places"))


CROSS_SQL = ("SELECT c.style, c.city, (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM (SELECT o.style AS v FROM combos o WHERE o.city = c.city AND o.style <> c.style ORDER BY v LIMIT 6)) AS other_styles, "
             "(SELECT count(*) FROM combos o WHERE o.city = c.city AND o.style <> c.style) AS n_other_styles, "
             "(SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM (SELECT o.city AS v FROM combos o WHERE o.style = c.style AND o.city <> c.city ORDER BY v LIMIT 6)) AS other_cities, "
             "(SELECT count(*) FROM combos o WHERE o.style = c.style AND o.city <> c.city) AS n_other_cities FROM combos c")


@query("jn_cross_links",
       "WITH combos AS (SELECT DISTINCT p_type AS style, n_name AS city FROM lineitem JOIN part ON p_partkey = l_partkey "
       "JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) " + CROSS_SQL)
def jn_cross_links(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    combos = li.join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")) \
        .join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")) \
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")) \
        .select(F.col("p_type").alias("style"), F.col("n_name").alias("city")).distinct()
    return joins.cross_links(combos, first=6)
