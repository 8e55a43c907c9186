"""Statistics over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.functions import urls
from slotatlas.operators import facets, ranking, stats
from slotatlas.plans.filters import HEALTH_SQL, crawl_log
from slotatlas.plans.registry import query
from slotatlas.plans.standins import (places, places_base, slots, table, with_base, with_base_slots, with_both,
                                      with_places, with_slots)

ACTIVE = "coalesce(active, true)"


@query("ag_partition_stats", with_both(f"""
SELECT part, count(*) AS n_places, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_slots, count(*) FILTER (drop_in) AS n_drop_in, min(single) AS min_single,
  (SELECT count(DISTINCT t) FROM (SELECT unnest(styles) AS t FROM places q WHERE q.part = p.part AND {ACTIVE})) AS n_tags
FROM places p LEFT JOIN (SELECT place_id, count(*) AS n FROM slots GROUP BY place_id) s ON s.place_id = p.id
WHERE {ACTIVE} GROUP BY part"""))
def ag_partition_stats(spark, sf):
    return stats.partition_stats(places(spark, sf).filter(facets.is_active()), slots(spark, sf))


@query("ag_tag_histogram", with_places("SELECT tag, count(*) AS n FROM (SELECT unnest(styles) AS tag FROM places) GROUP BY tag"))
def ag_tag_histogram(spark, sf):
    return stats.tag_histogram(places(spark, sf), "styles").orderBy(F.desc("n"), "tag")


@query("ag_top_tags", with_places(
    "SELECT part, string_agg(tag, ', ' ORDER BY r) AS top FROM (SELECT part, tag, row_number() OVER (PARTITION BY part ORDER BY count(*) DESC, tag) AS r "
    "FROM (SELECT part, unnest(styles) AS tag FROM places) GROUP BY part, tag) WHERE r <= 3 GROUP BY part"))
def ag_top_tags(spark, sf):
    counts = stats.tag_histogram(places(spark, sf), "styles", ["part"])
    top = ranking.top_n(counts, ["part"], [F.desc("n"), F.col("tag")], 3)
    # At most three rows per partition are left to join into a text.
    return top.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))),
                                                            lambda x: x["tag"]), ", ").alias("top"))


@query("ag_distinct_sorted", with_places(
    "SELECT DISTINCT part, kind, trim(value) AS value FROM (SELECT part, 'tag' AS kind, unnest(styles) AS value FROM places UNION ALL "
    "SELECT part, 'city', unnest(list_transform(addresses, lambda a: a.city)) FROM places) WHERE trim(value) <> ''"))
def ag_distinct_sorted(spark, sf):
    cities = F.transform("addresses", lambda a: a["city"])
    return stats.distinct_sorted(places(spark, sf), "part", {"tag": F.col("styles"), "city": cities}) \
        .orderBy("part", "kind", "value")


@query("ag_price_span", with_places(
    "SELECT part, min(single) FILTER (single < 100 AND single <> 0) AS lo, max(single) FILTER (single < 100 AND single <> 0) AS hi FROM places GROUP BY part"))
def ag_price_span(spark, sf):
    return stats.price_span(places(spark, sf), "part", "single", 100)


@query("ag_min_price", "SELECT p_brand, CAST(floor(min(p_retailprice) FILTER (p_retailprice > 0) + 0.5) AS BIGINT) AS min_price FROM part GROUP BY p_brand")
def ag_min_price(spark, sf):
    return stats.min_price(table(spark, sf, "part"), "p_brand", "p_retailprice")


@query("ag_global_totals", with_base_slots(
    "SELECT part, count(*) AS n_places, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_slots, max(last) AS last_updated FROM places "
    "LEFT JOIN (SELECT place_id, count(*) AS n, max(last_checked) AS last FROM slots GROUP BY place_id) ON place_id = id "
    f"WHERE {ACTIVE} GROUP BY ROLLUP (part)"))
def ag_global_totals(spark, sf):
    return stats.global_totals(places_base(spark, sf).filter(facets.is_active()), slots(spark, sf))


@query("ag_validation_summary", with_both(
    "SELECT unnest(['places', 'active', 'with_price', 'parts']) AS metric, unnest([count(*), "
    f"count(*) FILTER ({ACTIVE}), count(*) FILTER (single IS NOT NULL OR card_10 IS NOT NULL OR monthly IS NOT NULL OR trial IS NOT NULL), count(DISTINCT part)]) AS value FROM places "
    "UNION ALL SELECT unnest(['slots', 'verified_slots']), unnest([count(*), count(*) FILTER (verified)]) FROM slots"))
def ag_validation_summary(spark, sf):
    p = places(spark, sf).agg(
        F.count("*").alias("places"), F.count_if(facets.is_active()).alias("active"),
        F.count_if(F.coalesce(*R.PRICE_FIELDS).isNotNull()).alias("with_price"), F.count_distinct("part").alias("parts"))
    s = slots(spark, sf).agg(F.count("*").alias("slots"), F.count_if("verified").alias("verified_slots"))
    return stats.metric_rows([p, s])


# Part of the names are blank or missing: they belong to no group.
_PART_NAMES = ("SELECT p_brand AS part, CASE p_partkey % 11 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE lower(trim(p_name)) END AS name_key, p_partkey AS id FROM part")


def _part_names(spark, sf):
    rest = F.col("p_partkey") % 11
    key = F.when(rest == 0, F.lit(" ")).when(rest == 1, F.lit(None)).otherwise(F.lower(F.trim("p_name")))
    return table(spark, sf, "part").select(F.col("p_brand").alias("part"), key.alias("name_key"), F.col("p_partkey").alias("id"))


@query("ag_duplicate_name", f"SELECT part, name_key, count(DISTINCT id) AS n_members, min(id) AS first_id FROM ({_PART_NAMES}) WHERE trim(name_key) <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) > 1")
def ag_duplicate_name(spark, sf):
    return stats.duplicates(_part_names(spark, sf), ["part", "name_key"], "id")


@query("ag_duplicate_members", f"SELECT part, name_key, id, n_members FROM (SELECT *, count(*) OVER (PARTITION BY part, name_key) AS n_members FROM ({_PART_NAMES}) WHERE trim(name_key) <> '') WHERE n_members > 1")
def ag_duplicate_members(spark, sf):
    return stats.duplicate_members(_part_names(spark, sf), ["part", "name_key"], "id")


@query("ag_duplicate_address", with_base(
    "SELECT part, street, zip, count(DISTINCT id) AS n_members, min(id) AS first_id FROM (SELECT part, id, lower(trim(a.street)) AS street, trim(a.zip) AS zip "
    "FROM (SELECT part, id, unnest(addresses) AS a FROM places)) WHERE street <> '' GROUP BY part, street, zip HAVING count(DISTINCT id) > 1"))
def ag_duplicate_address(spark, sf):
    a = places_base(spark, sf).select("part", "id", F.explode("addresses").alias("a")).select(
        "part", "id", F.lower(F.trim("a.street")).alias("street"), F.trim("a.zip").alias("zip"))
    return stats.duplicates(a, ["part", "street", "zip"], "id", named=["street"])


@query("ag_status_pivot", with_base(
    "SELECT part, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("success", "dynamic", "no_data", "error")) + " FROM places GROUP BY part"))
def ag_status_pivot(spark, sf):
    return stats.status_pivot(places_base(spark, sf), "part", "status", ["success", "dynamic", "no_data", "error"])


@query("ag_run_totals", "SELECT user_id, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS fail, "
       "CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (event_type <> 'error'), 0) AS BIGINT) AS new_rows FROM events GROUP BY user_id")
def ag_run_totals(spark, sf):
    return stats.run_totals(table(spark, sf, "events"), "user_id", F.col("event_type") != "error", F.floor("value"))


@query("ag_method_histogram", "SELECT event_type AS method, count(*) AS n FROM events GROUP BY event_type")
def ag_method_histogram(spark, sf):
    e = table(spark, sf, "events").withColumn("method", F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")))
    return stats.method_histogram(e, "method").orderBy(F.desc("n"), "method")


@query("ag_all_unverified", with_slots(
    "SELECT class_id, place_id, day, time_start FROM slots WHERE place_id IN (SELECT place_id FROM slots GROUP BY place_id HAVING NOT bool_or(verified))"))
def ag_all_unverified(spark, sf):
    return stats.all_unverified(slots(spark, sf).select("class_id", "place_id", "day", "time_start", "verified"), "place_id") \
        .select("class_id", "place_id", "day", "time_start")


@query("ag_children_by_parent", with_slots(
    "SELECT place_id, count(*) AS n_children, count(*) FILTER (verified) AS n_verified, min(day) AS first_day, max(last_checked) AS last_checked FROM slots GROUP BY place_id"))
def ag_children_by_parent(spark, sf):
    return stats.children_by_parent(slots(spark, sf), "place_id")


@query("ag_tag_members", with_places("SELECT tag, name, id FROM (SELECT unnest(styles) AS tag, name, id FROM places)"))
def ag_tag_members(spark, sf):
    # One row per member: a tag may have millions of them.
    return places(spark, sf).select(F.explode("styles").alias("tag"), "name", "id").orderBy("tag", "name", "id")


@query("ag_issue_groups", f"SELECT issue, count(*) AS n FROM (SELECT {HEALTH_SQL} AS issue FROM events) WHERE issue <> 'OK' GROUP BY issue")
def ag_issue_groups(spark, sf):
    log = crawl_log(spark, sf).select(urls.url_health("http", "url", "final_url", "error").alias("issue"))
    return stats.issue_groups(log.filter("issue <> 'OK'"), "issue")


_REASON = ("CASE o_orderkey % 8 WHEN 0 THEN 'Loaded dynamically by a script' WHEN 1 THEN 'Wix page, 404 on subpages' "
           "WHEN 2 THEN 'Server blocks us' WHEN 3 THEN 'Schedule is a JPG' WHEN 4 THEN concat('SSL trouble ', o_orderpriority) "
           "WHEN 5 THEN 'Wix login' WHEN 6 THEN 'Only retreats' ELSE o_orderstatus END")


@query("ag_failure_categories",
       "SELECT CASE o_orderkey % 8 WHEN 0 THEN 'dynamic_platform' WHEN 1 THEN 'subpages_404' WHEN 2 THEN 'blocked_403' WHEN 3 THEN 'image_schedule' "
       "WHEN 4 THEN 'ssl_error' WHEN 5 THEN 'login_required' WHEN 6 THEN 'no_weekly_classes' ELSE 'unknown' END AS category, count(*) AS n FROM orders GROUP BY 1")
def ag_failure_categories(spark, sf):
    o = table(spark, sf, "orders").selectExpr(f"{_REASON} AS reason")
    return o.groupBy(urls.category_by_rules("reason", R.FAILURE_RULES).alias("category")).agg(F.count("*").alias("n")) \
        .orderBy(F.desc("n"), "category")


@query("ag_coverage", with_places(
    f"SELECT part, count(*) AS n_active, count(*) FILTER (verified AND coalesce(single, 0) <> 0) AS n_priced, "
    f"count(*) FILTER (verified AND coalesce(single, 0) <> 0) / count(*) AS share FROM places WHERE {ACTIVE} GROUP BY part"))
def ag_coverage(spark, sf):
    return stats.coverage(places(spark, sf).filter(facets.is_active()), ["part"],
                          F.col("verified") & (F.coalesce("single", F.lit(0.0)) != 0))


@query("ag_yield", "SELECT count(*) AS attempted, count(*) FILTER (event_type <> 'error') AS recovered, count(*) FILTER (event_type = 'error') AS failed, "
       "CAST(sum(CAST(floor(value) AS BIGINT)) FILTER (event_type <> 'error') AS BIGINT) AS new_rows FROM events")
def ag_yield(spark, sf):
    ok = F.col("event_type") != "error"
    return table(spark, sf, "events").agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("recovered"), F.count_if(~ok).alias("failed"),
        F.sum(F.when(ok, F.floor("value"))).alias("new_rows"))


@query("ag_weekly_pattern",
       "SELECT user_id, day, time_start, event_type, arg_min(value, event_id) AS value, min(event_id) AS event_id, count(DISTINCT wk) AS n_weeks FROM "
       "(SELECT *, dayname(ts) AS day, strftime(ts, '%H:00') AS time_start, date_trunc('week', ts) AS wk FROM events) GROUP BY user_id, day, time_start, event_type")
def ag_weekly_pattern(spark, sf):
    e = table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return stats.weekly_pattern(e, ["user_id"], "hour", "event_type", ["value", "event_id"], "event_id")
