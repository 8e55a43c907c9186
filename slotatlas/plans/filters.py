"""Filters and projections over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.functions import price, text, timefn, urls
from slotatlas.operators import cleaning, facets
from slotatlas.plans import sqltext as Q
from slotatlas.plans.registry import query
from slotatlas.plans.standins import (places, places_base, slots, table, with_base, with_both, with_places,
                                      with_slots)

ACTIVE = "coalesce(active, true)"
SEARCH_SQL = ("lower(concat_ws(' ', name, description, array_to_string(styles, ' '), array_to_string(features, ' '), "
              "array_to_string(languages, ' '), array_to_string(list_transform(addresses, "
              "lambda a: concat_ws(' ', a.street, a.zip, a.city)), ' ')))")


@query("flt_active", with_base(f"SELECT id, name FROM places WHERE {ACTIVE}"))
def flt_active(spark, sf):
    return places_base(spark, sf).filter(facets.is_active()).select("id", "name")


@query("flt_search", with_places(f"SELECT id, name FROM places WHERE contains({SEARCH_SQL}, 'hot yin')"))
def flt_search(spark, sf):
    return places(spark, sf).filter(facets.matches_search("Hot Yin")).select("id", "name")


@query("flt_any_contains", with_places(
    "SELECT id FROM places WHERE len(list_filter(styles, lambda s: contains(lower(s), 'soft vin'))) > 0"))
def flt_any_contains(spark, sf):
    return places(spark, sf).filter(text.any_contains("styles", "Soft Vin")).select("id")


@query("flt_any_struct_eq", with_base(
    "SELECT id FROM places WHERE len(list_filter(addresses, lambda a: trim(a.zip) = '1034')) > 0"))
def flt_any_struct_eq(spark, sf):
    return places_base(spark, sf).filter(facets.any_zip("addresses", "1034")).select("id")


_FEATURES = ["drop_in", "english", "prenatal", "seniors", "kids", "teacher_training", "outdoor", "no_such"]


@query("flt_feature", with_places(
    "SELECT id, drop_in, list_contains(languages, 'English') AS english, "
    "regexp_matches(s || ' ' || f, '(?i)prenatal|schwanger|postnatal|mama') AS prenatal, "
    "regexp_matches(s || ' ' || f, '55\\+|60\\+') AS seniors, regexp_matches(s || ' ' || f, '(?i)kids|kinder|family|kleinkind') AS kids, "
    "regexp_matches(f, '(?i)teacher training|ryt') AS teacher_training, regexp_matches(f, '(?i)outdoor|park|sommer') AS outdoor, "
    "true AS no_such FROM (SELECT *, array_to_string(styles, ' ') AS s, array_to_string(features, ' ') AS f FROM places)"))
def flt_feature(spark, sf):
    return places(spark, sf).select("id", *[facets.has_feature(n).alias(n) for n in _FEATURES])


@query("flt_id_set", with_base(
    "SELECT id, name FROM places WHERE id IN (SELECT user_id FROM events WHERE event_type = 'purchase')"))
def flt_id_set(spark, sf):
    favorites = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("id"))
    return places_base(spark, sf).join(favorites, "id", "left_semi").select("id", "name")


@query("flt_facet_query", with_places(
    f"SELECT id, name, part, len(styles) AS n_tags FROM places WHERE {ACTIVE} AND contains({SEARCH_SQL}, 'town') "
    "AND len(list_filter(styles, lambda s: contains(lower(s), 'hot'))) > 0 "
    "AND regexp_matches(array_to_string(features, ' '), '(?i)outdoor|park|sommer')"))
def flt_facet_query(spark, sf):
    q = facets.FacetQuery(q="Town", tag="hot", feature="outdoor", sort="size")
    return facets.facet_query(places(spark, sf), q).select("id", "name", "part", F.size("styles").cast("bigint").alias("n_tags"))


@query("flt_facet_options", with_base("""
SELECT part, zip, city, n_options FROM (
  SELECT part, zip, arg_min(city, ord) AS city, count(*) OVER (PARTITION BY part) AS n_options FROM (
    SELECT part, trim(a.zip) AS zip, a.city AS city, id * 10 + pos AS ord FROM (
      SELECT part, id, unnest(addresses) AS a, generate_subscripts(addresses, 1) AS pos FROM places))
  WHERE zip <> '' GROUP BY part, zip) WHERE n_options > 1"""))
def flt_facet_options(spark, sf):
    return facets.facet_options(places_base(spark, sf)).select("part", "zip", "city", "n_options")


@query("flt_schedule_day", with_both(
    "SELECT class_id, place_id, time_start, class_name FROM (SELECT s.*, p.name AS place_name FROM slots s JOIN places p ON p.id = s.place_id) x "
    "WHERE day = 'Tuesday' AND contains(lower(class_name), 'yin') AND contains(lower(concat_ws(' ', class_name, place_name, teacher, level)), 'clerk 1') "
    "AND place_id IN (SELECT id FROM places WHERE drop_in)"))
def flt_schedule_day(spark, sf):
    p = places_base(spark, sf)
    named = slots(spark, sf).join(p.select(F.col("id").alias("place_id"), F.col("name").alias("place_name")), "place_id")
    shown = p.filter(facets.has_feature("drop_in"))
    return facets.schedule_day(named, "Tuesday", shown, "yin", "Clerk 1") \
        .select("class_id", "place_id", "time_start", "class_name")


@query("flt_price_comparable", with_places(f"SELECT id, single FROM places WHERE {ACTIVE} AND verified AND coalesce(single, 0) <> 0"))
def flt_price_comparable(spark, sf):
    return places(spark, sf).filter(facets.price_comparable()).select("id", "single")


GARBAGE_SQL = (f"(coalesce(({Q.sql_minutes('time_end')}) <= ({Q.sql_minutes('time_start')}), false) "
               "OR regexp_matches(class_name, '[0-9]{1,2}:[0-9]{2}[A-Za-zÄÖÜ]') "
               "OR (length(class_name) > 40 AND regexp_matches(class_name, '[a-zäöü][A-ZÄÖÜ][a-zäöü]')))")


@query("flt_garbage_rows", with_slots(f"SELECT class_id, day, time_start, time_end, class_name FROM slots WHERE NOT {GARBAGE_SQL}"))
def flt_garbage_rows(spark, sf):
    return slots(spark, sf).filter(~cleaning.is_garbage()).select("class_id", "day", "time_start", "time_end", "class_name")


@query("flt_garbage_count", with_slots(f"SELECT count(*) AS n_rows, count(*) FILTER ({GARBAGE_SQL}) AS n_dropped FROM slots"))
def flt_garbage_count(spark, sf):
    return slots(spark, sf).agg(F.count("*").alias("n_rows"), F.count_if(cleaning.is_garbage()).alias("n_dropped"))


def _null_sql(f, lo, hi):
    return f"CASE WHEN {f} BETWEEN {lo} AND {hi} THEN {f} END AS {f}"


@query("flt_null_impossible", with_places(
    "SELECT id, " + ", ".join(_null_sql(f, *b) for f, b in R.IMPOSSIBLE_PRICES.items()) + ", CAST(" +
    " + ".join(f"CASE WHEN {f} NOT BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END" for f, (lo, hi) in R.IMPOSSIBLE_PRICES.items()) +
    " AS INTEGER) AS n_nulled FROM places"))
def flt_null_impossible(spark, sf):
    p = places(spark, sf).select("id", *R.PRICE_FIELDS)
    return cleaning.null_impossible(p, R.IMPOSSIBLE_PRICES)


_ROBOTS = ("CASE n % 4 WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /') "
           "WHEN 1 THEN concat('User-agent: *', chr(10), 'Disallow: /private', chr(10), 'User-agent: BadBot', chr(10), 'Disallow: /') "
           "WHEN 2 THEN concat('User-agent: BadBot', chr(10), 'Disallow: /', chr(10), 'User-agent: *', chr(10), 'Crawl-delay: 3', chr(10), 'Disallow: / ') "
           "ELSE '' END")


@query("flt_robots_gate", f"SELECT page_id, url FROM pages WHERE length({Q.sql_host('url')}) % 4 IN (1, 3)")
def flt_robots_gate(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", urls.host("url").alias("host"))
    robots = p.select("host", F.length("host").alias("n")).distinct().selectExpr("host", f"{_ROBOTS} AS body")
    return cleaning.drop_blocked(p, cleaning.robots_disallowed(robots), "host").select("page_id", "url")


@query("flt_targets", with_base(
    "SELECT id, status, part FROM places WHERE status IN ('dynamic', 'no_data', 'error') AND trim(schedule_url) <> '' AND part <> 'NATION_3' "
    "ORDER BY CASE status WHEN 'dynamic' THEN 0 WHEN 'no_data' THEN 1 ELSE 2 END, part, name, id"))
def flt_targets(spark, sf, most: int | None = None):
    from slotatlas.operators.ranking import status_rank
    p = places_base(spark, sf).filter("status IN ('dynamic', 'no_data', 'error') AND trim(schedule_url) <> '' AND part <> 'NATION_3'")
    p = p.orderBy(status_rank("status", ["dynamic", "no_data", "error"]), "part", "name", "id")
    return (p.limit(most) if most else p).select("id", "status", "part")


VALID_SQL = ("(day IN ('Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday') AND regexp_matches(time_start, '^[0-9]{1,2}:[0-9]{2}') "
             "AND trim(class_name) <> '' AND NOT contains(class_name, 'TBC'))")


@query("flt_looks_valid", with_slots(f"SELECT class_id, {VALID_SQL} AS looks_valid FROM slots WHERE NOT verified"))
def flt_looks_valid(spark, sf):
    return slots(spark, sf).filter("NOT verified").select("class_id", cleaning.looks_valid().alias("looks_valid"))


@query("flt_blocklist", with_base(
    "SELECT id FROM places WHERE id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150) AND part <> 'NATION_0'"))
def flt_blocklist(spark, sf):
    deny = table(spark, sf, "events").filter("event_type = 'error' AND value > 150").select(F.col("user_id").alias("id"))
    return cleaning.drop_blocked(places_base(spark, sf).filter("part <> 'NATION_0'"), deny, "id").select("id")


@query("flt_platform_any", with_base(
    "SELECT id FROM places WHERE lower(platform) = 'eversports' OR contains(lower(schedule_url), 'eversports') OR contains(lower(website), 'eversports')"))
def flt_platform_any(spark, sf):
    return places_base(spark, sf).filter(cleaning.platform_any("platform", ["schedule_url", "website"], "Eversports")).select("id")


_LOOSE = {"single": "CASE WHEN l_linenumber % 3 = 0 THEN 'auf Anfrage' ELSE concat(CAST(l_quantity AS INT), '-', 60) END",
          "card_10": "CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS {s}) END",
          "trial": "CASE WHEN l_linestatus = 'O' THEN '0' ELSE 'gratis' END"}


@query("flt_any_real_price", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber % 3 <> 0 OR l_returnflag = 'A' OR l_linestatus = 'O'")
def flt_any_real_price(spark, sf):
    fields = [F.expr(e.format(s="STRING")) for e in _LOOSE.values()]
    return table(spark, sf, "lineitem").filter(price.any_real_price(fields)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("prj_pricing_struct",
       "SELECT l_orderkey, l_linenumber, " + ", ".join(
           f"{Q.sql_parse_price(e.format(s='VARCHAR'))} AS {k}" for k, e in _LOOSE.items()) +
       ", 'CHF' AS currency, true AS verified, CASE WHEN l_linenumber <> 2 THEN concat('https://src/', l_partkey) END AS source FROM lineitem")
def prj_pricing_struct(spark, sf):
    s = price.pricing_struct({k: F.expr(e.format(s="STRING")) for k, e in _LOOSE.items()},
                             F.expr("CASE WHEN l_linenumber = 2 THEN '' ELSE concat('https://src/', l_partkey) END"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", s.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("prj_route_method", with_base(
    "SELECT id, CASE WHEN lower(platform) = 'eversports' OR contains(schedule_url, 'eversports.ch/s/') THEN 'eversports' "
    "WHEN lower(platform) = 'sportsnow' THEN 'sportsnow' ELSE 'auto' END AS method FROM places"))
def prj_route_method(spark, sf):
    return places_base(spark, sf).select("id", urls.route_method("platform", "schedule_url").alias("method"))


_PAGE = ("concat('<p>', dayname_, ' 09:00 - 10.15</p><p>', CASE WHEN o_orderkey % 2 = 0 THEN '18:30 Uhr' ELSE '9:00' END, ' ', "
         "CASE o_orderkey % 3 WHEN 0 THEN 'Vinyasa Flow' WHEN 1 THEN 'dimanche' ELSE 'Soft Domino' END, '</p>')")


@query("flt_page_class", """
SELECT o_orderkey, 2 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 1 END AS n_times_raw, n_days, n_topics,
  CASE WHEN o_orderkey % 20 = 7 THEN 'no_url' WHEN st = 403 THEN 'blocked' WHEN st IS NULL OR st >= 400 THEN 'error'
       WHEN n_days >= 2 OR n_topics >= 2 THEN 'scrapable' ELSE 'dynamic' END AS page_class
FROM (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 403 WHEN 1 THEN 500 WHEN 2 THEN NULL ELSE 200 END AS st,
   CAST(CASE WHEN o_orderkey % 3 = 1 AND dayname(o_orderdate) <> 'X' THEN 2 ELSE 1 END AS INTEGER) AS n_days,
   CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_topics FROM orders)""")
def flt_page_class(spark, sf):
    o = table(spark, sf, "orders").withColumn("dayname_", timefn.day_name("o_orderdate")).select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 20 = 7 THEN ' ' ELSE 'https://x' END").alias("url"),
        F.expr("CASE o_orderkey % 9 WHEN 0 THEN 403 WHEN 1 THEN 500 WHEN 2 THEN NULL ELSE 200 END").alias("http"),
        F.expr(_PAGE).alias("html"))
    o = o.select("o_orderkey", "url", "http", *[c.alias(k) for k, c in cleaning.page_signals("html").items()])
    return o.select("o_orderkey", F.col("n_times").alias("n_times_raw"), "n_days", "n_topics",
                    cleaning.page_class("url", "http", "n_times", "n_days", "n_topics").alias("page_class"))


CRAWL = {
    "http": "CASE event_type WHEN 'error' THEN CASE WHEN value < 30 THEN 404 WHEN value < 80 THEN 503 ELSE NULL END ELSE 200 END",
    "url": "concat('https://www.host', user_id, '.example.ch/a')",
    "final_url": "CASE WHEN event_type = 'view' AND value > 60 THEN concat('https://parked.example.com/?h=', user_id) "
                 "WHEN event_type = 'error' AND value >= 80 THEN NULL ELSE concat('https://host', user_id, '.example.ch/b') END",
    "error": "CASE WHEN event_type = 'error' AND value >= 80 THEN 'Timeout' END",
}
HEALTH_SQL = ("CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN '404_NOT_FOUND' WHEN value < 80 THEN 'HTTP_503' ELSE 'CONNECTION_ERROR' END "
              "WHEN event_type = 'view' AND value > 60 THEN 'DOMAIN_REDIRECT' ELSE 'OK' END")


def crawl_log(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value",
                                                 *[f"{e} AS {k}" for k, e in CRAWL.items()])


@query("flt_url_health", f"SELECT event_id, {HEALTH_SQL} AS issue FROM events")
def flt_url_health(spark, sf):
    return crawl_log(spark, sf).select("event_id", urls.url_health("http", "url", "final_url", "error").alias("issue"))


KEYWORDS = [("wh", "west"), ("tion", "north"), ("an", "east"), ("er", "south")]


@query("flt_route_keyword",
       "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'given' ELSE coalesce(" + ", ".join(
           f"CASE WHEN contains(lower(text), '{k}') THEN '{v}' END" for k, v in KEYWORDS) + ") END AS part FROM conversations")
def flt_route_keyword(spark, sf):
    explicit = F.when(F.col("conv_id") % 5 == 0, F.lit("given"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.coalesce(explicit, urls.first_keyword("text", KEYWORDS)).alias("part"))


@query("prj_class_row",
       "SELECT doc_id, coalesce(nullif(substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 100), ''), 'Class') AS class_name, "
       "substring(concat(source, ' ', lang), 1, 60) AS teacher, 'all' AS level FROM documents")
def prj_class_row(spark, sf):
    from slotatlas.operators.extract import class_row
    d = table(spark, sf, "documents").withColumn("t", F.concat_ws(" ", "source", "lang"))
    return d.select("doc_id", *class_row("text", "t", name_chars=100, teacher_chars=60))


@query("prj_meta", with_base(
    "SELECT id, CASE WHEN id % 3 = 0 THEN status ELSE coalesce(CASE WHEN id % 2 = 0 THEN 'old' END, 'no_data') END AS scrape_status, "
    "concat_ws('|', CASE WHEN website <> '' THEN website WHEN id % 2 = 0 THEN 'w0' END, CASE WHEN schedule_url <> '' THEN schedule_url END, "
    "CASE WHEN id % 7 = 0 THEN 'p1' WHEN id % 2 = 0 THEN 'p0' END) AS urls, "
    "CASE WHEN id % 7 = 0 THEN '2026-01-02' WHEN id % 2 = 0 THEN '2025-01-01' END AS last_price_check, '2026-01-02' AS last_scraped, "
    "CASE WHEN schedule_url LIKE '%eversports%' THEN concat('eversports ', schedule_url) WHEN schedule_url LIKE '%momoyoga%' THEN concat('momoyoga ', schedule_url) "
    "WHEN id % 2 = 0 THEN 'fitogram b0' ELSE '' END AS booking_links FROM places"))
def prj_meta(spark, sf):
    from slotatlas.operators.reconcile import merge_meta
    p = places_base(spark, sf).selectExpr(
        "id", "website", "schedule_url", "CASE WHEN id % 3 = 0 THEN status END AS new_status",
        "CASE WHEN id % 7 = 0 THEN 'p1' END AS price_source",
        "CASE WHEN id % 2 = 0 THEN named_struct('scrape_status', 'old', 'last_price_check', '2025-01-01', "
        "'source_urls', map('website', 'w0', 'pricing', 'p0'), 'booking_links', array(named_struct('platform', 'fitogram', 'url', 'b0'))) END AS meta",
        "transform(filter(array('eversports', 'mindbody', 'momoyoga', 'fitogram', 'classpass'), p -> contains(lower(schedule_url), p)), "
        "p -> named_struct('platform', p, 'url', schedule_url)) AS links")
    m = p.select("id", merge_meta("meta", "new_status", "website", "schedule_url", "price_source", F.lit("2026-01-02"), "links").alias("m"))
    u = F.concat_ws("|", *[F.try_element_at(F.col("m.source_urls"), F.lit(k)) for k in ("website", "schedule", "pricing")])
    links = F.array_join(F.transform("m.booking_links", lambda b: F.concat_ws(" ", b["platform"], b["url"])), "|")
    return m.select("id", "m.scrape_status", u.alias("urls"), "m.last_price_check", "m.last_scraped", links.alias("booking_links"))


@query("prj_top_tags", with_places(
    "SELECT id, array_to_string(styles[1:4], ', ') || CASE WHEN len(styles) > 4 THEN ' +' || (len(styles) - 4) ELSE '' END AS card, "
    "array_to_string(styles[1:3], ', ') || CASE WHEN len(styles) > 3 THEN ' +' || (len(styles) - 3) ELSE '' END AS row_text FROM places"))
def prj_top_tags(spark, sf):
    return places(spark, sf).select("id", text.top_tags("styles", 4).alias("card"), text.top_tags("styles", 3).alias("row_text"))


ADDRESS_SQL = ("coalesce(concat_ws(', ', nullif(addresses[1].street, ''), nullif(trim(concat_ws(' ', coalesce(addresses[1].zip, ''), "
               "coalesce(addresses[1].city, ''))), '')), '')")


@query("prj_address_line", with_base(f"SELECT id, {ADDRESS_SQL} AS line FROM places"))
def prj_address_line(spark, sf):
    return places_base(spark, sf).select("id", text.address_line("addresses").alias("line"))


@query("prj_name_sentence", with_places(
    "SELECT id, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN s[1] WHEN n <= 4 THEN array_to_string(s[1:n-1], ', ') || ' und ' || s[n] "
    "ELSE array_to_string(s[1:4], ', ') || ' und ' || (n - 4) || ' weitere' END AS sentence FROM (SELECT id, styles AS s, len(styles) AS n FROM places)"))
def prj_name_sentence(spark, sf):
    return places(spark, sf).select("id", text.name_sentence("styles").alias("sentence"))


@query("prj_link_policy", with_base(
    "SELECT id, CASE WHEN schedule_url = '' THEN 'noopener noreferrer' WHEN contains(schedule_url, 'eversports.') OR contains(schedule_url, 'momoyoga.') "
    "THEN 'sponsored noopener noreferrer' ELSE 'nofollow noopener noreferrer' END AS rel FROM places"))
def prj_link_policy(spark, sf):
    return places_base(spark, sf).select("id", urls.link_policy("schedule_url").alias("rel"))


@query("prj_provenance_stamp", with_both(
    "SELECT class_id, CASE WHEN p.schedule_url <> '' THEN p.schedule_url END AS source, coalesce(p.schedule_url <> '', false) AS verified, "
    "'2026-03-25' AS last_checked FROM slots s LEFT JOIN places p ON p.id = s.place_id AND p.segment <> 'BUILDING'"))
def prj_provenance_stamp(spark, sf):
    from slotatlas.operators.reconcile import stamp_provenance
    p = places_base(spark, sf).filter("segment <> 'BUILDING'").select(F.col("id").alias("place_id"), F.col("schedule_url").alias("url"))
    return stamp_provenance(slots(spark, sf), p, "place_id", "2026-03-25").select("class_id", "source", "verified", "last_checked")


LABELS = {"click": {"de": "Klick", "en": "Click", "fr": "Clic"}, "view": {"de": "Ansicht", "en": "View"}, "error": {"de": "Fehler"}}


@query("prj_label_lookup",
       "SELECT event_id, CASE event_type WHEN 'click' THEN 'Clic' WHEN 'view' THEN 'Ansicht' WHEN 'error' THEN 'Fehler' ELSE event_type END AS label FROM events")
def prj_label_lookup(spark, sf):
    from slotatlas.operators.joins import label_lookup
    return table(spark, sf, "events").select("event_id", label_lookup("event_type", LABELS, "fr").alias("label"))
