"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotatlas.functions import geo, price, text, timefn, urls
from slotatlas.plans import sqltext as Q
from slotatlas.plans.registry import query
from slotatlas.plans.standins import (places, places_base, slots, table, with_base, with_places,
                                      with_slots)


@query("fn_minutes", with_slots(
    f"SELECT class_id, {Q.sql_minutes('time_start')} AS start_min, {Q.sql_minutes('time_end')} AS end_min FROM slots"))
def fn_minutes(spark, sf):
    return slots(spark, sf).select("class_id", timefn.minutes("time_start").alias("start_min"),
                                   timefn.minutes("time_end").alias("end_min"))


@query("fn_duration", with_slots(
    f"SELECT class_id, ({Q.sql_minutes('time_end')}) - ({Q.sql_minutes('time_start')}) AS minutes FROM slots"))
def fn_duration(spark, sf):
    return slots(spark, sf).select("class_id", timefn.duration("time_start", "time_end").alias("minutes"))


@query("fn_end_time", "SELECT event_id, s AS time_start, " + Q.sql_clock("m + CAST(floor(value) AS INTEGER)") +
       " AS time_end FROM (SELECT event_id, value, strftime(ts, '%H:%M') AS s, "
       "CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS m FROM events)")
def fn_end_time(spark, sf):
    e = table(spark, sf, "events").withColumn("time_start", F.date_format("ts", "HH:mm"))
    return e.select("event_id", "time_start",
                    timefn.end_time("time_start", F.floor("value")).alias("time_end"))


_DAYTXT = {
    0: ("Montags", "Kurs lundi", "di"), 1: ("dienstag:", "Le mardi", "Domino Soft"),
    2: ("Mittwoch,", "mercredis", "mi"), 3: ("Donnerstag 9", "jeudi", "so what"),
    4: ("Friday", "venerdì", "fr"), 5: ("Samstag", "sabato", "sa"), 6: ("Sunday", "dimanche", "mois"),
}


def _day_text(wd: str, k: str) -> str:
    return ("CASE {k} " + " ".join(
        f"WHEN {i} THEN CASE {{wd}} " + " ".join(f"WHEN {d} THEN '{t[i]}'" for d, t in _DAYTXT.items()) + " END"
        for i in range(3)) + " END").format(k=k, wd=wd)


@query("fn_day_normalize",
       "SELECT o_orderkey, t AS day_text, CASE k WHEN 0 THEN dn WHEN 1 THEN dn "
       "ELSE CASE t WHEN 'di' THEN 'Tuesday' WHEN 'mi' THEN 'Wednesday' WHEN 'so what' THEN 'Sunday' "
       "WHEN 'fr' THEN 'Friday' WHEN 'sa' THEN 'Saturday' END END AS day_de, "
       "CASE WHEN k < 2 THEN dn END AS day_any FROM (SELECT o_orderkey, o_orderkey % 3 AS k, "
       "dayname(o_orderdate) AS dn, " + _day_text("isodow(o_orderdate) - 1", "o_orderkey % 3") +
       " AS t FROM orders)")
def fn_day_normalize(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.expr(_day_text("weekday(o_orderdate)", "o_orderkey % 3")).alias("day_text"))
    return o.select("o_orderkey", "day_text", timefn.day_normalize("day_text", "de").alias("day_de"),
                    timefn.day_normalize("day_text").alias("day_any"))


@query("fn_weekday", "SELECT o_orderkey, dayname(o_orderdate) AS from_slashes, dayname(o_orderdate) AS from_iso, "
       "dayname(o_orderdate) AS from_stamp, CAST(NULL AS VARCHAR) AS from_noise FROM orders")
def fn_weekday(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        timefn.weekday_of_text(F.concat(F.lit("x, "), F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("from_slashes"),
        timefn.weekday_of_text(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("from_iso"),
        timefn.weekday_of_text(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("from_stamp"),
        timefn.weekday_of_text(F.col("o_orderpriority")).alias("from_noise"))


_PRICE_TEXT = ("CASE l_linenumber % 4 WHEN 0 THEN concat(CAST(CAST(l_quantity AS INTEGER) AS {s}), '-', '99') "
               "WHEN 1 THEN CAST(l_extendedprice AS {s}) WHEN 2 THEN l_returnflag ELSE "
               "concat(CAST(CAST(l_quantity AS INTEGER) AS {s}), ' CHF') END")


@query("fn_parse_price", "SELECT l_orderkey, l_linenumber, price_text, " + Q.sql_parse_price("price_text") +
       " AS price FROM (SELECT l_orderkey, l_linenumber, " + _PRICE_TEXT.format(s="VARCHAR") +
       " AS price_text FROM lineitem)")
def fn_parse_price(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", _PRICE_TEXT.format(s="STRING") + " AS price_text")
    return li.withColumn("price", price.parse_price("price_text"))


@query("fn_int_if_whole", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, " + Q.sql_int_if_whole("l_quantity") +
       " AS qty_text, " + Q.sql_int_if_whole("l_tax") + " AS tax_text FROM lineitem")
def fn_int_if_whole(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax",
        text.int_if_whole("l_quantity").alias("qty_text"), text.int_if_whole("l_tax").alias("tax_text"))


# Fallback classification: the amounts of a place are its four order-based prices.
@query("fn_amount_fallback", with_places("""
SELECT id, CASE WHEN ok THEN single_ END AS single, CASE WHEN ok THEN ten END AS card_10,
  CASE WHEN ok AND len(vals) >= 3 THEN list_max(list_filter(vals, lambda a: a >= 80 AND a <= 400
     AND a > coalesce(single_, 0) AND (ten IS NULL OR a <> ten))) END AS monthly
FROM (SELECT id, vals, len(vals) >= 2 AS ok, single_,
        CASE WHEN single_ IS NULL THEN list_min(list_filter(vals, lambda a: a >= 140 AND a <= 450))
             ELSE list_min(list_filter(vals, lambda a: a >= 140 AND a <= 450 AND a >= 6 * single_ AND a <= 13 * single_)) END AS ten
      FROM (SELECT id, vals, list_min(list_filter(vals, lambda a: a >= 15 AND a <= 55)) AS single_
            FROM (SELECT id, list_filter(list_distinct([single, card_10, monthly, trial]), lambda a: a >= 10 AND a <= 500) AS vals FROM places)))"""))
def fn_amount_fallback(spark, sf):
    p = places(spark, sf).select("id", F.filter(F.array("single", "card_10", "monthly", "trial"),
                                                lambda a: a.isNotNull()).alias("found"))
    r = p.select("id", price.amount_fallback("found", F.lit(True)).alias("r"))
    return r.select("id", "r.single", "r.card_10", "r.monthly")


_NAME_TEXT = ("CASE o_orderkey % 5 WHEN 0 THEN concat('09:00 - 10:15 Uhr ', {p}) "
              "WHEN 1 THEN concat(o_custkey % 9, ') ', {p}) "
              "WHEN 2 THEN concat({p}, ' / 15.09.2025 - 23.03.2026') "
              "WHEN 3 THEN concat('- | ', {p}, ' /') ELSE {p} END")
_WORDS = "substring(o_orderpriority, 3, 20)"


@query("fn_class_name_clean", "SELECT o_orderkey, " + _NAME_TEXT.format(p=_WORDS) + " AS raw, "
       "ltrim(" + _WORDS + ") AS cleaned FROM orders")
def fn_class_name_clean(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", _NAME_TEXT.format(p=_WORDS) + " AS raw")
    return o.withColumn("cleaned", text.class_name_clean("raw"))


@query("fn_glue_flags", with_slots(
    "SELECT class_id, class_name LIKE '10:00Rachel%' AS glued, "
    "regexp_matches(class_name, '[a-z][A-Z][a-z]') AS hump FROM slots"))
def fn_glue_flags(spark, sf):
    return slots(spark, sf).select("class_id", text.has_glued_clock("class_name").alias("glued"),
                                   text.has_camel_hump("class_name").alias("hump"))


@query("fn_strip_tags", "SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM "
       "(SELECT page_id, " + Q.sql_visible_text("html") + " AS t FROM pages)")
def fn_strip_tags(spark, sf):
    t = table(spark, sf, "pages").select("page_id", text.strip_tags("html").alias("t"))
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query("fn_html_escape", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), "
       "'>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM documents")
def fn_html_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.html_escape("text")).alias("escaped_md5"))


@query("fn_url_norm", "SELECT page_id, lower(regexp_replace(url, '/+$', '')) AS url_key FROM pages")
def fn_url_norm(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.url_norm("url").alias("url_key"))


@query("fn_url_rewrite", with_base(
    "SELECT id, CASE WHEN contains(schedule_url, 'eversports.ch/s/') THEN concat(rtrim(schedule_url, '/'), '/classes') "
    "WHEN id % 10 = 7 THEN concat('https://go.mindbodyonline.com/book/widgets/schedules/view/w', id, '/schedule') "
    "ELSE schedule_url END AS listing_url FROM places"))
def fn_url_rewrite(spark, sf):
    p = places_base(spark, sf)
    widget = F.when(F.col("id") % 10 == 7, F.concat(F.lit("w"), F.col("id").cast("string")))
    return p.select("id", urls.url_rewrite("schedule_url", widget).alias("listing_url"))


@query("fn_host", f"SELECT page_id, {Q.sql_host('url')} AS host, split_part({Q.sql_host('url')}, '.', 1) AS slug FROM pages")
def fn_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.host("url").alias("host"), urls.host_label("url").alias("slug"))


@query("fn_platform", with_base(
    "SELECT id, CASE WHEN contains(schedule_url, 'eversports') OR name LIKE '%7' THEN 'Eversports' "
    "WHEN contains(schedule_url, 'momoyoga') THEN 'Momoyoga' WHEN segment = 'MACHINERY' THEN 'MindBody' "
    "ELSE 'website' END AS platform_found FROM places"))
def fn_platform(spark, sf):
    p = places_base(spark, sf)
    html = F.concat(F.lit("<p>"), F.when(F.endswith("name", F.lit("7")), F.lit("EverSports widget"))
                    .when(F.col("segment") == "MACHINERY", F.lit("Healcode")).otherwise(F.lit("plain")), F.lit("</p>"))
    return p.select("id", urls.platform(html, "schedule_url").alias("platform_found"))


_EMBED_HTML = ("CASE o_orderkey % 8 WHEN 0 THEN concat('<a href=\"https://www.eversports.ch/s/place-', o_custkey, '\">') "
               "WHEN 1 THEN concat('<script src=\"x?facilityShortId=f', o_custkey, '\">') "
               "WHEN 2 THEN concat('<a href=\"https://www.sportsnow.ch/go/sn-', o_custkey, '/x\">') "
               "WHEN 3 THEN concat('<a href=\"https://www.momoyoga.com/', CASE WHEN o_custkey % 2 = 0 THEN 'embed' ELSE concat('m', o_custkey) END, '/s\">') "
               "WHEN 4 THEN concat('<i data-studioid=\"', o_custkey, '\">') "
               "WHEN 5 THEN concat('https://app.acuityscheduling.com/schedule.php?owner=', o_custkey) "
               "WHEN 6 THEN concat('https://widget.fitogram.pro/fit', o_custkey) "
               "ELSE concat('https://backoffice.bsport.io/m/b', o_custkey) END")


@query("fn_embed_id",
       "SELECT o_orderkey, CASE k WHEN 0 THEN concat('place-', c) WHEN 1 THEN concat('f', c) END AS eversports, "
       "CASE k WHEN 2 THEN concat('sn-', c) END AS sportsnow, "
       "CASE WHEN k = 3 AND c % 2 = 1 THEN concat('m', c) END AS momoyoga, "
       "CASE k WHEN 4 THEN CAST(c AS VARCHAR) END AS mindbody, CASE k WHEN 5 THEN CAST(c AS VARCHAR) END AS acuity, "
       "CASE k WHEN 6 THEN concat('fit', c) END AS fitogram, CASE k WHEN 7 THEN 'm' END AS bsport "
       "FROM (SELECT o_orderkey, o_orderkey % 8 AS k, o_custkey AS c FROM orders)")
def fn_embed_id(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_EMBED_HTML} AS html")
    return o.select("o_orderkey", *[urls.embed_id("html", n).alias(n) for n in
                                    ("eversports", "sportsnow", "momoyoga", "mindbody", "acuity", "fitogram", "bsport")])


@query("fn_slugify", "SELECT doc_id, md5(" + Q.sql_slugify("text") + ") AS slug_md5, "
       "md5(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS plain_md5 "
       "FROM documents")
def fn_slugify(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.slugify("text")).alias("slug_md5"),
                                                F.md5(text.slugify_plain("text")).alias("plain_md5"))


@query("fn_slug_candidates", with_base(
    "SELECT id, concat_ws('|', CAST(id AS VARCHAR), slug, replace(slug, '-yoga', ''), concat('yoga-', slug), replace(slug, '-', ''), "
    "CASE WHEN website LIKE 'http%' THEN concat('place', id) END) AS candidates "
    "FROM (SELECT id, website, concat('bewegung-', lower(segment), '-yoga') AS slug FROM places)"))
def fn_slug_candidates(spark, sf):
    p = places_base(spark, sf).withColumn("title", F.concat(F.lit("Béwegung "), F.col("segment"), F.lit(" & Yoga!")))
    return p.select("id", F.array_join(text.slug_candidates("id", "title", "website"), "|").alias("candidates"))


@query("fn_slug_from_links", with_base(
    "SELECT id, CASE WHEN contains(schedule_url, 'eversports.ch/s/') THEN concat('place-', id) "
    "WHEN drop_in THEN concat('linked-', id) WHEN id % 4 = 0 THEN concat('meta-', id) END AS slug FROM places"))
def fn_slug_from_links(spark, sf):
    p = places_base(spark, sf)
    ident = F.col("id").cast("string")
    found = F.when(F.col("drop_in"), F.array(F.lit("https://x.example"), F.concat(F.lit("https://www.eversports.ch/s/linked-"), ident)))
    meta = F.when(F.col("id") % 4 == 0, F.array(F.concat(F.lit("https://www.eversports.ch/s/meta-"), ident)))
    return p.select("id", urls.first_link_match("schedule_url", [found, meta], r"eversports\.ch/s/([a-zA-Z0-9_-]+)").alias("slug"))


@query("fn_distance", with_base(
    "SELECT id, round(sqrt((lat - 47.05e0) * (lat - 47.05e0) + (lng - 8.31e0) * (lng - 8.31e0)) * 111, 6) AS planar_km, "
    "round(2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(47.05e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(47.05e0)) "
    "* pow(sin(radians(8.31e0 - lng) / 2), 2))), 6) AS sphere_km FROM places"))
def fn_distance(spark, sf):
    p = places_base(spark, sf)
    here = (F.lit(47.05), F.lit(8.31))
    return p.select("id", F.round(geo.planar_km("lat", "lng", *here), 6).alias("planar_km"),
                    F.round(geo.haversine_km("lat", "lng", *here), 6).alias("sphere_km"))


@query("fn_hash_fraction", "SELECT p_partkey, CAST(CAST(concat('0x', substring(md5(p_name), 1, 8)) AS BIGINT) AS DOUBLE) "
       "/ 4294967295.0e0 AS fraction FROM part")
def fn_hash_fraction(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.hash_fraction("p_name").alias("fraction"))


_TIER = "CASE WHEN segment = 'AUTOMOBILE' THEN 'major' WHEN segment = 'BUILDING' THEN 'medium' ELSE 'small' END"


def _estimate_sql(field: str, i: int) -> str:
    from slotatlas.rules import TIER_RANGES as T
    lo = f"CASE tier WHEN 'major' THEN {T['major'][field][0]} WHEN 'medium' THEN {T['medium'][field][0]} ELSE {T['small'][field][0]} END"
    hi = f"CASE tier WHEN 'major' THEN {T['major'][field][1]} WHEN 'medium' THEN {T['medium'][field][1]} ELSE {T['small'][field][1]} END"
    a = f"round_even({lo} + ({hi} - {lo}) * frac, 0)"
    b = f"CASE WHEN hot THEN round_even({a} * 1.15e0, 0) ELSE {a} END"
    c = f"CASE WHEN n <= 2 THEN round_even(({b}) * 0.90e0, 0) ELSE {b} END"
    return f"CASE WHEN n >= 8 THEN round_even(({c}) * (1 + 0.02e0 * least(n - 7, 5)), 0) ELSE {c} END AS {field}"


@query("fn_tier_estimate", with_places(
    "SELECT id, " + ", ".join(_estimate_sql(f, i) for i, f in enumerate(("single", "card_10", "monthly", "trial"))) +
    ", true AS is_estimated FROM (SELECT id, " + _TIER + " AS tier, len(styles) AS n, "
    "len(list_filter(styles, lambda s: contains(lower(s), 'hot'))) > 0 AS hot, "
    "CAST(CAST(concat('0x', substring(md5(name), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967295.0e0 AS frac "
    "FROM places WHERE single IS NULL)"))
def fn_tier_estimate(spark, sf):
    p = places(spark, sf).filter(F.col("single").isNull()).withColumn("tier", F.expr(_TIER))
    return p.select("id", *[price.tier_estimate(f, "tier", "name", "name", "styles").alias(f)
                            for f in ("single", "card_10", "monthly", "trial")], F.lit(True).alias("is_estimated"))


@query("fn_pct_change", "SELECT o_orderkey, abs(o_totalprice - old) / old * 100 AS pct, "
       "(o_totalprice - old) / old * 100 AS signed_pct, "
       "CASE WHEN abs(o_totalprice - old) / old * 100 > 50 THEN 'high' WHEN abs(o_totalprice - old) / old * 100 > 20 THEN 'medium' END AS severity "
       "FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 1000.0e0 * (o_custkey % 300 + 1) END AS old FROM orders)")
def fn_pct_change(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "old", F.when(F.col("o_custkey") % 10 == 0, F.lit(0.0)).otherwise(1000.0 * (F.col("o_custkey") % 300 + 1)))
    pct = price.pct_change("old", "o_totalprice")
    return o.select("o_orderkey", pct.alias("pct"),
                    price.signed_pct("old", "o_totalprice").alias("signed_pct"),
                    price.change_severity(pct).alias("severity"))


@query("fn_style_match", with_places(
    "SELECT id, coalesce(list_bool_or(list_transform(styles, lambda s: contains(lower(s), 'vinyasa'))), false) AS vinyasa, "
    "coalesce(list_bool_or(list_transform(styles, lambda s: contains(lower(s), 'hot vinyasa') OR contains(lower(s), 'hot yoga'))), false) AS hot "
    "FROM places"))
def fn_style_match(spark, sf):
    from slotatlas.rules import TAG_ROOTS
    return places(spark, sf).select("id", text.tag_matches("styles", TAG_ROOTS["vinyasa"]).alias("vinyasa"),
                                    text.tag_matches("styles", TAG_ROOTS["hot"]).alias("hot"))


@query("fn_other_styles", with_places(
    "SELECT id, array_to_string(list_filter(styles, lambda s: lower(s) NOT IN ('hatha', 'hot hatha'))[1:6], ', ') AS others FROM places"))
def fn_other_styles(spark, sf):
    return places(spark, sf).select("id", text.other_tags("styles", ["Hatha", "Hot Hatha"]).alias("others"))


@query("fn_truncate_words",
       "SELECT conv_id, turn, CASE WHEN length(text) > 150 THEN concat(CASE WHEN regexp_matches(h, '\\s') "
       "THEN regexp_extract(h, '(?s)^(.*)\\s', 1) ELSE h END, '...') ELSE text END AS short FROM "
       "(SELECT *, substring(text, 1, 147) AS h FROM conversations)")
def fn_truncate_words(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.truncate_words("text").alias("short"))


@query("fn_date_format",
       "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS de, strftime(o_orderdate, '%d/%m/%Y') AS en, '' AS bad FROM orders")
def fn_date_format(spark, sf):
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", timefn.format_date(day, "de").alias("de"), timefn.format_date(day, "en").alias("en"),
                    timefn.format_date("o_orderpriority", "de").alias("bad"))


@query("fn_next_occurrence", with_slots(
    "SELECT class_id, strftime(d + to_minutes(s), '%Y-%m-%d %H:%M') AS starts, strftime(d + to_minutes(coalesce(e, s + 60)), '%Y-%m-%d %H:%M') AS ends FROM ("
    "SELECT class_id, CAST(last_checked AS TIMESTAMP) + to_days(CAST(7 AS INTEGER)) AS d, "
    + Q.sql_minutes("time_start") + " AS s, " + Q.sql_minutes("time_end") + " AS e FROM slots WHERE day <> 'Funday')"))
def fn_next_occurrence(spark, sf):
    s = slots(spark, sf).filter("day <> 'Funday'").withColumn("today", F.to_date("last_checked"))
    first, last = timefn.next_occurrence("today", "day", "time_start", "time_end")
    return s.select("class_id", F.date_format(first, "yyyy-MM-dd HH:mm").alias("starts"),
                    F.date_format(last, "yyyy-MM-dd HH:mm").alias("ends"))


@query("fn_horizon", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events "
       "WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-18 00:00:00'")
def fn_horizon(spark, sf):
    e = table(spark, sf, "events")
    start, stop = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-18 00:00:00").cast("timestamp_ntz")
    # The plain range reaches the parquet scan; in_horizon states the rule by day.
    return e.filter((F.col("ts") >= start) & (F.col("ts") < stop)) \
        .filter(timefn.in_horizon("ts", F.lit("2024-01-10").cast("date"))) \
        .select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
