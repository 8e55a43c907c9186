"""Extraction from rendered pages and payloads, checked against their source rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.functions import price, urls
from slotatlas.functions.text import strip_tags
from slotatlas.operators import extract as X
from slotatlas.plans import sqltext as Q
from slotatlas.plans.fixtures import FILLER, N, PRICE_SQL, price_pages, slot_pages, slots_sql
from slotatlas.plans.registry import query
from slotatlas.plans.standins import places_base, table, with_base

ALL = "page_id, pos, day, time_start, time_end, class_name, teacher"
NO_TEACHER = "page_id, pos, day, time_start, time_end, class_name"


def table_pages(spark, sf):
    # one name in three is written with a numeric character reference
    return slot_pages(spark, sf, lambda s, k: [
        "<tr><td>", s["word"], "</td><td>", s["start"], " - ", s["end"], "</td><td><b>",
        F.replace(s["name"], F.lit("Flow"), F.lit("&#70;low")) if k == 1 else s["name"], "</b></td><td>", s["teacher"], "</td></tr>"],
        "<html><table><tr><th>Menu</th></tr><tr><td>Montag</td><td>01:00</td><td>No schedule</td></tr></table>"
        "<table class='x'><tr><th>Tag</th><th>Zeit</th><th>Kurs</th></tr>", "</table></html>")


@query("ex_table", slots_sql("page_id, pos, day, time_start, time_end, class_name"))
def ex_table(spark, sf):
    p = table_pages(spark, sf)
    # The header table of the menu has no schedule word and is skipped.
    return X.extract(p, "page_id", X.table_slots("html")).select("page_id", "pos", "day", "time_start", "time_end", "class_name")


def header_pages(spark, sf):
    return slot_pages(spark, sf, lambda s, k: [
        "<tr class='d'><td colspan=\"6\">", s["word"], " 12.03.</td></tr><tr><td>", s["start"], " - ", s["end"], "</td><td>", s["name"],
        " / 15.09.2025 - 23.03.2026</td><td>2) ", s["teacher"], "</td></tr>"], "<table>", "</table>")


@query("ex_day_header_table", slots_sql(ALL))
def ex_day_header_table(spark, sf):
    return X.extract(header_pages(spark, sf), "page_id", X.day_header_table_slots("html"))


def heading_pages(spark, sf):
    # a plain heading, one with the day in a tag and a long text, one with a tag behind the day
    heads = [("<h3>", "</h3>"), ("<h3><span class='d'><b>", "</b></span>, 12.03., in unserem schoenen Studio an der langen Bahnhofstrasse 12</h3>"),
             ("<dt>", " <small>grosser Saal im zweiten Stock, bitte klingeln</small> hinten</dt>")]
    return slot_pages(spark, sf, lambda s, k: [
        heads[k][0], s["word"], heads[k][1], "<p>", s["start"], " - ", s["end"], " Uhr ", s["name"], " mit ", s["teacher"], "</p><p>Notiz ohne Zeit</p>"],
        "<body>", "<h2>Kontakt</h2><p>08:00 - 18:00 Office</p></body>")


@query("ex_heading_blocks", "SELECT page_id, pos, day, time_start, time_end, concat(class_name, ' mit ', teacher) AS class_name, teacher FROM (" + slots_sql(ALL) + ")")
def ex_heading_blocks(spark, sf):
    return X.extract(heading_pages(spark, sf), "page_id", X.heading_slots("html"))


def inline_pages(spark, sf):
    return slot_pages(spark, sf, lambda s, k: ["<span>", s["word"], " ", s["start"], " - ", s["end"], " ", s["name"], "</span><br>"], "<p>Soft Domino ", "</p>")


@query("ex_inline", slots_sql(NO_TEACHER))
def ex_inline(spark, sf):
    return X.extract(inline_pages(spark, sf), "page_id", X.inline_slots("html")).drop("teacher")


@query("ex_block", slots_sql(NO_TEACHER))
def ex_block(spark, sf):
    return X.extract(inline_pages(spark, sf), "page_id", X.block_slots("html")).drop("teacher")


def line_pages(spark, sf):
    return slot_pages(spark, sf, lambda s, k: (
        [s["word"], ", 3.4., im grossen Saal hinten links neben der Treppe\n", s["start"], " – ", s["end"], "\n", s["name"], "\nBuchen\n"] if k == 0 else
        [s["word"], "\n", s["name"], " ", s["start"], " - ", s["end"], " ", s["teacher"], "\nDetails\n"]), "Stundenplan\n09:00 - 10:00 Kein Tag\n", "Impressum", out="text")


@query("ex_lines", "SELECT page_id, pos, day, time_start, time_end, class_name, CASE WHEN pos = 0 THEN '' ELSE teacher END AS teacher FROM (" + slots_sql(ALL) + ")")
def ex_lines(spark, sf):
    return X.extract(line_pages(spark, sf), "page_id", X.line_slots("text"))


def day_block_pages(spark, sf):
    return slot_pages(spark, sf, lambda s, k: [
        "<section><span class='d'>", "Unser Programm im grossen Saal an der langen Bahnhofstrasse, " if k else "", s["word"],
        " und was sonst noch alles an diesem Tag zu sehen ist</span><div>" if k else "</span><div>", s["start"], " - ", s["end"], " ", s["name"], "</div><div>no time</div></section>"])


@query("ex_day_blocks", slots_sql(NO_TEACHER))
def ex_day_blocks(spark, sf):
    return X.extract(day_block_pages(spark, sf), "page_id", X.day_block_slots("html")).drop("teacher")


def calendar_pages(spark, sf):
    def item(s, k):
        # The first slot names the day, the second the date only, the third relies on the header.
        label = {0: [s["day"], ", 23/03/2026"], 1: [s["word"], " 09/09/2025"], 2: []}[k]
        index = F.array_position(F.array(*[F.lit(d) for d in R.DAYS]), s["day"]).cast("int")
        date = F.concat(F.lit("2024-01-0"), index.cast("string"))
        sr = ["<div class='sr-only'>", *label, "</div>"] if label else []
        return ["<h3 class='calendar__day-header' data-day='", date, "'></h3><li class='calendar__slot open'>", *sr,
                "<div class='session-time'>", s["start"], " . ", s["dur"], " Min</div><div class='session-name'>", s["name"],
                "</div><div class='ellipsis'>3 spots</div><div class='ellipsis'>", s["teacher"], "</div></li>"]
    return slot_pages(spark, sf, item, "<ul>", "</ul>")


@query("ex_calendar_slots", slots_sql(ALL))
def ex_calendar_slots(spark, sf):
    return X.extract(calendar_pages(spark, sf), "page_id", X.calendar_slots("html"))


@query("ex_calendar_slots_plain", slots_sql(ALL))
def ex_calendar_slots_plain(spark, sf):
    return X.extract(calendar_pages(spark, sf), "page_id", X.calendar_slots("html", "plausible"))


def text_before_pages(spark, sf):
    return slot_pages(spark, sf, lambda s, k: ["Some series ends here. ", s["name"], " ", s["day"], "s @ ", s["start"], " weekly. " + FILLER], out="text")


@query("ex_text_before", slots_sql("page_id, pos, day, time_start, class_name"))
def ex_text_before(spark, sf):
    p = X.extract(text_before_pages(spark, sf), "page_id", X.text_before_slots("text"))
    return p.select("page_id", "pos", "day", "time_start", "class_name")


# --- payloads ---------------------------------------------------------------------------

EVENTS_SQL = ("SELECT event_id AS page_id, dayname(ts) AS day, strftime(ts, '%H:%M') AS time_start, "
              "strftime(ts + to_minutes(CAST({m} AS BIGINT)), '%H:%M') AS time_end, event_type AS class_name, {t} AS teacher FROM events")
MINS = "15 + CAST(floor(value) AS INTEGER) % 60"


def ev(spark, sf):
    """Events with an end below 24 h, as source rows of payloads."""
    e = table(spark, sf, "events").withColumn("mins", F.expr("15 + int(floor(value)) % 60"))
    return e.withColumn("stop", F.col("ts") + F.make_dt_interval(mins=F.col("mins")))


def payload_slots(df, slots):
    return X.extract(df, "page_id", slots).drop("pos")


@query("ex_sessions_json", EVENTS_SQL.format(m=MINS, t="CASE event_id % 3 WHEN 0 THEN concat('Owner ', user_id) WHEN 1 THEN concat('Staff ', user_id) ELSE '' END"))
def ex_sessions_json(spark, sf):
    def local(c):
        return F.struct(F.year(c).alias("year"), F.month(c).alias("monthOfYear"), F.dayofmonth(c).alias("dayOfMonth"),
                        F.hour(c).alias("hourOfDay"), F.minute(c).alias("minutesOfHour"))

    def moment(c):
        by_field = F.col("event_id") % 2 == 0
        return F.struct(F.when(by_field, local(c)).alias("localDateTime"),
                        F.when(~by_field, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("timestamp"))
    who = F.col("user_id").cast("string")
    session = F.struct(F.col("event_type").alias("title"), moment("ts").alias("start"), moment("stop").alias("end"),
                       F.when(F.col("event_id") % 3 == 0, F.array(F.struct(F.concat(F.lit("Owner "), who).alias("scheduleOwnerName")))).alias("affectedSchedules"),
                       F.when(F.col("event_id") % 3 == 1, F.array(F.struct(F.concat(F.lit("Staff "), who).alias("name")))).alias("staffMembers"))
    p = ev(spark, sf).select(F.col("event_id").alias("page_id"), F.to_json(F.struct(F.array(session).alias("sessions"))).alias("payload"))
    return payload_slots(p, X.sessions_json("payload"))


_EV_MIN = "hour(ts) * 60 + minute(ts) + CASE event_id % 4 WHEN 3 THEN 60 ELSE " + MINS + " END"


# A given end is a clock reading; start + duration runs past 24:00.
@query("ex_events_json",
       "SELECT event_id AS page_id, dayname(ts) AS day, strftime(ts, '%H:%M') AS time_start, CASE WHEN event_id % 4 IN (1, 2) THEN strftime(ts + to_minutes(CAST(" + MINS + " AS BIGINT)), '%H:%M') "
       "ELSE " + Q.sql_clock(_EV_MIN) + " END AS time_end, event_type AS class_name, CASE event_id % 4 WHEN 2 THEN concat('Staff ', user_id) ELSE '' END AS teacher FROM events")
def ex_events_json(spark, sf):
    iso, stop = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("stop", "yyyy-MM-dd'T'HH:mm:ss")
    name, k = F.col("event_type"), F.col("event_id") % 4
    a = F.to_json(F.struct(F.array(F.struct(name.alias("name"), iso.alias("start"), F.col("mins").alias("duration"))).alias("data")))
    b = F.to_json(F.array(F.struct(name.alias("title"), iso.alias("startTime"), stop.alias("end"))))
    c = F.to_json(F.struct(F.array(F.struct(name.alias("ClassName"), iso.alias("StartDateTime"), F.date_format("stop", "HH:mm").alias("EndTime"),
                                            F.concat(F.lit("Staff "), F.col("user_id").cast("string")).alias("StaffName"))).alias("Classes")))
    d = F.to_json(F.struct(F.array(F.struct(name.alias("name"), iso.alias("date_start"))).alias("results")))
    p = ev(spark, sf).select(F.col("event_id").alias("page_id"), F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(d).alias("payload"))
    return payload_slots(p, X.events_json("payload"))


@query("ex_graphql_nodes", EVENTS_SQL.format(m=MINS, t="concat('Staff ', user_id)") + " WHERE event_type <> 'error'")
def ex_graphql_nodes(spark, sf):
    node = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+01:00'").alias("start"),
                    F.date_format("stop", "yyyy-MM-dd'T'HH:mm:ss'+01:00'").alias("end"), (F.col("event_type") == "error").alias("isCancelled"),
                    F.struct(F.concat(F.lit("Staff "), F.col("user_id").cast("string")).alias("name")).alias("teacher"))
    body = F.struct(F.struct(F.struct(F.struct(F.array(node).alias("nodes")).alias("activities")).alias("widget")).alias("data"))
    p = ev(spark, sf).select(F.col("event_id").alias("page_id"), F.to_json(body).alias("payload"))
    return payload_slots(p, X.graphql_nodes("payload"))


@query("ex_appointments", "SELECT page_id, CASE WHEN pos = 2 THEN 'TBC' ELSE day END AS day, time_start, class_name FROM (" + slots_sql() + ")")
def ex_appointments(spark, sf):
    p = slot_pages(spark, sf, lambda s, k: [
        '{"name":"', s["name"], '","description":"', *(["Kurs um "] if k == 2 else [s["word"], " um "]), s["start"], '"},{"name":"Massage","description":"Montag 09:00"}' + ("," if k < N - 1 else "")],
        'x = {"appointmentTypes": {"Kurse":[', ']}, "calendars": 1}')
    return X.extract(p, "page_id", X.appointments("html")).select("page_id", "day", "time_start", "class_name")


@query("ex_cms_items", slots_sql("page_id, day, time_start, class_name"))
def ex_cms_items(spark, sf):
    def item(s, k):
        return ['{"title":"', s["name"], '","body":"jeweils ', s["word"], ' ', s["start"].substr(1, 2), '.', s["start"].substr(4, 2), '","excerpt":"fein"}' + ("," if k < N - 1 else "")]
    p = slot_pages(spark, sf, item, '{"items":[', "]}", "payload")
    wrapped = F.when(F.col("page_id") % 2 == 0, F.col("payload")).otherwise(F.concat(F.lit('{"collection":'), F.col("payload"), F.lit("}")))
    return X.extract(p.select("page_id", wrapped.alias("payload")), "page_id", X.cms_items("payload")).select("page_id", "day", "time_start", "class_name")


@query("ex_flat_items", slots_sql("page_id, day, time_start, time_end, class_name, teacher"))
def ex_flat_items(spark, sf):
    p = slot_pages(spark, sf, lambda s, k: [
        '{"day":"', s["day"], '","' + ("time" if k == 1 else "start_time") + '":"', s["start"], '","end_time":"', s["end"], '","name":"', s["name"],
        '","teacher":"', s["teacher"], '"}' + ("," if k < N - 1 else "")], "[", "]", "payload")
    return X.extract(p, "page_id", X.flat_items("payload")).drop("pos")


@query("ex_recurrence", """
SELECT o_orderkey AS page_id, d AS day, '09:00' AS time_start, '10:15' AS time_end, concat('Flow ', o_orderpriority) AS class_name,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price
FROM (SELECT *, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['Monday', 'Friday'] ELSE [dayname(o_orderdate)] END) AS d FROM orders WHERE o_orderstatus <> 'P')""")
def ex_recurrence(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    event = F.struct(F.lit("CLASS").alias("type"), F.when(F.col("o_orderstatus") == "P", F.lit("CANCELLED")).otherwise(F.lit("CONFIRMED")).alias("status"),
                     F.concat(F.lit("Flow "), F.col("o_orderpriority")).alias("title"), F.col("o_orderkey").cast("string").alias("scheduleId"),
                     F.struct(F.concat(day, F.lit("T09:00:00")).alias("localDate")).alias("start"), F.struct(F.concat(day, F.lit("T10:15:00")).alias("localDate")).alias("end"),
                     F.struct(F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("MONDAY"), F.lit("FRIDAY"))).otherwise(F.array().cast("array<string>")).alias("days")).alias("recurrenceRule"))
    service = F.struct((F.col("o_orderkey") % 5 == 0).alias("hidden"), F.struct(F.col("o_orderkey").cast("string").alias("id")).alias("schedule"),
                       F.struct(F.struct(F.struct(F.col("o_totalprice").cast("string").alias("value"), F.lit("CHF").alias("currency")).alias("price")).alias("fixed")).alias("payment"))
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.to_json(F.struct(F.array(event, event).alias("events"), F.array(service).alias("services"))).alias("payload"))
    # The event comes twice; the second one repeats the same slots and is dropped.
    return p.select("page_id", F.inline(X.clean(X.recurrence_slots("payload")))).drop("teacher")


def mixed_pages(spark, sf):
    """Every page in one of four layouts; headings pages also hold what later strategies would find."""
    kind = F.col("page_id") % 4
    pages = [heading_pages(spark, sf), table_pages(spark, sf), inline_pages(spark, sf), line_pages(spark, sf).withColumnRenamed("text", "html")]
    out = pages[0].filter(kind == 0)
    for i, p in enumerate(pages[1:], 1):
        out = out.unionByName(p.filter(kind == i))
    return out


@query("ex_cascade", "SELECT page_id, CAST(CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 5 END AS INTEGER) AS strategy, day, time_start, time_end FROM (" + slots_sql() + ")")
def ex_cascade(spark, sf):
    from slotatlas.operators.html import block_lines
    strategies = [X.heading_slots("html"), X.table_slots("html"), X.inline_slots("html"), X.block_slots("html"),
                  X.line_slots(block_lines("html"))]
    best = mixed_pages(spark, sf).select("page_id", X.cascade(strategies).alias("best"))
    return best.select("page_id", "best.strategy", F.inline("best.slots")).select("page_id", "strategy", "day", "time_start", "time_end")


# --- prices -----------------------------------------------------------------------------

@query("fn_amounts", "SELECT p_partkey, unnest([single, monthly, card_10] || CASE WHEN p_partkey % 3 = 0 THEN [] ELSE [trial] END) AS amount FROM (" + PRICE_SQL + ")")
def fn_amounts(spark, sf):
    p = price_pages(spark, sf).select("p_partkey", strip_tags("html").alias("t"))
    return p.select("p_partkey", F.explode(price.amounts("t")).alias("amount"))


@query("fn_near_keyword", "SELECT p_partkey, single, card_10, monthly, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE trial END AS trial FROM (" + PRICE_SQL + ")")
def fn_near_keyword(spark, sf):
    p = price_pages(spark, sf).select("p_partkey", strip_tags("html").alias("t"))
    return p.select("p_partkey", *[price.near_keyword("t", R.PRICE_KEYWORDS[f]).alias(f) for f in R.PRICE_FIELDS])


@query("ex_prices", PRICE_SQL)
def ex_prices(spark, sf):
    return X.page_prices(price_pages(spark, sf), "html", "url").select("p_partkey", "p.*")


@query("fn_free_trial", "SELECT p_partkey, p_partkey % 4 IN (0, 1) AS is_free FROM part")
def fn_free_trial(spark, sf):
    k = F.col("p_partkey") % 4
    body = F.when(k == 0, F.lit("Eine Probestunde ist bei uns gratis zu haben")).when(k == 1, F.lit("Kostenlos: die erste Lektion")) \
        .when(k == 2, F.lit("Probestunde buchen. Parkplatz gratis")).otherwise(F.lit("config.freeTrial = \"true\" trial free"))
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", body, "p_brand").alias("t"))
    return p.select("p_partkey", price.free_trial("t").alias("is_free"))


@query("fn_category_context", "SELECT p_partkey, CAST(p_size + 10 AS DOUBLE) AS single, CASE WHEN p_partkey % 2 = 0 THEN floor(p_retailprice / 4) END AS card_10, "
       "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 99.5e0 END AS abo, CAST(NULL AS DOUBLE) AS monthly FROM part")
def fn_category_context(spark, sf):
    ten = F.floor(F.col("p_retailprice") / 4).cast("string")
    html = F.concat(F.lit("<body><div><b>Einzeleintritt</b> <i>CHF 12</i></div><div>Drop-In: CHF "), (F.col("p_size") + 10).cast("string"), F.lit(" pro Mal</div>"),
                    F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<li>10er-Karte CHF "), ten, F.lit("</li>"))).otherwise(F.lit("<li>Parkplatz CHF 20</li>")),
                    F.lit("<li>Mitgliedschaft CHF 99,5 und CHF 900</li></body>"))
    p = table(spark, sf, "part").select("p_partkey", X.category_prices(html).alias("c"))
    return p.select("p_partkey", "c.single", "c.card_10", "c.abo", "c.monthly")


@query("ex_service_prices", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(10 + p_size % 45 AS DOUBLE) END AS single FROM part")
def ex_service_prices(spark, sf):
    low = 10 + F.col("p_size") % 45
    k = F.col("p_partkey") % 4

    def money(v, currency="CHF"):
        return F.struct(v.alias("price"), F.lit(currency).alias("currency"))
    def payment(fixed=None, varied=None):
        none = F.lit(None).cast("struct<price:double,currency:string>")
        return F.struct(F.struct((none if fixed is None else fixed).alias("fixed"), (none if varied is None else varied).alias("varied")).alias("payment"))
    plain = F.to_json(F.struct(F.array(payment(fixed=money(low + 30.0)), payment(varied=money(low + 0.0))).alias("services")))
    nested = F.to_json(F.struct(F.array(F.struct(F.struct(F.struct(F.struct(low.cast("string").alias("value"), F.lit("CHF").alias("currency")).alias("price")).alias("fixed")).alias("payment"))).alias("services")))
    euro = F.to_json(F.struct(F.array(F.struct(F.struct(money(low + 0.0, "EUR").alias("fixed")).alias("payment"))).alias("services")))
    p = table(spark, sf, "part").select("p_partkey", F.when(k < 2, plain).when(k == 2, nested).otherwise(euro).alias("payload"))
    return p.select("p_partkey", X.service_prices("payload").alias("single"))


# --- links on the given pages --------------------------------------------------------------

_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
LINKS_SQL = (f"SELECT DISTINCT page_id, CASE WHEN href LIKE 'http%' THEN href ELSE concat({_ORIGIN}, href) END AS link FROM "
             "(SELECT page_id, url, trim(replace(unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>.*?</a>', 1)), '&amp;', '&')) AS href FROM pages) "
             "WHERE href <> '' AND href NOT LIKE '#%' AND (href LIKE '/%' OR lower(" + _ORIGIN.replace("url", "href") + f") = lower({_ORIGIN}))")


def site_links(spark, sf, words=None):
    return X.page_links(table(spark, sf, "pages"), "page_id", "url", "html", words)


@query("fn_links", LINKS_SQL)
def fn_links(spark, sf):
    return site_links(spark, sf)


@query("src_pages", "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages")
def src_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("n_chars"))


_WORDS = ["an", "tion", "er"]


@query("ex_booking_links",
       "SELECT page_id, false AS has_schedule_table, platform, href AS url FROM (SELECT page_id, trim(replace(unnest(regexp_extract_all(html, "
       "'(?is)<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>.*?</a>', 1)), '&amp;', '&')) AS href FROM pages), (VALUES ('an'), ('tion'), ('er')) p(platform) "
       "WHERE contains(lower(href), platform)")
def ex_booking_links(spark, sf):
    return X.booking_links(table(spark, sf, "pages"), "page_id", "html", _WORDS)


@query("ex_booking_platforms", with_base(
    "SELECT id AS page_id, id % 3 = 0 AS has_schedule_table, p.platform AS platform, schedule_url AS url FROM places, (VALUES ('eversports'), ('momoyoga')) p(platform) "
    "WHERE contains(lower(schedule_url), p.platform)"))
def ex_booking_platforms(spark, sf):
    """Pages of places: their own links, a booking link in the one of three quotings, a table that is a schedule for every third."""
    href = F.element_at(F.array(F.concat(F.lit('"'), "schedule_url", F.lit('"')), F.concat(F.lit("'"), "schedule_url", F.lit("'")),
                                F.concat(F.lit('"'), "schedule_url", F.lit('" class="b"'))), (F.col("id") % 3 + 1).cast("int"))
    head = F.when(F.col("id") % 3 == 0, F.lit("<tr><th>Montag</th><th>Dienstag</th></tr>")).otherwise(F.lit("<tr><th>Menu</th></tr>"))
    pages = places_base(spark, sf).select(F.col("id").alias("page_id"), F.concat(
        F.lit("<p><a href='"), "website", F.lit("'>Home</a><a href="), href, F.lit("><b>Book</b></a></p><table>"), head,
        F.lit("<tr><td>momoyoga eversports</td></tr></table>")).alias("html"))
    return X.booking_links(pages, "page_id", "html", R.LINK_PLATFORMS)


FRONTIER_SQL = f"""
WITH links AS ({LINKS_SQL}), sites AS (SELECT page_id, {_ORIGIN} AS origin, lower(regexp_replace(url, '/+$', '')) AS seen FROM pages),
found AS (SELECT page_id, url_key, link, row_number() OVER (PARTITION BY page_id ORDER BY link) AS ord FROM
  (SELECT page_id, lower(regexp_replace(link, '/+$', '')) AS url_key, min(link) AS link FROM links GROUP BY 1, 2)),
cand AS (SELECT page_id, link, url_key, 0 AS src, ord FROM found UNION ALL
  SELECT page_id, concat(origin, path), lower(concat(origin, path)), 1, ord FROM sites, (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(R.SCHEDULE_SUBPATHS))}) s(ord, path)),
kept AS (SELECT c.page_id, c.url_key, arg_min(c.link, c.src * 1000000 + c.ord) AS link, min(c.src * 1000000 + c.ord) AS o FROM cand c JOIN sites s ON s.page_id = c.page_id
  WHERE c.url_key <> s.seen GROUP BY 1, 2)
SELECT page_id, link, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o, link) AS rn FROM kept)"""


@query("ex_link_frontier", FRONTIER_SQL)
def ex_link_frontier(spark, sf):
    p = table(spark, sf, "pages")
    sites = p.select("page_id", urls.url_origin("url").alias("origin"))
    visited = p.select("page_id", urls.url_norm("url").alias("url_key"))
    return X.link_frontier(sites, site_links(spark, sf), visited, "page_id", R.SCHEDULE_SUBPATHS)
