"""Sources, sinks and publish-ready facts over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotatlas import schemas
from slotatlas.operators import joins, publish, ranking, stats
from slotatlas.plans.joins import CROSS_SQL, PAIRS_SQL, STYLE_CITY_SQL, _roots_sql, snapshot, style_city_rows
from slotatlas.plans.quality import ALL_SQL, all_findings
from slotatlas.plans import sqltext as Q
from slotatlas.plans.registry import query
from slotatlas.plans.standins import (PLACES_SQL, places, places_base, slots, table, with_base, with_base_slots, with_both,
                                      with_places)
from slotatlas.session import run_dir
from slotatlas.sources import readers, writers

ACTIVE = "coalesce(active, true)"
PART_DIR = r"part=([^/]+)/"


# --- sources (written by Spark from the tables, then read back) ------------------------

def studio_records(spark, sf):
    """Places in the record layout of the catalog envelopes."""
    p = places(spark, sf)
    return p.select(
        "part", F.col("id").cast("string").alias("id"), "name", "website", "schedule_url",
        F.transform("addresses", lambda a: F.struct(a["street"].alias("street"), a["zip"].alias("zip"), a["city"].alias("city"), F.lit("").alias("label"))).alias("addresses"),
        "styles", "drop_in", "languages", F.col("features").alias("special_features"), "lat", "lng", "active",
        F.when(F.col("single").isNotNull(), F.struct("single", "card_10", "monthly", "trial", F.lit("CHF").alias("currency"), "verified")).alias("pricing"))


@query("src_catalog", with_places(
    "SELECT part, CAST(id AS VARCHAR) AS id, name, active, single, CAST(len(styles) AS INTEGER) AS n_tags, addresses[1].zip AS zip, '2026-03-25' AS envelope_last_updated FROM places "))
def src_catalog(spark, sf):
    path = run_dir(spark, "catalog")
    docs = writers.envelopes(studio_records(spark, sf), "part", "studios", "2026-03-25", "id")
    docs.drop("doc").write.partitionBy("part").json(path)
    rows = readers.read_catalog(spark, path, part_pattern=PART_DIR, multi_line=False)
    return rows.select("part", "id", "name", "active", F.col("pricing.single").alias("single"), F.size("styles").alias("n_tags"),
                       F.get(F.col("addresses"), F.lit(0))["zip"].alias("zip"), "envelope_last_updated")


@query("src_schedule", with_base_slots(
    "SELECT part, CAST(place_id AS VARCHAR) AS studio_id, day, time_start, time_end, class_name, teacher, level, s.verified FROM slots s JOIN places p ON p.id = s.place_id"))
def src_schedule(spark, sf):
    path = run_dir(spark, "schedule")
    p = places_base(spark, sf).select("part", F.col("id").alias("place_id"))
    rows = slots(spark, sf).join(p, "place_id").select("part", F.col("place_id").cast("string").alias("studio_id"), "day", "time_start",
                                                       "time_end", "class_name", "teacher", "level", "verified", "class_id")
    writers.envelopes(rows, "part", "classes", "2026-03-25", "class_id").drop("doc").write.partitionBy("part").json(path)
    out = readers.read_schedule(spark, path, part_pattern=PART_DIR, multi_line=False)
    return out.select("part", "studio_id", "day", "time_start", "time_end", "class_name", "teacher", "level", "verified")


@query("src_dimension", "SELECT n_name AS id, CASE n_name WHEN 'NATION_0' THEN 'zero' ELSE n_name END AS data_key, concat('de ', n_name) AS name_de, r_name AS capital FROM nation JOIN region ON r_regionkey = n_regionkey")
def src_dimension(spark, sf):
    path = run_dir(spark, "dimension")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rec = F.struct(F.col("n_name").alias("id"), F.struct(F.concat(F.lit("de "), F.col("n_name")).alias("de")).alias("name"), F.col("r_name").alias("capital"))
    n.select(F.array(rec).alias("cantons")).write.json(path)
    d = readers.read_dimension(spark, path, {"NATION_0": "zero"}, multi_line=False)
    return d.select("id", "data_key", F.col("name.de").alias("name_de"), "capital")


@query("src_dynamic_map",
       "SELECT CASE WHEN p_partkey % 3 = 2 THEN p_brand END AS part, concat('p', p_partkey, x.s) AS id, CAST(p_size AS VARCHAR) AS single, "
       "CASE WHEN x.s = 'a' THEN '25-35' END AS card_10 FROM part, (VALUES ('a'), ('b')) x(s)")
def src_dynamic_map(spark, sf):
    def rec(s):
        body = F.struct(F.col("p_size").cast("string").alias("single"), *([F.lit("25-35").alias("card_10")] if s == "a" else []))
        return F.concat(F.lit('"p'), F.col("p_partkey").cast("string"), F.lit(f'{s}":'), F.to_json(body))
    pair = F.concat(F.lit("{"), rec("a"), F.lit(","), rec("b"), F.lit("}"))
    k = F.col("p_partkey") % 3
    doc = F.when(k == 0, F.concat(F.lit('{"_meta":{"x":1},"date":"2026",'), F.substr(pair, F.lit(2)))) \
        .when(k == 1, F.concat(F.lit('{"total":3,"studios":'), pair, F.lit("}"))) \
        .otherwise(F.concat(F.lit('{"'), F.col("p_brand"), F.lit('":'), pair, F.lit("}")))
    path = run_dir(spark, "maps")
    table(spark, sf, "part").select(doc.alias("value")).write.text(path)
    return readers.dynamic_map(spark.read.text(path), "value", ["single", "card_10"])


@query("src_tolerant", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'read' AS state FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL "
       "SELECT concat('broken ', c_custkey), 'quarantined' FROM customer WHERE c_mktsegment = 'BUILDING'")
def src_tolerant(spark, sf):
    path = run_dir(spark, "tolerant")
    good = F.concat(F.lit('{"last_updated":"x","studios":[{"id":"'), F.col("c_custkey").cast("string"), F.lit('"}]}'))
    line = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("broken "), F.col("c_custkey").cast("string"))).otherwise(good)
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    rows, bad = readers.read_envelopes(spark, path, schemas.PLACE_ENVELOPE, "studios", multi_line=False)
    return rows.select("id", F.lit("read").alias("state")).unionByName(bad.select(F.col("record").alias("id"), F.lit("quarantined").alias("state")))


@query("src_envelope_decode", "SELECT doc_id, md5(text) AS text_md5, CASE WHEN lang = 'fr' THEN 'plain' ELSE 'encoded' END AS origin FROM documents")
def src_envelope_decode(spark, sf):
    d = table(spark, sf, "documents")
    encoded = d.filter("lang <> 'fr'").select("doc_id", readers.encode_payload("text").alias("e")) \
        .unionByName(d.filter("lang = 'fr'").select("doc_id", F.lit("not base64!").alias("e")))
    out = readers.decode_envelopes(encoded, d.select("doc_id", "text"), "doc_id")
    return out.select("doc_id", F.md5("text").alias("text_md5"), "origin")


@query("snk_envelope_encode", "SELECT doc_id, md5(reverse(base64(encode(text)))) AS encoded_md5 FROM documents")
def snk_envelope_encode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(readers.encode_payload("text")).alias("encoded_md5"))


# --- sinks ------------------------------------------------------------------------------

@query("snk_partitioned", "SELECT n_name AS part, count(*) AS n, CASE WHEN n_name IN ('NATION_1', 'NATION_2') THEN '2026-02-01' ELSE '2026-01-01' END AS last_updated "
       "FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name NOT IN ('NATION_1', 'NATION_2') OR c_acctbal > 0 GROUP BY n_name")
def snk_partitioned(spark, sf):
    path = run_dir(spark, "partitioned")
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", F.col("n_name").alias("part"))
    writers.write_partitioned(c, path, "part", "2026-01-01")
    writers.write_partitioned(c.filter("part IN ('NATION_1', 'NATION_2') AND c_acctbal > 0"), path, "part", "2026-02-01")
    return spark.read.parquet(path).groupBy("part", "last_updated").agg(F.count("*").alias("n"))


@query("snk_snapshot", "SELECT l_partkey AS part_id, min(l_extendedprice / l_quantity) AS lo FROM lineitem WHERE year(l_shipdate) % 2 = 1 GROUP BY l_partkey")
def snk_snapshot(spark, sf):
    path = run_dir(spark, "snapshot")
    for year in (1996, 1997):
        writers.write_snapshot(snapshot(spark, sf, year).select("part_id", "lo"), path, f"run-{year}")
    return writers.read_snapshot(spark, path).select("part_id", "lo")


CHANGES_SQL = "SELECT CAST(part_id AS VARCHAR) AS studio_id, field, old_value, new_value FROM (" + PAIRS_SQL + ") WHERE old_value <> new_value"


def change_rows(spark, sf, fields):
    d = joins.field_diff(snapshot(spark, sf, 1996), snapshot(spark, sf, 1997), ["part_id"], fields)
    return d.select(F.lit("2026-03-25").alias("timestamp"), F.col("part_id").cast("string").alias("studio_id"), F.lit("x").alias("canton"),
                    "field", "old_value", "new_value", F.lit("crawl").alias("source"))


@query("snk_changelog", CHANGES_SQL)
def snk_changelog(spark, sf):
    path = run_dir(spark, "changelog")
    writers.append_changes(change_rows(spark, sf, ["lo", "hi"]), path)
    writers.append_changes(change_rows(spark, sf, ["mean"]), path)
    return readers.read_changelog(spark, path).select("studio_id", "field", "old_value", "new_value")


@query("src_changelog", "SELECT field, CASE WHEN new_value > old_value THEN 'up' ELSE 'down' END AS direction, count(*) AS n FROM (" + CHANGES_SQL + ") GROUP BY 1, 2")
def src_changelog(spark, sf):
    path = run_dir(spark, "changelog")
    log = readers.read_changelog(spark, path)  # missing: empty
    writers.append_changes(change_rows(spark, sf, ["lo", "hi", "mean"]), path)
    log = log.unionByName(readers.read_changelog(spark, path))
    up = F.when(F.col("new_value") > F.col("old_value"), F.lit("up")).otherwise(F.lit("down"))
    return log.groupBy("field", up.alias("direction")).agg(F.count("*").alias("n"))


@query("snk_run_report", "SELECT user_id, concat('{\"success\":', count(*) FILTER (event_type <> 'error'), ',\"fail\":', count(*) FILTER (event_type = 'error'), ',\"new_rows\":', "
       "CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (event_type <> 'error'), 0) AS BIGINT), '}') AS doc FROM events GROUP BY user_id")
def snk_run_report(spark, sf):
    t = stats.run_totals(table(spark, sf, "events"), "user_id", F.col("event_type") != "error", F.floor("value"))
    return t.select("user_id", F.to_json(F.struct("success", "fail", "new_rows")).alias("doc"))


@query("snk_verification", with_base_slots(
    "SELECT id, schedule_url, status, platform, status = 'success' AS has_static_schedule, n AS existing_classes FROM places LEFT JOIN "
    "(SELECT place_id, count(*) AS n FROM slots GROUP BY place_id) ON place_id = id").replace("n AS existing", "CASE WHEN status = 'success' THEN coalesce(n, 0) END AS existing"))
def snk_verification(spark, sf):
    counts = slots(spark, sf).groupBy(F.col("place_id").alias("id")).agg(F.count("*").alias("n"))
    p = places_base(spark, sf).join(counts, "id", "left")
    ok = F.col("status") == "success"
    return p.select("id", "schedule_url", "status", "platform", ok.alias("has_static_schedule"),
                    F.when(ok, F.coalesce("n", F.lit(0))).alias("existing_classes"))


def _jstr(key, v):
    return f"concat('\"{key}\":\"', {v}, '\"')"


_ADDR = ("concat('{\"@type\":\"PostalAddress\",\"streetAddress\":\"', coalesce(addresses[1].street, ''), '\",\"postalCode\":\"', coalesce(addresses[1].zip, ''), "
         "'\",\"addressLocality\":\"', coalesce(addresses[1].city, ''), '\",\"addressCountry\":\"CH\"}')")
_SINGLE = Q.sql_int_if_whole("single")


@query("snk_jsonld_business", with_places(
    "SELECT id, concat('{\"@context\":\"https://schema.org\",\"@type\":\"LocalBusiness\",\"name\":\"', name, '\",\"address\":', " + _ADDR + ", "
    "CASE WHEN website <> '' THEN concat(',', " + _jstr("url", "website") + ") ELSE '' END, CASE WHEN phone <> '' THEN concat(',', " + _jstr("telephone", "phone") + ") ELSE '' END, "
    "',\"geo\":{\"@type\":\"GeoCoordinates\",\"latitude\":', CAST(CAST(lat AS DECIMAL(9,5)) AS VARCHAR), ',\"longitude\":', CAST(CAST(lng AS DECIMAL(9,5)) AS VARCHAR), '}', "
    "CASE WHEN coalesce(single, 0) <> 0 THEN concat(',\"priceRange\":\"CHF ', " + _SINGLE + ", ' (Einzellektion)\"') ELSE '' END, '}') AS doc FROM places WHERE len(addresses) > 0"))
def snk_jsonld_business(spark, sf):
    return publish.business_docs(places(spark, sf))


@query("snk_jsonld_event", with_both(
    "SELECT part, CAST(rn AS INTEGER) AS rank, class_id, concat('{\"@context\":\"https://schema.org\",\"@type\":\"Event\",\"name\":\"', class_name, '\",\"eventSchedule\":{\"@type\":\"Schedule\",\"byDay\":\"https://schema.org/', day, "
    "'\",\"startTime\":\"', time_start, '\",\"endTime\":\"', time_end, '\",\"repeatFrequency\":\"P1W\"},\"location\":{\"@type\":\"Place\",\"name\":\"', name, '\",\"address\":', " + _ADDR + ", '},\"organizer\":{\"@type\":\"Organization\",\"name\":\"', name, '\"', "
    "CASE WHEN website <> '' THEN concat(',', " + _jstr("url", "website") + ") ELSE '' END, '}', CASE WHEN website <> '' THEN concat(',', " + _jstr("url", "website") + ") ELSE '' END, "
    "CASE WHEN teacher <> '' THEN concat(',\"performer\":{\"@type\":\"Person\",\"name\":\"', teacher, '\"}') ELSE '' END, "
    "CASE WHEN coalesce(single, 0) <> 0 THEN concat(',\"offers\":{\"@type\":\"Offer\",\"price\":\"', " + _SINGLE + ", '\",\"priceCurrency\":\"CHF\"}') ELSE '' END, '}') AS doc FROM ("
    f"SELECT s.*, p.part, p.name, p.website, p.addresses, p.single, row_number() OVER (PARTITION BY p.part ORDER BY {Q.sql_day_index('day')}, {Q.sql_minutes('time_start')} NULLS LAST, place_id, class_id) AS rn "
    "FROM slots s LEFT JOIN places p ON p.id = s.place_id) WHERE rn <= 25"))
def snk_jsonld_event(spark, sf):
    return publish.event_docs(slots(spark, sf), places(spark, sf))


TOP_SQL = ("(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT trim(x) AS v FROM (SELECT {arr} AS x FROM places q WHERE q.part = p.part) WHERE trim(x) <> '' ORDER BY v LIMIT {n}))")


@query("snk_jsonld_faq", with_both(
    "SELECT part, concat('{\"@context\":\"https://schema.org\",\"@type\":\"FAQPage\",\"mainEntity\":[{\"@type\":\"Question\",\"name\":\"How many places are there in ', part, '?\",\"acceptedAnswer\":{\"@type\":\"Answer\",\"text\":\"', n_places, ' places with ', n_slots, ' weekly slots.\"}},"
    "{\"@type\":\"Question\",\"name\":\"Which kinds are offered in ', part, '?\",\"acceptedAnswer\":{\"@type\":\"Answer\",\"text\":\"', CASE WHEN top_tags IS NULL THEN 'No kinds are listed yet.' ELSE concat(top_tags, ' and others, ', n_tags, ' in all.') END, '\"}},"
    "{\"@type\":\"Question\",\"name\":\"What does it cost in ', part, '?\",\"acceptedAnswer\":{\"@type\":\"Answer\",\"text\":\"Prices vary.', CASE WHEN lo IS NULL THEN '' ELSE concat(' A single entry costs CHF ', CAST(lo AS BIGINT), ' to CHF ', CAST(hi AS BIGINT), '.') END, '\"}},"
    "{\"@type\":\"Question\",\"name\":\"In which towns of ', part, '?\",\"acceptedAnswer\":{\"@type\":\"Answer\",\"text\":\"', CASE WHEN top_cities IS NULL THEN 'No towns are listed yet.' ELSE concat('For example in ', top_cities, '.') END, '\"}}]}') AS doc FROM ("
    "SELECT part, count(*) AS n_places, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_slots, min(single) FILTER (single < 100 AND single <> 0) AS lo, max(single) FILTER (single < 100 AND single <> 0) AS hi, "
    "(SELECT count(DISTINCT t) FROM (SELECT unnest(styles) AS t FROM places q WHERE q.part = p.part)) AS n_tags, "
    + TOP_SQL.format(arr="unnest(styles)", n=5) + " AS top_tags, " + TOP_SQL.format(arr="unnest(list_transform(addresses, lambda a: a.city))", n=4) + " AS top_cities "
    "FROM places p LEFT JOIN (SELECT place_id, count(*) AS n FROM slots GROUP BY place_id) s ON s.place_id = p.id GROUP BY part)"))
def snk_jsonld_faq(spark, sf):
    p = places(spark, sf)
    base = stats.partition_stats(p, slots(spark, sf))
    span = stats.price_span(p, "part", "single", 100)
    values = stats.distinct_sorted(p, "part", {"tag": F.col("styles"), "city": F.transform("addresses", lambda a: a["city"])})
    first = ranking.top_n(values, ["part", "kind"], [F.col("value")], 5).filter("kind = 'tag' OR rank <= 4")
    # At most five values per partition and kind are left.
    texts = first.groupBy("part").pivot("kind", ["tag", "city"]).agg(F.array_join(F.array_sort(F.collect_list("value")), ", "))
    facts = base.join(span, "part", "left").join(texts.withColumnsRenamed({"tag": "top_tags", "city": "top_cities"}), "part", "left")
    return publish.faq_docs(facts)


@query("snk_jsonld_itemlist", with_base(
    "SELECT part, position, concat('{\"@type\":\"ListItem\",\"position\":', position, ',\"name\":\"', name, '\"', CASE WHEN website <> '' THEN concat(',', " + _jstr("url", "website") +
    ") ELSE '' END, '}') AS item FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY name, id) AS position FROM places)"))
def snk_jsonld_itemlist(spark, sf):
    return publish.item_list(places_base(spark, sf))


@query("snk_jsonld_itemlist_doc", with_base(
    "SELECT part, concat('{\"@type\":\"ItemList\",\"numberOfItems\":', max(n), ',\"itemListElement\":[', string_agg(concat('{\"position\":', position, ',\"@type\":\"ListItem\",\"name\":\"', name, '\"', "
    "CASE WHEN website <> '' THEN concat(',', " + _jstr("url", "website") + ") ELSE '' END, '}'), ',' ORDER BY position), ']}') AS doc FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY name, id) AS position, "
    "count(*) OVER (PARTITION BY part) AS n FROM places) WHERE position <= 15 GROUP BY part"))
def snk_jsonld_itemlist_doc(spark, sf):
    return publish.item_list_doc(places_base(spark, sf))


@query("snk_landing_rows", with_places(
    "SELECT style, city, n AS n_places, CASE WHEN n = 1 THEN names[1] WHEN n <= 4 THEN array_to_string(names[1:n-1], ', ') || ' und ' || names[n] "
    "ELSE array_to_string(names[1:4], ', ') || ' und ' || (n - 4) || ' weitere' END AS names FROM (SELECT style, city, count(*) AS n, list(name ORDER BY name, id) AS names FROM ("
    + _roots_sql().replace("SELECT DISTINCT p.id", "SELECT DISTINCT p.id, p.name") + ") GROUP BY style, city)"))
def snk_landing_rows(spark, sf):
    return publish.landing_rows(style_city_rows(spark, sf).select("style", "city", "name", "id"))


@query("snk_landing_links", "WITH places AS (" + PLACES_SQL + "), combos AS (SELECT style, city FROM (" + STYLE_CITY_SQL + ")) " + CROSS_SQL)
def snk_landing_links(spark, sf):
    return joins.cross_links(style_city_rows(spark, sf).select("style", "city"))


SITE_RULES = [(r"/en/", "en", "0.8", "weekly"), (r"/(?:fr|es)/", "romance", "0.7", "weekly"), (r"\.html", "leaf", "0.6", "monthly"), (r"//m\.", "mobile", "0.5", "yearly")]
_SITE_CASE = "CASE WHEN contains(url, '/en/') THEN {0} WHEN contains(url, '/fr/') OR contains(url, '/es/') THEN {1} WHEN contains(url, '.html') THEN {2} WHEN contains(url, '//m.') THEN {3} END"


@query("snk_sitemap", "SELECT url AS loc, '2026-03-25' AS lastmod, " + ", ".join(
    _SITE_CASE.format(*[f"'{v}'" if isinstance(v, str) else v for v in vals]) + f" AS {n}" for n, vals in
    (("ord", [0, 1, 2, 3]), ("grp", ["en", "romance", "leaf", "mobile"]), ("priority", ["0.8", "0.7", "0.6", "0.5"]), ("changefreq", ["weekly", "weekly", "monthly", "yearly"]))) +
    " FROM (SELECT DISTINCT url FROM pages) WHERE contains(url, '/en/') OR contains(url, '/fr/') OR contains(url, '/es/') OR contains(url, '.html') OR contains(url, '//m.')")
def snk_sitemap(spark, sf):
    return publish.sitemap(table(spark, sf, "pages"), "url", SITE_RULES, F.lit("2026-03-25"))


@query("snk_sitemap_alternates",
       "SELECT loc, hreflang, CASE WHEN hreflang IN ('de', 'x-default') THEN loc ELSE concat(loc, '?lang=', hreflang) END AS href FROM (SELECT DISTINCT url AS loc FROM pages), "
       "(VALUES ('de'), ('en'), ('fr'), ('it'), ('x-default')) h(hreflang) WHERE (contains(loc, '/en/') OR contains(loc, '/fr/')) AND NOT contains(loc, '?')")
def snk_sitemap_alternates(spark, sf):
    locs = table(spark, sf, "pages").select(F.col("url").alias("loc")).distinct()
    return publish.alternates(locs, "loc", ["/en/", "/fr/"], ["de", "en", "fr", "it"], F.contains("loc", F.lit("?")))


@query("snk_export_rows", with_places(
    "SELECT CAST(id AS VARCHAR) AS id, name, CASE WHEN addresses[1].street <> '' THEN concat(addresses[1].street, ', ', coalesce(addresses[1].zip, ''), ' ', coalesce(addresses[1].city, '')) END AS address, "
    "nullif(array_to_string(styles, ', '), '') AS tags, CASE WHEN id % 2 = 0 THEN concat('T ', id) ELSE '-' END AS teachers, CASE WHEN website = '' THEN '-' ELSE website END AS website FROM places"))
def snk_export_rows(spark, sf):
    path = run_dir(spark, "export")
    p = places(spark, sf).withColumn("teachers", F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("T "), F.col("id").cast("string")))))
    publish.export_rows(p).write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    return spark.read.option("header", True).option("ignoreTrailingWhiteSpace", False) \
        .schema("id STRING, name STRING, address STRING, tags STRING, teachers STRING, website STRING").csv(path)


@query("snk_report_lines", with_both(
    "SELECT line_no, concat(line_no, '. [', upper(severity), '] ', type, ' ', entity_id, ': ', value) AS line FROM (SELECT *, row_number() OVER (ORDER BY "
    "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, type, entity_id, row_key, field, value, expected_range) AS line_no FROM (" + ALL_SQL + "))"))
def snk_report_lines(spark, sf):
    return publish.report_lines(all_findings(spark, sf), ["type", "entity_id", "row_key", "field", "value", "expected_range"])
