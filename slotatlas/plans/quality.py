"""Data-quality rules over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.operators import joins, quality, stats
from slotatlas.plans import sqltext as Q
from slotatlas.plans.joins import CLOSE_SQL, PAIRS_SQL, points, snapshot
from slotatlas.plans.registry import query
from slotatlas.plans.standins import places, places_base, slots, table, with_base, with_base_slots, with_both, with_places

ACTIVE = "coalesce(active, true)"
COLUMNS = ["type", "severity", "entity_id", "row_key", "field", "value", "expected_range", "message", "source"]
NAMED = ["entity_name", "part"]


def finding(type_, severity, field, value, expected, cond, source="places", row_key="''", entity="id", message=None, name="name", part="part", origin="''"):
    return (f"SELECT '{type_}' AS type, '{severity}' AS severity, CAST({entity} AS VARCHAR) AS entity_id, CAST({row_key} AS VARCHAR) AS row_key, "
            f"'{field}' AS field, {value} AS value, '{expected}' AS expected_range, '{message or type_.replace('_', ' ')}' AS message, coalesce({origin}, '') AS source, "
            f"CAST({name} AS VARCHAR) AS entity_name, CAST({part} AS VARCHAR) AS part FROM {source} WHERE {cond}")


def whole(v):
    return Q.sql_int_if_whole(v)


def ratio(field, bounds):
    r = f"({field} / single)"
    return finding("price_ratio_unusual", "medium", f"pricing.{field} / pricing.single", whole(f"(floor({r} * 100 + 0.5e0) / 100)"),
                   f"{bounds[0]}-{bounds[1]}x", f"single > 0 AND {field} <> 0 AND NOT ({r} BETWEEN {bounds[0]} AND {bounds[1]})", origin="platform")


PLACE_SQL = {
    "dq_range": " UNION ALL ".join(finding("price_out_of_range", "medium", f"pricing.{f}", whole(f), f"{lo}-{hi}", f"{f} NOT BETWEEN {lo} AND {hi}", origin="platform")
                                   for f, (lo, hi) in R.PRICE_RANGES.items()),
    "dq_ratio_card10": ratio("card_10", R.RATIO_CARD10),
    "dq_ratio_monthly": ratio("monthly", R.RATIO_MONTHLY),
    "dq_order": finding("trial_exceeds_single", "medium", "pricing.trial vs pricing.single", whole("trial"), "<= single", "trial > single", origin="platform"),
    "dq_missing_name": finding("missing_name", "high", "name", "name", "", f"{ACTIVE} AND trim(coalesce(name, '')) = ''"),
    "dq_no_contact": finding("no_contact_info", "medium", "website/phone/email", "'all empty'", "",
                             f"{ACTIVE} AND website = '' AND phone = '' AND coalesce(email, '') = ''"),
    "dq_no_address": finding("missing_address", "medium", "addresses", "CAST(len(addresses) AS VARCHAR)", "",
                             f"{ACTIVE} AND len(list_filter(addresses, lambda a: a.city <> '')) = 0"),
    "dq_no_tags": finding("no_styles", "low", "styles", "'0'", "", f"{ACTIVE} AND len(styles) = 0"),
    "dq_out_of_bounds": finding("coordinates_outside", "high", "lat/lng", "concat(CAST(lat AS VARCHAR), ', ', CAST(CAST(lng AS DECIMAL(9,5)) AS VARCHAR))", "",
                                f"{ACTIVE} AND (lat NOT BETWEEN 45.8e0 AND 47.9e0 OR lng NOT BETWEEN 5.9e0 AND 10.5e0)"),
    "dq_bad_url": finding("invalid_url", "low", "website", "website", "", f"{ACTIVE} AND website <> '' AND website NOT LIKE 'http%'"),
}
S, E = f"({Q.sql_minutes('time_start')})", f"({Q.sql_minutes('time_end')})"


def slot_finding(*args):
    return finding(*args, source="slots LEFT JOIN (SELECT id, name, part FROM places) ON id = place_id", row_key="class_id", entity="place_id")


SLOT_SQL = {
    "dq_bad_day": slot_finding("invalid_day", "high", "day", "day", "", "day NOT IN ('Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday')"),
    "dq_bad_time": slot_finding("invalid_time", "medium", "time_start", "time_start", "", f"{S} IS NULL") + " UNION ALL " +
    slot_finding("invalid_time", "medium", "time_end", "time_end", "", f"{S} IS NOT NULL AND {E} IS NULL"),
    "dq_unusual_hour": slot_finding("unusual_class_time", "low", "time_start", "time_start", "05:00-23:00",
                                    f"{E} IS NOT NULL AND ({S} < 300 OR {S} >= 1380)"),
    "dq_end_before_start": slot_finding("end_before_start", "high", "time_end", "concat(time_start, '-', time_end)", "", f"{E} <= {S}"),
    "dq_unusual_duration": slot_finding("unusual_duration", "medium", "duration", f"concat({E} - {S}, ' min')", "30-180",
                                        f"{E} > {S} AND ({E} - {S} < 30 OR {E} - {S} > 180)"),
}
ORPHAN_SQL = finding("orphan_slot", "high", "place_id", "CAST(n AS VARCHAR)", "", "true", entity="place_id", name="NULL", part="NULL",
                     source=f"(SELECT place_id, count(*) AS n FROM slots WHERE {E} > {S} AND place_id NOT IN (SELECT id FROM places WHERE segment <> 'BUILDING') GROUP BY place_id)")
DUP_NAME_SQL = finding("duplicate_name", "medium", "name", "concat(name_key, ' x', n_members)", "", "true", entity="first_id", name="first_name",
                       source="(SELECT part, description AS name_key, count(DISTINCT id) AS n_members, min(id) AS first_id, min_by(name, id) AS first_name FROM places WHERE trim(description) <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) > 1)")
DUP_ADDR_SQL = finding("duplicate_address", "medium", "addresses", "concat(street, ' x', n_members)", "", "true", entity="first_id", name="first_name",
                       source="(SELECT part, street, zip, count(DISTINCT id) AS n_members, min(id) AS first_id, min_by(name, id) AS first_name FROM (SELECT part, id, name, lower(trim(a.street)) AS street, trim(a.zip) AS zip "
                              "FROM (SELECT part, id, name, unnest(addresses) AS a FROM places)) WHERE street <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT id) > 1)")


def place_findings(df, keys):
    rules = quality.place_rules(F.col("platform"))
    return quality.run_rules(df, [r for k in keys for r in rules[k]],
                             {"entity_id": F.col("id").cast("string"), "row_key": F.lit(""), "entity_name": F.col("name"),
                              "part": F.col("part")}).select(*COLUMNS, *NAMED)


def slot_findings(df, keys, owners):
    rules = quality.slot_rules()
    found = quality.run_rules(quality.with_clocks(df), [r for k in keys for r in rules[k]],
                              {"entity_id": F.col("place_id").cast("string"), "row_key": F.col("class_id").cast("string")})
    return quality.name_entities(found, owners).select(*COLUMNS, *NAMED)


def group_findings(df):
    """Findings of groups; owners that are unknown have neither name nor partition."""
    missing = {c: F.lit(None).cast("string") for c in NAMED if c not in df.columns}
    return df.withColumns({"row_key": F.lit(""), **missing}).select(*COLUMNS, *NAMED)


def _place_query(key):
    needs_fold = key in ("dq_range", "dq_ratio_card10", "dq_ratio_monthly", "dq_order", "dq_no_tags")

    @query(key, (with_places if needs_fold else with_base)(PLACE_SQL[key]))
    def run(spark, sf):
        return place_findings((places if needs_fold else places_base)(spark, sf), [key])
    return run


def _slot_query(key):
    @query(key, with_base_slots(SLOT_SQL[key]))
    def run(spark, sf):
        return slot_findings(slots(spark, sf), [key], places_base(spark, sf))
    return run


# Names and tags are rarely missing here, so these two look at derived blanks.
for _key in PLACE_SQL:
    if _key not in ("dq_missing_name", "dq_no_tags"):
        _place_query(_key)
for _key in SLOT_SQL:
    _slot_query(_key)


@query("dq_missing_name", with_base(f"SELECT * FROM ({PLACE_SQL['dq_missing_name']})".replace(
    "FROM places", "FROM (SELECT * REPLACE (CASE WHEN phone = '' THEN '  ' ELSE name END AS name) FROM places)")))
def dq_missing_name(spark, sf):
    p = places_base(spark, sf).withColumn("name", F.when(F.col("phone") == "", F.lit("  ")).otherwise(F.col("name")))
    return place_findings(p, ["dq_missing_name"])


@query("dq_no_tags", with_places(PLACE_SQL["dq_no_tags"].replace(
    "FROM places", "FROM (SELECT * REPLACE (list_filter(styles, lambda s: contains(s, 'Soft V')) AS styles) FROM places)")))
def dq_no_tags(spark, sf):
    p = places(spark, sf).withColumn("styles", F.filter("styles", lambda s: F.contains(s, F.lit("Soft V"))))
    return place_findings(p, ["dq_no_tags"])


@query("dq_change", "SELECT 'price_change' AS type, CASE WHEN pct > 50 THEN 'high' ELSE 'medium' END AS severity, CAST(part_id AS VARCHAR) AS entity_id, field, "
       "old_value, new_value, floor(pct * 10 + 0.5e0) / 10 AS change_pct FROM (SELECT *, abs(new_value - old_value) / old_value * 100 AS pct FROM (" + PAIRS_SQL + ")) WHERE pct > 20")
def dq_change(spark, sf):
    d = joins.snapshot_diff(snapshot(spark, sf, 1996), snapshot(spark, sf, 1997), ["part_id"], ["lo", "hi", "mean"])
    return d.select(F.lit("price_change").alias("type"), "severity", F.col("part_id").cast("string").alias("entity_id"), "field",
                    "old_value", "new_value", (F.floor(F.col("pct") * 10 + 0.5) / 10).alias("change_pct"))


def known_places(spark, sf):
    return places_base(spark, sf).filter("segment <> 'BUILDING'")


@query("dq_orphan", with_base_slots(ORPHAN_SQL))
def dq_orphan(spark, sf):
    return group_findings(quality.orphan_findings(slots(spark, sf), known_places(spark, sf), "place_id"))


def dup_names(df):
    named = df.select("part", F.col("description").alias("name_key"), "id", "name")
    return group_findings(quality.duplicate_findings(stats.duplicates(named, ["part", "name_key"], "id", named=["name_key"], label="name"),
                                                     "duplicate_name", "medium", "name", "first_id", "name_key"))


def dup_addresses(df):
    a = df.select("part", "id", "name", F.explode("addresses").alias("a")).select(
        "part", "id", "name", F.lower(F.trim("a.street")).alias("street"), F.trim("a.zip").alias("zip"))
    return group_findings(quality.duplicate_findings(stats.duplicates(a, ["part", "street", "zip"], "id", named=["street"], label="name"),
                                                     "duplicate_address", "medium", "addresses", "first_id", "street"))


@query("dq_dup_name", with_base(DUP_NAME_SQL))
def dq_dup_name(spark, sf):
    return dup_names(places_base(spark, sf))


@query("dq_dup_address", with_base(DUP_ADDR_SQL))
def dq_dup_address(spark, sf):
    return dup_addresses(places_base(spark, sf))


@query("dq_dup_coord", "SELECT 'duplicate_coordinates' AS type, 'low' AS severity, CAST(id_1 AS VARCHAR) AS entity_id, CAST(id_2 AS VARCHAR) AS value FROM (" + CLOSE_SQL + ")")
def dq_dup_coord(spark, sf):
    pairs = joins.close_pairs(points(spark, sf), "label", "x", "y", "id", eps=0.01)
    return pairs.select(F.lit("duplicate_coordinates").alias("type"), F.lit("low").alias("severity"),
                        F.col("id_1").cast("string").alias("entity_id"), F.col("id_2").cast("string").alias("value"))


CHANGE_SQL = ("SELECT 'price_change' AS type, CASE WHEN pct > 50 THEN 'high' ELSE 'medium' END AS severity, CAST(part_id AS VARCHAR) AS entity_id, '' AS row_key, field, "
              "concat(CAST(floor(pct + 0.5e0) AS BIGINT), '%') AS value, '20%' AS expected_range, 'price change' AS message, '' AS source, p_name AS entity_name, p_brand AS part "
              "FROM (SELECT *, abs(new_value - old_value) / old_value * 100 AS pct FROM (" + PAIRS_SQL + ")) LEFT JOIN part ON p_partkey = part_id WHERE pct > 20")
COORD_SQL = finding("duplicate_coordinates", "low", "lat/lng", "CAST(id_2 AS VARCHAR)", "", "true", source="(" + CLOSE_SQL + ")", entity="id_1", name="NULL", part="label")
ALL_SQL = " UNION ALL ".join([*PLACE_SQL.values(), *SLOT_SQL.values(), ORPHAN_SQL, DUP_NAME_SQL, DUP_ADDR_SQL, CHANGE_SQL, COORD_SQL])


def change_findings(spark, sf):
    d = joins.snapshot_diff(snapshot(spark, sf, 1996), snapshot(spark, sf, 1997), ["part_id"], ["lo", "hi", "mean"])
    value = F.concat(F.floor(F.col("pct") + 0.5).cast("string"), F.lit("%"))
    found = d.select(
        F.lit("price_change").alias("type"), "severity", F.col("part_id").cast("string").alias("entity_id"), "field", value.alias("value"),
        F.lit("20%").alias("expected_range"), F.lit("price change").alias("message"), F.lit("").alias("source"))
    items = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    return group_findings(quality.name_entities(found, items, "p_name", "p_brand"))


def coordinate_findings(spark, sf):
    pairs = joins.close_pairs(points(spark, sf), "label", "x", "y", "id", eps=0.01)
    rule = quality.Rule("duplicate_coordinates", "low", F.lit(True), "lat/lng", F.col("id_2").cast("string"))
    return group_findings(quality.run_rules(pairs, [rule], {"entity_id": F.col("id_1").cast("string"), "part": F.col("label").cast("string")}))


def all_findings(spark, sf):
    p, s = places(spark, sf), slots(spark, sf)
    base = places_base(spark, sf)
    parts = [place_findings(p, list(PLACE_SQL)), slot_findings(s, list(SLOT_SQL), base),
             group_findings(quality.orphan_findings(s, known_places(spark, sf), "place_id")),
             dup_names(base), dup_addresses(base), change_findings(spark, sf), coordinate_findings(spark, sf)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("dq_findings", with_both(ALL_SQL))
def dq_findings(spark, sf):
    return all_findings(spark, sf)


@query("snk_report", with_both("SELECT type, severity, count(*) AS n_findings FROM (" + ALL_SQL + ") GROUP BY type, severity"))
def snk_report(spark, sf):
    return quality.summarize(all_findings(spark, sf), ["type", "severity"]).orderBy("severity", "type")
