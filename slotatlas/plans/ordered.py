"""Window semantics, sorts and limits over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotatlas.operators import facets, ranking, reconcile, segmented, sequences
from slotatlas.plans import sqltext as Q
from slotatlas.plans.joins import POINTS_SQL, points
from slotatlas.plans.registry import query
from slotatlas.plans.standins import places, places_base, slots, table, with_base, with_places, with_slots

ACTIVE = "coalesce(active, true)"


def events(spark, sf):
    """Events with their hour as the chunk of segmented windows."""
    return table(spark, sf, "events").withColumn("chunk", F.date_trunc("hour", "ts"))


@query("wn_carry_forward",
       "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER "
       "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header_id FROM events")
def wn_carry_forward(spark, sf):
    out = segmented.carry_forward(events(spark, sf), ["user_id"], ["ts", "event_id"], "chunk",
                                  F.when(F.col("event_type") == "signup", F.col("event_id")), "header_id")
    return out.select("event_id", "user_id", "header_id")


LINES_SQL = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query("wn_context",
       "SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(ctx) AS context_md5 FROM (SELECT doc_id, pos, line, string_agg(line, ' ') OVER "
       f"(PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ctx FROM ({LINES_SQL})) WHERE contains(line, 'tion')")
def wn_context(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return sequences.line_rows(d, "text", lambda line: F.contains(line, F.lit("tion")),
                               lambda ls, i: [F.md5(sequences.context(ls, i)).alias("context_md5")], ["doc_id"])


@query("wn_neighbor_fallback", f"""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(name) AS name_md5, md5(CASE WHEN length(nxt) > 2 AND length(nxt) < 100 AND nxt <> name THEN nxt END) AS second_md5
FROM (SELECT *, coalesce(own, CASE WHEN length(prv) > 2 AND length(prv) < 100 THEN prv END, CASE WHEN length(nxt) > 2 AND length(nxt) < 100 THEN nxt END) AS name
  FROM (SELECT doc_id, pos, line, CASE WHEN length(line) >= 15 THEN line END AS own,
          lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prv, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM ({LINES_SQL})))
WHERE length(line) < 40""")
def wn_neighbor_fallback(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")

    def usable(c):
        return (F.length(c) > 2) & (F.length(c) < 100)

    def cols(lines, i):
        own = F.when(F.length(F.get(lines, i)) >= 15, F.get(lines, i))
        name, second = sequences.neighbor_fallback(lines, i, own, usable)
        return [F.md5(name).alias("name_md5"), F.md5(second).alias("second_md5")]

    return sequences.line_rows(d, "text", lambda line: F.length(line) < 40, cols, ["doc_id"])


@query("wn_rank", with_places(
    "SELECT part, id, single, row_number() OVER (PARTITION BY part ORDER BY single, name, id) AS rank FROM places WHERE coalesce(single, 0) <> 0 AND verified"))
def wn_rank(spark, sf):
    p = places(spark, sf).filter("coalesce(single, 0) <> 0 AND verified").select("part", "id", "name", "single")
    order = [F.col("single"), F.col("name"), F.col("id")]
    return ranking.distributed_rank(p, ["part"], order).select("part", "id", "single", "rank")


@query("wn_first_seen",
       "SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority "
       "ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def wn_first_seen(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate")
    return reconcile.first_seen(o, ["o_custkey", "o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("wn_miss_streak", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_type IN ('error', 'view', 'click') AS fail FROM events),
f AS (SELECT *, CASE WHEN fail THEN rn - coalesce(max(CASE WHEN NOT fail THEN rn END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS streak FROM e)
SELECT event_id, user_id, event_type FROM f WHERE rn <= coalesce((SELECT min(rn) FROM f g WHERE g.user_id = f.user_id AND g.streak >= 6), 1000000000)""")
def wn_miss_streak(spark, sf):
    failed = F.col("event_type").isin("error", "view", "click")
    return sequences.until_miss_streak(events(spark, sf), ["user_id"], ["ts", "event_id"], "chunk", failed) \
        .select("event_id", "user_id", "event_type")


@query("wn_first_success",
       "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events "
       "WHERE event_type = 'purchase' AND value > 40) WHERE rn = 1")
def wn_first_success(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value", "ts", "event_type")
    return sequences.first_success(e, ["user_id"], [F.col("ts"), F.col("event_id")],
                                   (F.col("event_type") == "purchase") & (F.col("value") > 40)).select("user_id", "event_id", "value")


@query("wn_best_attempt",
       "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(value > 80 AS INTEGER) DESC, "
       "(value > 20)::INT + (value > 50)::INT + (event_type = 'click')::INT DESC, event_id) AS rn FROM events) WHERE rn = 1")
def wn_best_attempt(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    n = F.expr("int(value > 20) + int(value > 50) + int(event_type = 'click')")
    return sequences.best_attempt(e, ["user_id"], F.col("value") > 80, n, "event_id").select("user_id", "event_id", "event_type")


@query("so_name_locale", with_base("SELECT id, name FROM places"))
def so_name_locale(spark, sf):
    return places_base(spark, sf).select("id", "name").orderBy(*facets.sort_columns("name"))


@query("so_size_desc", with_places("SELECT id, name, CAST(len(styles) AS INTEGER) AS n_tags FROM places"))
def so_size_desc(spark, sf):
    return places(spark, sf).orderBy(*facets.sort_columns("size")).select("id", "name", F.size("styles").alias("n_tags"))


@query("so_first_zip", with_base("SELECT id, addresses[1].zip AS zip FROM places"))
def so_first_zip(spark, sf):
    return places_base(spark, sf).orderBy(*facets.sort_columns("zip")).select("id", F.get(F.col("addresses"), F.lit(0))["zip"].alias("zip"))


@query("so_price", with_places(f"SELECT id, single FROM places WHERE {ACTIVE}"))
def so_price(spark, sf):
    return places(spark, sf).filter(facets.is_active()).orderBy(F.asc_nulls_last("single"), "id").select("id", "single")


@query("so_price_desc_top", with_places(f"SELECT id, single FROM places WHERE {ACTIVE}"))
def so_price_desc_top(spark, sf):
    return places(spark, sf).filter(facets.is_active()).orderBy(F.desc_nulls_first("single"), "id").select("id", "single")


@query("so_time", with_slots(f"SELECT class_id, day, {Q.sql_day_index('day')} AS day_no, {Q.sql_minutes('time_start')} AS start_min FROM slots"))
def so_time(spark, sf):
    from slotatlas.functions.timefn import day_index, minutes
    return slots(spark, sf).orderBy(*facets.week_order()).select(
        "class_id", "day", day_index("day").alias("day_no"), minutes("time_start").alias("start_min"))


@query("so_status_rank", with_base(
    "SELECT id, status, part FROM places ORDER BY CASE status WHEN 'error' THEN 0 WHEN 'no_data' THEN 1 WHEN 'success' THEN 2 ELSE 3 END, part, name, id"))
def so_status_rank(spark, sf):
    return places_base(spark, sf).orderBy(ranking.status_rank("status", ["error", "no_data", "success"]), "part", "name", "id") \
        .select("id", "status", "part")


@query("so_nearest", "SELECT id, floor(d * 10 + 0.5e0) / 10 AS km FROM (SELECT id, sqrt((x - 0.02e0) * (x - 0.02e0) + (y - 0.03e0) * (y - 0.03e0)) * 111 AS d FROM ("
       + POINTS_SQL + ") WHERE x <> 0 AND y <> 0) ORDER BY d, id LIMIT 25")
def so_nearest(spark, sf):
    p = points(spark, sf).select("id", F.col("x").alias("lat"), F.col("y").alias("lng"))
    # Order by the exact distance, show it rounded.
    return ranking.nearest(p, 0.02, 0.03, 25, mode="planar").select("id", "km")


@query("so_topk_size", with_places("SELECT id, name, CAST(len(styles) AS INTEGER) AS n_tags FROM places ORDER BY len(styles) DESC, name, id LIMIT 10"))
def so_topk_size(spark, sf):
    return places(spark, sf).orderBy(*facets.sort_columns("size")).limit(10).select("id", "name", F.size("styles").alias("n_tags"))


@query("so_cap_per_group", with_slots(
    f"SELECT place_id, class_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY {Q.sql_day_index('day')}, "
    f"{Q.sql_minutes('time_start')} NULLS LAST, class_id) AS rn FROM slots) WHERE rn <= 5"))
def so_cap_per_group(spark, sf):
    return ranking.top_n(slots(spark, sf), ["place_id"], facets.week_order(), 5).select("place_id", "class_id", "rank")


@query("so_priority_fill", with_base(
    "SELECT id, part FROM places ORDER BY CASE part WHEN 'NATION_7' THEN 0 WHEN 'NATION_2' THEN 1 ELSE 2 END, part, id LIMIT 100"))
def so_priority_fill(spark, sf):
    return ranking.priority_fill(places_base(spark, sf), "part", ["NATION_7", "NATION_2"], ["id"], 100).select("id", "part")
