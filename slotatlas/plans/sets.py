"""Set operations between runs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotatlas.operators import reconcile
from slotatlas.plans.filters import VALID_SQL
from slotatlas.plans.joins import snap_sql, snapshot
from slotatlas.plans.registry import query
from slotatlas.plans.standins import places, places_base, slots, table, with_base, with_slots


@query("st_union_files",
       "SELECT 'customer' AS part, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def st_union_files(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("part"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("part"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s)


# Two runs over all rows: what was ordered or shipped in even years, and in odd ones.
def year_orders(spark, sf, year):
    return table(spark, sf, "orders").filter(F.year("o_orderdate") % 2 == year % 2).select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("class_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_checked"),
        (F.col("o_orderstatus") == "F").alias("verified"), F.col("o_orderpriority").alias("source"))


def year_sql(year):
    return ("SELECT o_custkey AS owner, o_orderkey AS class_id, strftime(o_orderdate, '%Y-%m-%d') AS last_checked, o_orderstatus = 'F' AS verified, "
            f"o_orderpriority AS source FROM orders WHERE year(o_orderdate) % 2 = {year % 2}")


RUNS = f"WITH old AS ({year_sql(1996)}), new AS ({year_sql(1997)}) "


@query("st_replace_by_key", RUNS + "SELECT * FROM old WHERE owner NOT IN (SELECT owner FROM new) UNION ALL SELECT * FROM new")
def st_replace_by_key(spark, sf):
    return reconcile.replace_by_key(year_orders(spark, sf, 1996), year_orders(spark, sf, 1997), "owner")


@query("st_demote", RUNS + ", att AS (SELECT c_custkey AS owner, CASE WHEN c_nationkey > 5 THEN concat('https://', c_name) ELSE '' END AS url FROM customer "
       "WHERE c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT owner FROM new)) "
       "SELECT o.owner, class_id, CASE WHEN a.owner IS NOT NULL THEN false ELSE verified END AS verified, CASE WHEN a.owner IS NOT NULL THEN '2026-01-01' ELSE last_checked END AS last_checked, "
       "CASE WHEN a.url <> '' THEN a.url ELSE source END AS source FROM old o LEFT JOIN att a ON a.owner = o.owner")
def st_demote(spark, sf):
    att = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").selectExpr(
        "c_custkey AS owner", "CASE WHEN c_nationkey > 5 THEN concat('https://', c_name) ELSE '' END AS url")
    return reconcile.demote(year_orders(spark, sf, 1996), att, year_orders(spark, sf, 1997), "owner", "2026-01-01") \
        .select("owner", "class_id", "verified", "last_checked", "source")


@query("st_promote_valid", with_slots(
    f"SELECT class_id, verified OR {VALID_SQL} AS verified, CASE WHEN NOT verified AND {VALID_SQL} THEN 'shape' WHEN verified THEN 'crawl' END AS verification_method FROM slots"))
def st_promote_valid(spark, sf):
    return reconcile.promote_valid(slots(spark, sf)).select("class_id", "verified", "verification_method")


@query("st_last_wins",
       "SELECT id, arg_max(name, r) AS name, arg_max(amount, r) AS amount FROM (SELECT c_custkey AS id, c_name AS name, c_acctbal AS amount, 0 AS r FROM customer UNION ALL "
       "SELECT p_partkey, p_name, p_retailprice, 1 FROM part UNION ALL SELECT s_suppkey, s_name, s_acctbal, 2 FROM supplier) GROUP BY id")
def st_last_wins(spark, sf):
    def src(t, p):
        return table(spark, sf, t).selectExpr(f"{p[0]} AS id", f"{p[1]} AS name", f"{p[2]} AS amount")
    return reconcile.last_wins([src("customer", ("c_custkey", "c_name", "c_acctbal")), src("part", ("p_partkey", "p_name", "p_retailprice")),
                                src("supplier", ("s_suppkey", "s_name", "s_acctbal"))], "id")


@query("st_merge_struct",
       "SELECT part_id, coalesce(n.lo, o.lo) AS lo, coalesce(n.hi, o.hi) AS hi, CASE WHEN n.lo IS NOT NULL THEN '1998-01-01' ELSE o.lo_checked END AS lo_checked, "
       "CASE WHEN n.hi IS NOT NULL THEN '1998-01-01' ELSE o.hi_checked END AS hi_checked FROM (SELECT part_id, lo, hi, '1997-01-01' AS lo_checked, '1997-01-01' AS hi_checked FROM ("
       + snap_sql(1996) + ")) o FULL JOIN (SELECT part_id, CASE WHEN part_id % 3 <> 0 THEN lo END AS lo, CASE WHEN part_id % 4 <> 0 THEN hi END AS hi FROM (" + snap_sql(1997) + ")) n USING (part_id)")
def st_merge_struct(spark, sf):
    old = snapshot(spark, sf, 1996).selectExpr("part_id", "lo", "hi", "'1997-01-01' AS lo_checked", "'1997-01-01' AS hi_checked")
    new = snapshot(spark, sf, 1997).selectExpr("part_id", "CASE WHEN part_id % 3 <> 0 THEN lo END AS lo", "CASE WHEN part_id % 4 <> 0 THEN hi END AS hi")
    return reconcile.merge_struct(old, new, "part_id", ["lo", "hi"], "1998-01-01")


_UPD = "SELECT user_id * 11 AS id, max(value) AS top FROM {t} GROUP BY user_id"


@query("st_update_by_key", with_base(
    "SELECT p.id, CASE WHEN u.id IS NOT NULL THEN u.top END AS single, CASE WHEN u.id IS NOT NULL THEN 'priced' ELSE status END AS status FROM places p "
    "LEFT JOIN (" + _UPD.format(t="events") + ") u ON u.id = p.id"))
def st_update_by_key(spark, sf):
    upd = spark.sql(_UPD.format(t="{e}"), e=table(spark, sf, "events")).select("id", F.struct(F.col("top").alias("single")).alias("pricing"))
    p = places_base(spark, sf).select("id", "status", F.lit(None).cast("struct<single:double>").alias("pricing"))
    return reconcile.update_by_key(p, upd, "id", "pricing", "priced").select("id", "pricing.single", "status")


@query("st_update_unknown", "SELECT id, top FROM (" + _UPD.format(t="events") + ") WHERE id NOT IN (SELECT c_custkey FROM customer)")
def st_update_unknown(spark, sf):
    upd = spark.sql(_UPD.format(t="{e}"), e=table(spark, sf, "events"))
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return reconcile.unknown_updates(ids, upd, "id")


def _combos(spark, sf, year):
    li = table(spark, sf, "lineitem").filter(F.year("l_shipdate") % 2 == year % 2).select("l_partkey", "l_suppkey")
    return li.select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id")).distinct()


def _combo_sql(year):
    return (f"SELECT DISTINCT l_partkey AS part_id, l_suppkey AS supp_id FROM lineitem WHERE year(l_shipdate) % 2 = {year % 2}")


@query("st_except_stale", _combo_sql(1996) + " EXCEPT " + _combo_sql(1997))
def st_except_stale(spark, sf):
    return reconcile.except_stale(_combos(spark, sf, 1996), _combos(spark, sf, 1997), ["part_id", "supp_id"])


@query("st_distinct_ci",
       "SELECT user_id, name_key, day, event_id FROM (SELECT user_id, lower(event_type) AS name_key, strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER "
       "(PARTITION BY user_id, lower(event_type), strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def st_distinct_ci(spark, sf):
    mixed = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.initcap("event_type"))
    e = table(spark, sf, "events").select("user_id", F.lower(mixed).alias("name_key"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    return reconcile.first_seen(e, ["user_id", "name_key", "day"], [F.col("event_id")])
