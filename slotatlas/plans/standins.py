"""The given tables seen as directory data.

A place is a customer (partition = nation, prices and tags folded from its
orders), a weekly slot is an order. The same column expressions feed the Spark
DataFrame and the SQL text of the oracle; only array syntax and a few function
names differ between the two dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# (name, expression); {arr}/{end} open and close an array, {st}/{en} a struct.
BASE_COLUMNS = [
    ("id", "c_custkey"),
    ("name", "c_name"),
    ("part", "n_name"),
    ("segment", "c_mktsegment"),
    ("active", "CASE WHEN c_acctbal < 0 THEN false WHEN c_acctbal < 500 THEN NULL ELSE true END"),
    ("website", "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 "
                "THEN concat('www.place', c_custkey, '.example.ch') "
                "ELSE concat('https://www.place', c_custkey, '.example.ch/') END"),
    ("schedule_url", "CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 3 = 0 "
                     "THEN concat('https://www.eversports.ch/s/place-', c_custkey, '/') "
                     "WHEN c_custkey % 8 = 1 THEN concat('https://www.momoyoga.com/place', c_custkey) "
                     "ELSE concat('https://place', c_custkey, '.example.ch/Schedule') END"),
    ("platform", "CASE c_custkey % 5 WHEN 0 THEN 'Eversports' WHEN 1 THEN 'website' "
                 "WHEN 2 THEN 'SportsNow' WHEN 3 THEN 'momoyoga' ELSE '' END"),
    ("phone", "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('+41 00 ', c_custkey) END"),
    ("email", "CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN '' "
              "ELSE concat('info@place', c_custkey, '.example.ch') END"),
    ("drop_in", "c_custkey % 3 <> 1"),
    ("languages", "CASE c_custkey % 3 WHEN 0 THEN {arr}'German'{end} WHEN 1 "
                  "THEN {arr}'German', 'English'{end} ELSE {arr}'French'{end} END"),
    ("features", "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN {arr}'Outdoor Park'{end} "
                 "WHEN 'BUILDING' THEN {arr}'Kids and Family', '60+'{end} "
                 "WHEN 'FURNITURE' THEN {arr}'Prenatal'{end} "
                 "WHEN 'MACHINERY' THEN {arr}'Teacher Training', 'Sommer'{end} "
                 "ELSE {arr}'Sauna'{end} END"),
    ("addresses",
     "CASE WHEN c_custkey % 13 = 0 THEN {none_addr} "
     "WHEN c_custkey % 4 = 0 THEN {arr}{addr1}, {addr2}{end} ELSE {arr}{addr1}{end} END"),
    ("lat", "45.5 + (c_custkey * 37 % 1000) / 400.0e0"),
    ("lng", "5.5 + (c_custkey * 91 % 1000) / 180.0e0"),
    ("description", "concat('A place for ', lower(c_mktsegment), ' in region ', n_regionkey)"),
    ("status", "CASE c_custkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'dynamic' "
               "WHEN 2 THEN 'no_data' ELSE 'error' END"),
]
_STREET1 = "concat(c_mktsegment, ' ', c_custkey % 20 + 1)"
_ZIP1 = "concat(1000 + c_nationkey * 10 + c_custkey % 10, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE '' END)"
_CITY1 = "CASE WHEN c_custkey % 19 = 0 THEN '' ELSE concat('Town ', c_nationkey, '-', c_custkey % 6) END"
_STREET2 = "concat('Side ', c_custkey % 7 + 1)"
_ZIP2 = "concat(1000 + c_nationkey * 10 + c_custkey % 7, '')"
_CITY2 = "concat('Town ', c_nationkey, '-', c_custkey % 5)"


def _dialect(text: str, spark: bool) -> str:
    if spark:
        def addr(s, z, c):
            return f"named_struct('street', {s}, 'zip', {z}, 'city', {c})"
        none = "CAST(array() AS ARRAY<STRUCT<street:STRING,zip:STRING,city:STRING>>)"
        arr, end = "array(", ")"
    else:
        def addr(s, z, c):
            return f"{{'street': {s}, 'zip': {z}, 'city': {c}}}"
        none = "CAST([] AS STRUCT(street VARCHAR, zip VARCHAR, city VARCHAR)[])"
        arr, end = "[", "]"
    text = text.replace("{arr}", arr).replace("{end}", end).replace("{none_addr}", none)
    return text.replace("{addr1}", addr(_STREET1, _ZIP1, _CITY1)) \
        .replace("{addr2}", addr(_STREET2, _ZIP2, _CITY2))


# Folded from the orders of a customer: bounded tag set, min / max / mean, shares.
FOLD_SQL = """
  SELECT o_custkey,
         CAST(min(o_totalprice) AS DOUBLE) AS lo, CAST(max(o_totalprice) AS DOUBLE) AS hi,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n_orders,
         count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f,
         {sort}({distinct}concat(CASE o_orderstatus WHEN 'F' THEN 'Hot ' WHEN 'O' THEN 'Soft ' ELSE '' END,
                CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Vinyasa' WHEN '2' THEN 'Hatha'
                     WHEN '3' THEN 'Yin' WHEN '4' THEN 'Power' ELSE 'Ashtanga' END))) AS styles
  FROM orders GROUP BY o_custkey"""
PRICE_COLUMNS = [
    ("single", "CASE WHEN n_orders >= 4 THEN round(lo / 1500) END"),
    ("card_10", "CASE WHEN n_orders % 4 <> 0 THEN round(hi / 1200) END"),
    ("monthly", "CASE WHEN n_orders % 5 <> 0 THEN round(total / n_orders / 1400) END"),
    ("trial", "CASE WHEN n_orders % 3 <> 0 THEN round(abs(c_acctbal) / 120) END"),
    ("verified", "n_f >= 4"),
    ("n_orders", "n_orders"),
]

# Weekly slots: one per order.
SLOT_COLUMNS = [
    ("class_id", "o_orderkey"),
    ("place_id", "o_custkey"),
    ("day", "CASE WHEN o_orderkey % 53 = 0 THEN 'Funday' ELSE {dayname} END"),
    ("time_start", "CASE WHEN o_orderkey % 41 = 0 THEN '9h30' ELSE concat("
                   "CAST(CAST(floor((240 + o_orderkey % 82 * 15) / 60) AS INT) AS {str}), ':', "
                   "lpad(CAST((240 + o_orderkey % 82 * 15) % 60 AS {str}), 2, '0')) END"),
    ("time_end", "CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE concat("
                 "CAST(CAST(floor((240 + o_orderkey % 82 * 15 + o_custkey % 9 * 25 - 10) / 60) AS INT) AS {str}), ':', "
                 "lpad(CAST((240 + o_orderkey % 82 * 15 + o_custkey % 9 * 25 - 10) % 60 AS {str}), 2, '0')) END"),
    ("class_name", "CASE WHEN o_orderkey % 37 = 0 THEN concat('10:00RachelVinyasa ', o_orderpriority) "
                   "WHEN o_orderkey % 47 = 0 THEN concat('22./23.26MitAlexAndSomeVeryLongGluedName', o_orderpriority) "
                   "WHEN o_orderkey % 59 = 0 THEN '  ' WHEN o_orderkey % 61 = 0 THEN 'TBC' ELSE concat("
                   "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Vinyasa' WHEN '2' THEN 'Hatha' "
                   "WHEN '3' THEN 'Yin' WHEN '4' THEN 'Power' ELSE 'Ashtanga' END, ' Level ', o_custkey % 3) END"),
    ("teacher", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('Clerk ', o_custkey % 97) END"),
    ("level", "CASE o_orderstatus WHEN 'F' THEN 'beginner' WHEN 'O' THEN 'all' ELSE 'intermediate' END"),
    ("verified", "o_orderstatus = 'F'"),
    ("last_checked", "{datestr}"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places without the order fold: one scan of customer, nation broadcast (25 rows)."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.selectExpr("c_acctbal", "c_nationkey", *[f"{_dialect(e, True)} AS {k}" for k, e in BASE_COLUMNS]) \
        .drop("c_acctbal", "c_nationkey")


def order_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and tags per customer; every aggregate combines map-side."""
    o = table(spark, sf_dir, "orders")
    view = FOLD_SQL.format(sort="array_sort", distinct="collect_set(")
    return spark.sql(view.replace("FROM orders", "FROM {orders}"), orders=o)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with tags and prices, partition = nation name."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = c.join(order_fold(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.selectExpr(
        *[f"{_dialect(e, True)} AS {k}" for k, e in BASE_COLUMNS],
        "coalesce(styles, array()) AS styles",
        *[f"{e} AS {k}" for k, e in PRICE_COLUMNS if k not in ("n_orders", "verified")],
        "coalesce(n_f >= 4, false) AS verified", "coalesce(n_orders, 0L) AS n_orders")


def _slot_expr(e: str, spark: bool) -> str:
    if spark:
        names = ", ".join(f"'{d}'" for d in _DAYS)
        return e.format(dayname=f"get(array({names}), weekday(o_orderdate))", str="STRING",
                        datestr="date_format(o_orderdate, 'yyyy-MM-dd')")
    return e.format(dayname="dayname(o_orderdate)", str="VARCHAR",
                    datestr="strftime(o_orderdate, '%Y-%m-%d')")


_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly slots: one scan of orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        *[f"{_slot_expr(e, True)} AS {k}" for k, e in SLOT_COLUMNS])


BASE_SQL = ("SELECT " + ", ".join(f"{_dialect(e, False)} AS {k}" for k, e in BASE_COLUMNS)
            + " FROM customer JOIN nation ON c_nationkey = n_nationkey")
PLACES_SQL = (
    "SELECT " + ", ".join(f"{_dialect(e, False)} AS {k}" for k, e in BASE_COLUMNS)
    + ", coalesce(styles, []) AS styles, "
    + ", ".join(f"{e} AS {k}" for k, e in PRICE_COLUMNS if k not in ("n_orders", "verified"))
    + ", coalesce(n_f >= 4, false) AS verified, coalesce(n_orders, 0) AS n_orders"
    + " FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN ("
    + FOLD_SQL.format(sort="list_sort", distinct="list(DISTINCT ") + ") f ON o_custkey = c_custkey")
SLOTS_SQL = ("SELECT " + ", ".join(f"{_slot_expr(e, False)} AS {k}" for k, e in SLOT_COLUMNS)
             + " FROM orders")


def with_places(body: str) -> str:
    return f"WITH places AS ({PLACES_SQL}) {body}"


def with_base(body: str) -> str:
    return f"WITH places AS ({BASE_SQL}) {body}"


def with_slots(body: str) -> str:
    return f"WITH slots AS ({SLOTS_SQL}) {body}"


def with_both(body: str) -> str:
    return f"WITH places AS ({PLACES_SQL}), slots AS ({SLOTS_SQL}) {body}"


def with_base_slots(body: str) -> str:
    return f"WITH places AS ({BASE_SQL}), slots AS ({SLOTS_SQL}) {body}"
