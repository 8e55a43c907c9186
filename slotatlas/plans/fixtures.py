"""Round-trip fixtures: orders and parts rendered as pages and payloads.

Each order becomes one page with three slots, built inside its own row (no
shuffle, no group). The oracle selects the same slots straight from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas.functions.timefn import clock
from slotatlas.plans.standins import table
from slotatlas.rules import DAY_WORDS, DAYS

N = 3
STYLES = ["Vinyasa", "Hatha", "Yin"]
LANGS = ["de", "fr", "it", "en"]


def _slot_columns(k: int) -> dict[str, Column]:
    start = 480 + (F.col("o_custkey") * 7 + k * 95) % 720
    day_no = (F.weekday("o_orderdate") + k) % 7
    words = F.array(*[F.array(*[F.lit(w.title()) for w in DAY_WORDS[lang]]) for lang in LANGS])
    return {
        "day": F.get(F.array(*[F.lit(d) for d in DAYS]), day_no),
        "word": F.get(F.get(words, (F.col("o_orderkey") % 4).cast("int")), day_no),
        "start": clock(start), "end": clock(start + 45 + 15 * (F.col("o_orderkey") % 4)),
        "dur": (45 + 15 * (F.col("o_orderkey") % 4)).cast("string"),
        "name": F.concat(F.lit(STYLES[k] + " Flow "), F.col("o_orderstatus")),
        "teacher": F.concat(F.lit("Clerk "), (F.col("o_custkey") % 97).cast("string")),
    }


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt by their key before they are blown up into pages, so that every core renders and parses. The
    number is given, as adaptive execution would fold small partitions back into one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def slot_pages(spark, sf, template, head="", foot="", out="html") -> DataFrame:
    """Orders with a page rendered from ``template(slot columns, k) -> list of parts``."""
    parts = [F.lit(head)]
    for k in range(N):
        parts += [p if isinstance(p, Column) else F.lit(p) for p in template(_slot_columns(k), k)]
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return dealt(orders, "o_orderkey").select(
        F.col("o_orderkey").alias("page_id"), F.concat(*parts, F.lit(foot)).alias(out))


START_SQL = "480 + (o_custkey * 7 + k * 95) % 720"


def _clock(m):
    return (f"concat(lpad(CAST(CAST(floor(({m}) / 60) AS INTEGER) AS VARCHAR), 2, '0'), ':', lpad(CAST(({m}) % 60 AS VARCHAR), 2, '0'))")


def slots_sql(columns="page_id, pos, day, time_start, time_end, class_name, teacher", where="true") -> str:
    days = ", ".join(f"'{d}'" for d in DAYS)
    styles = ", ".join(f"'{s}'" for s in STYLES)
    return (f"SELECT {columns} FROM (SELECT o_orderkey AS page_id, k AS pos, ([{days}])[CAST((isodow(o_orderdate) - 1 + k) % 7 AS INTEGER) + 1] AS day, "
            f"{_clock(START_SQL)} AS time_start, {_clock(START_SQL + ' + 45 + 15 * (o_orderkey % 4)')} AS time_end, "
            f"concat(([{styles}])[k + 1], ' Flow ', o_orderstatus) AS class_name, concat('Clerk ', o_custkey % 97) AS teacher, o_orderkey, o_custkey, o_orderstatus "
            f"FROM orders, (VALUES (0), (1), (2)) t(k)) WHERE {where}")


def whole(c: Column) -> Column:
    return c.cast("bigint").cast("string")


FILLER = "Lorem dolor sit amet, consectetur elit sed do eius. " * 5


def price_pages(spark, sf) -> DataFrame:
    """Part pages: four prices in four notations, far apart; part of them with a free trial."""
    single = F.concat((20 + F.col("p_size") % 30).cast("string"), F.lit(".50"))
    ten = whole(F.floor(F.col("p_retailprice") / 4))
    month = (100 + F.col("p_size")).cast("string")
    free = F.col("p_partkey") % 3 == 0
    trial = F.when(free, F.lit("Probestunde ist gratis")).otherwise(
        F.concat(F.lit("Schnupperstunde "), (5 + F.col("p_size") % 10).cast("string"), F.lit(" Franken")))
    html = F.concat(F.lit("<html><body><script>var x = 'CHF 77';</script><h1>Preise</h1><p>Einzelstunde CHF "), single, F.lit("</p><p>" + FILLER),
                    F.lit("</p><p>10er Karte "), ten, F.lit(".-</p><p>" + FILLER), F.lit("</p><p>Monatsabo Fr. "), month,
                    F.lit("</p><p>" + FILLER + "</p><p>"), trial, F.lit("</p></body></html>"))
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return dealt(parts, "p_partkey").select("p_partkey", F.lit("https://x.example.ch/preise").alias("url"), html.alias("html"))


PRICE_SQL = ("SELECT p_partkey, CAST(20 + p_size % 30 AS DOUBLE) + 0.5e0 AS single, floor(p_retailprice / 4) AS card_10, "
             "CAST(100 + p_size AS DOUBLE) AS monthly, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(5 + p_size % 10 AS DOUBLE) END AS trial FROM part")
