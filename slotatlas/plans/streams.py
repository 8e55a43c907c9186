"""Streaming jobs over the given tables; their results equal batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotatlas.plans.registry import query
from slotatlas.plans.sets import year_orders, year_sql
from slotatlas.plans.standins import table
from slotatlas.session import run_dir
from slotatlas.streaming import jobs


BATCHES, FILES = 5, 4


def events_stream(spark, sf):
    return jobs.file_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)


def delivered(spark, rows, path, ts):
    """The rows as a stream of ordered batches: equal stretches of time, delivered one after the other."""
    first, last = rows.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))), F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
    at = F.unix_micros(F.col(ts).cast("timestamp")) - (first or 0)
    part = F.floor(at * BATCHES / ((last or 0) - (first or 0) + 1)).cast("int")
    rows.withColumn("part", F.coalesce(part, F.lit(0))).write.partitionBy("part").parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    for k in range(BATCHES):
        parts.filter(F.col("part") == k).drop("part").repartition(FILES).write.mode("append").parquet(f"{path}/in")
    return jobs.file_stream(spark, f"{path}/in", "*.parquet", rows.schema, FILES)


@query("stm_value_change",
       "SELECT user_id, event_type, event_id, old_value, value AS new_value, CASE WHEN pct > 50 THEN 'high' WHEN pct > 20 THEN 'medium' END AS severity FROM ("
       "SELECT *, abs(value - old_value) / nullif(old_value, 0) * 100 AS pct FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old_value FROM events)) "
       "WHERE old_value IS NOT NULL AND old_value <> value")
def stm_value_change(spark, sf):
    path = run_dir(spark, "value-change")
    events = delivered(spark, table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), path, "ts")
    jobs.value_change_stream(events, path, ["user_id", "event_type"], "ts", "event_id", "value").awaitTermination()
    return jobs.read_batches(spark, f"{path}/changes").select("user_id", "event_type", "event_id", "old_value", "new_value", "severity")


@query("stm_upsert_crawl", f"""
WITH old AS ({year_sql(1996)}), crawl AS ({year_sql(1997)}), found AS (SELECT * FROM crawl WHERE source NOT LIKE '5%'), att AS (SELECT DISTINCT owner FROM crawl)
SELECT owner, class_id, CASE WHEN owner IN (SELECT owner FROM att) THEN '2026-01-01' ELSE last_checked END AS last_checked,
  CASE WHEN owner IN (SELECT owner FROM att) THEN false ELSE verified END AS verified, source FROM old WHERE owner NOT IN (SELECT owner FROM found)
UNION ALL SELECT owner, class_id, last_checked, verified, source FROM found""")
def stm_upsert_crawl(spark, sf):
    path = run_dir(spark, "upsert")
    # an owner's rows come in one delivery, as a crawl brings them
    crawl = table(spark, sf, "orders").filter(F.year("o_orderdate") % 2 == 1).select(
        F.col("o_custkey").alias("owner"), F.when(~F.startswith("o_orderpriority", F.lit("5")), F.col("o_orderkey")).alias("class_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_checked"), (F.col("o_orderstatus") == "F").alias("verified"),
        F.col("o_orderpriority").alias("source"), F.timestamp_seconds(F.col("o_custkey") % 1000).alias("at"))
    stream = delivered(spark, crawl, path, "at").drop("at")
    jobs.upsert_stream(stream, path, "owner", "class_id", "2026-01-01", year_orders(spark, sf, 1996)).awaitTermination()
    return jobs.upserted(spark, path, "owner").select("owner", "class_id", "last_checked", "verified", "source")


@query("stm_submission_gate", "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type NOT IN ('error', 'view') AND value >= 3")
def stm_submission_gate(spark, sf):
    path = run_dir(spark, "gate")
    e = table(spark, sf, "events").select(
        "user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("dwell"),
        F.when(F.col("event_type") == "error", F.lit("bot")).alias("honeypot"),
        F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("event_type")).alias("message"), F.lit("n").alias("name"))
    jobs.gate_stream(delivered(spark, e, path, "ts"), path, ["user_id", "day"], "ts").awaitTermination()
    return spark.read.parquet(f"{path}/accepted").select("user_id", "day")


@query("stm_event_counts", "SELECT concat(event_type, '/', json_extract_string(props, '$.k')) AS key, count(*) AS n FROM events GROUP BY 1")
def stm_event_counts(spark, sf):
    path = run_dir(spark, "counts")
    events = delivered(spark, table(spark, sf, "events").select("event_type", "props", "ts"), path, "ts")
    jobs.count_stream(events, path, F.concat_ws("/", "event_type", F.get_json_object("props", "$.k"))).awaitTermination()
    return jobs.counts_so_far(spark, path)


@query("stm_run_summary", """
SELECT strftime(w, '%Y-%m-%d') AS day, event_type, count(*) AS attempted, count(*) FILTER (value > 20) AS success,
  CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (value > 20), 0) AS BIGINT) AS new_rows
FROM (SELECT *, date_trunc('day', ts) AS w FROM events) WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY w, event_type""")
def stm_run_summary(spark, sf):
    path = run_dir(spark, "summary")
    s = jobs.summary(events_stream(spark, sf), "ts", "event_type", F.col("value") > 20, F.floor("value"))
    jobs.summary_stream(s, path).awaitTermination()
    out = spark.read.parquet(f"{path}/summary")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "attempted", "success", "new_rows")


@query("ag_run_summary", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS attempted, count(*) FILTER (value > 20) AS success,
  CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (value > 20), 0) AS BIGINT) AS new_rows FROM events GROUP BY 1, 2""")
def ag_run_summary(spark, sf):
    s = jobs.summary(table(spark, sf, "events"), "ts", "event_type", F.col("value") > 20, F.floor("value"))
    return s.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "attempted", "success", "new_rows")
