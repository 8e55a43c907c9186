"""Usage analytics over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotatlas.operators import segmented, sequences, usage
from slotatlas.plans.ordered import events
from slotatlas.plans.registry import query
from slotatlas.plans.standins import table


@query("sc_weighted_rules",
       "SELECT event_id, score, score >= 50 AS flagged FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE "
       "CASE WHEN value > 120 THEN 80 ELSE 0 END + CASE WHEN event_type = 'error' THEN 30 ELSE 0 END + CASE WHEN value < 5 THEN 20 ELSE 0 END "
       "+ CASE WHEN user_id % 7 = 0 THEN 15 ELSE 0 END END AS score FROM events)")
def sc_weighted_rules(spark, sf):
    rules = [(F.col("value") > 120, 80), (F.col("event_type") == "error", 30), (F.col("value") < 5, 20), (F.col("user_id") % 7 == 0, 15)]
    return usage.weighted_scores(table(spark, sf, "events"), rules, F.col("event_type") == "purchase").select("event_id", "score", "flagged")


@query("sc_submission_gate", """
SELECT user_id, day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS rn FROM (
  SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS dwell FROM (
    SELECT event_id, ts, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day FROM events))
  WHERE event_type <> 'error' AND dwell >= 3 AND event_type <> 'view') WHERE rn = 1""")
def sc_submission_gate(spark, sf):
    e = segmented.lag(events(spark, sf), ["user_id"], ["ts", "event_id"], "chunk", {"ts": "prev"})
    secs = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev").cast("timestamp"))) / 1e6
    e = e.select("event_id", "ts", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), secs.alias("dwell"),
                 F.when(F.col("event_type") == "error", F.lit("bot")).alias("honeypot"),
                 F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("event_type")).alias("message"), F.lit("n").alias("name"))
    return usage.submission_gate(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")]).select("user_id", "day", "event_id")


@query("ag_event_counts", "SELECT concat(event_type, '/', json_extract_string(props, '$.k')) AS key, count(*) AS n FROM events GROUP BY 1")
def ag_event_counts(spark, sf):
    return usage.event_counts(table(spark, sf, "events"), F.col("event_type"), F.get_json_object("props", "$.k"))


@query("ag_partition_views", "SELECT CAST(user_id % 26 AS BIGINT) AS part, count(*) AS n_views FROM events WHERE event_type = 'view' GROUP BY 1")
def ag_partition_views(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'view'").groupBy((F.col("user_id") % 26).alias("part")).agg(F.count("*").alias("n_views"))


@query("fn_dwell_bucket", "SELECT CASE WHEN s < 30 THEN 'under-30s' WHEN s < 60 THEN '30s-1min' WHEN s < 180 THEN '1-3min' WHEN s < 300 THEN '3-5min' WHEN s < 600 THEN '5-10min' "
       "ELSE 'over-10min' END AS bucket, count(*) AS n_sessions FROM (SELECT floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0e0 + 0.5e0) AS s FROM events GROUP BY user_id, date_trunc('hour', ts)) GROUP BY 1")
def fn_dwell_bucket(spark, sf):
    return usage.dwell_histogram(events(spark, sf), ["user_id", "chunk"], "ts")


@query("flt_search_used", "SELECT event_id, user_id FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events "
       "WHERE event_type IN ('view', 'click')) WHERE (gap IS NULL OR gap > 7200000000) AND length(event_type) > 2 AND value > 2")
def flt_search_used(spark, sf):
    e = events(spark, sf).filter("event_type IN ('view', 'click')")
    # The stand-in has hours between inputs where a search box has seconds.
    return sequences.debounced(e, ["user_id"], "ts", "event_id", "chunk", 7200).filter("length(event_type) > 2 AND value > 2").select("event_id", "user_id")
