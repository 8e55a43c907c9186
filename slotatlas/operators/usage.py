"""Usage counters, dwell time, access scores and the submission gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.operators.reconcile import keep_by


def score(rules: list[tuple[Column, int]]) -> Column:
    """Sum of the weights of the rules that hit; an unknown condition adds nothing."""
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(F.lit(0)) for c, w in rules])


def weighted_scores(df: DataFrame, rules: list[tuple[Column, int]], allow: Column, flag_at: int = R.SCORE_FLAG) -> DataFrame:
    """Score and flag of each access row; allowed visitors score 0."""
    value = F.when(F.coalesce(allow, F.lit(False)), F.lit(0)).otherwise(score(rules))
    return df.withColumn("score", value).withColumn("flagged", F.col("score") >= flag_at)


def good_submission() -> Column:
    """Empty honeypot, at least 3 s after load, a message that is not blank and not too long."""
    return ((F.coalesce("honeypot", F.lit("")) == "") & (F.col("dwell") >= R.GATE_MIN_SECONDS)
            & (F.trim("message") != "") & (F.length("message") <= R.GATE_MAX_MESSAGE)
            & (F.coalesce(F.length("name"), F.lit(0)) <= R.GATE_MAX_NAME))


def submission_gate(df: DataFrame, session: list[str], order: list[Column]) -> DataFrame:
    """Accepted submissions: only the first good one per session."""
    return keep_by(df.filter(good_submission()), session, order)


def event_counts(df: DataFrame, category: Column, action: Column) -> DataFrame:
    return df.groupBy(F.concat_ws("/", category, action).alias("key")).agg(F.count("*").alias("n"))


def dwell_bucket(seconds: Column) -> Column:
    out = F.lit(R.DWELL_OVER)
    for limit, name in reversed(R.DWELL_BUCKETS):
        out = F.when(seconds < limit, F.lit(name)).otherwise(out)
    return out


def dwell_histogram(df: DataFrame, session: list[str], ts: str) -> DataFrame:
    """One dwell time per session (last event minus first), counted per bucket."""
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    per = df.groupBy(*session).agg(F.floor(F.max(t) - F.min(t) + 0.5).alias("seconds"))
    return per.groupBy(dwell_bucket(F.col("seconds")).alias("bucket")).agg(F.count("*").alias("n_sessions"))
