"""Streams over several ordered batches equal their batch form."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotatlas.operators import usage
from slotatlas.streaming import jobs

SCHEMA = "id bigint, ts timestamp_ntz, k int, v double"


def rows(n):
    base = dt.datetime(2024, 1, 1)
    return [(i, base + dt.timedelta(minutes=7 * i), 1 if i % 3 else i % 5, float((i * 7) % 11)) for i in range(n)]


def write_files(spark, folder, data, size):
    for i in range(0, len(data), size):
        spark.createDataFrame(data[i:i + size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def batch_changes(df):
    w = Window.partitionBy("k").orderBy("ts", "id")
    return df.withColumn("old", F.lag("v").over(w)).filter("old IS NOT NULL AND old <> v").select("id", "old", "v")


def test_value_changes_over_batches(spark, tmp_path):
    src, out, data = str(tmp_path / "in"), str(tmp_path / "out"), rows(200)
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    for i in range(0, 200, 50):  # one run per delivery: state comes from the run before
        spark.createDataFrame(data[i:i + 50], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.file_stream(spark, src, "*.parquet", SCHEMA)
        jobs.value_change_stream(stream, out, ["k"], "ts", "id", "v").awaitTermination()
    got = jobs.read_batches(spark, f"{out}/changes").select("id", "old_value", "new_value")
    expected = batch_changes(spark.createDataFrame(data, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    # A late row is dropped and counted.
    spark.createDataFrame([(999, data[0][1], 1, 5.5)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    jobs.value_change_stream(jobs.file_stream(spark, src, "*.parquet", SCHEMA), out, ["k"], "ts", "id", "v").awaitTermination()
    assert jobs.read_batches(spark, f"{out}/late").count() == 1
    assert got.sparkSession.read.parquet(f"{out}/changes").filter("id = 999").count() == 0


def test_upsert_batch_replaces_and_demotes(spark):
    cols = "owner int, class_id int, verified boolean, last_checked string"
    old = spark.createDataFrame([(1, 10, True, "o"), (2, 20, True, "o"), (3, 30, True, "o")], cols)
    batch = spark.createDataFrame([(1, 11, True, "n"), (1, None, True, "n"), (2, None, True, "n"), (4, 40, False, "n")], cols)
    got = jobs.upsert_batch(old, batch, "owner", "class_id", "today")
    expected = [(1, 11, True, "n"), (2, 20, False, "today"), (3, 30, True, "o"), (4, 40, False, "n")]
    assert sorted(map(tuple, got.collect())) == expected


def test_upsert_stream_over_batches(spark, tmp_path):
    cols = "owner int, class_id int, verified boolean, last_checked string"
    src, path = str(tmp_path / "in"), str(tmp_path / "job")
    want = seed = spark.createDataFrame([(i, i * 10, True, "o") for i in range(20)], cols)
    spark.createDataFrame([], cols).write.parquet(src)
    days = [("d1", [(1, 11, True, "d1"), (2, None, True, "d1"), (3, None, True, "d1")]), ("d2", [(1, 12, True, "d2"), (30, 300, True, "d2"), (40, None, True, "d2")]),
            ("d3", [(1, None, True, "d3"), (2, 21, True, "d3"), (2, 22, False, "d3")]), ("d4", [(3, None, True, "d4"), (30, None, True, "d4"), (30, 301, True, "d4")]),
            ("d5", [(1, None, True, "d5")])]
    for n, (day, batch) in enumerate(days):
        batch = spark.createDataFrame(batch, cols)
        batch.coalesce(1).write.mode("append").parquet(src)
        jobs.upsert_stream(jobs.file_stream(spark, src, "*.parquet", cols), path, "owner", "class_id", day, seed).awaitTermination()
        want = jobs.upsert_batch(want, batch, "owner", "class_id", day)
        got = jobs.upserted(spark, path, "owner").select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), n
    jobs.upsert_step(batch, len(days) - 1 + 1, path, "owner", "class_id", "d5")  # the same batch again
    again = jobs.upserted(spark, path, "owner").select(*want.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path, data = str(tmp_path), spark.createDataFrame(rows(60), SCHEMA)
    jobs.begin(spark, path, "state", data.select("k", "ts", "id", "v").schema)
    for n in (0, 1, 1, 2, 2):
        jobs.value_change_step(data.filter(f"id >= {20 * n} AND id < {20 * n + 20}"), n, path, ["k"], "ts", "id", "v")
    got = jobs.read_batches(spark, f"{path}/changes").select("id", "old_value", "new_value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch_changes(data).collect()))
    assert jobs.read_batches(spark, f"{path}/late").count() == 0
    # a compacted log seeds the next job
    seed, after = jobs.compacted(spark, path, ["k"], "ts", "id"), str(tmp_path / "next")
    jobs.begin(spark, after, "state", seed.schema, seed)
    more = spark.createDataFrame([(r[0] + 60, r[1] + dt.timedelta(days=9), *r[2:]) for r in rows(60)], SCHEMA)
    jobs.value_change_step(more, 0, after, ["k"], "ts", "id", "v")
    whole = batch_changes(data.unionByName(more)).filter("id >= 60")
    got = jobs.read_batches(spark, f"{after}/changes").select("id", "old_value", "new_value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_gate_stream_equals_the_batch_gate_and_counts_late_rows(spark, tmp_path):
    cols, base = "user_id int, day string, ts timestamp, honeypot string, dwell double, message string, name string", dt.datetime(2024, 1, 1)
    data = [(i % 3, str((base + dt.timedelta(hours=5 * i)).date()), base + dt.timedelta(hours=5 * i), "x" if i % 7 == 0 else None, float(i % 5), "hi", "n") for i in range(60)]
    src, path = str(tmp_path / "in"), str(tmp_path / "job")
    spark.createDataFrame([], cols).write.parquet(src)
    for k in range(0, 60, 12):
        spark.createDataFrame(data[k:k + 12], cols).coalesce(1).write.mode("append").parquet(src)
        jobs.gate_stream(jobs.file_stream(spark, src, "*.parquet", cols), path, ["user_id", "day"], "ts").awaitTermination()
        got = spark.read.parquet(f"{path}/accepted").select("user_id", "day")
        want = usage.submission_gate(spark.createDataFrame(data[:k + 12], cols), ["user_id", "day"], [F.col("ts")]).select("user_id", "day")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    spark.createDataFrame([(9, "2024-01-01", base, None, 9.0, "late", "n")], cols).coalesce(1).write.mode("append").parquet(src)
    query = jobs.gate_stream(jobs.file_stream(spark, src, "*.parquet", cols), path, ["user_id", "day"], "ts")
    query.awaitTermination()
    assert jobs.late_rows(query) == 1 and spark.read.parquet(f"{path}/accepted").filter("user_id = 9").count() == 0


def test_counts_after_each_batch(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "job")
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    data = rows(90)
    for k in range(0, 90, 18):
        spark.createDataFrame(data[k:k + 18], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        jobs.count_stream(jobs.file_stream(spark, src, "*.parquet", SCHEMA), path, F.col("k").cast("string")).awaitTermination()
        want = spark.createDataFrame(data[:k + 18], SCHEMA).groupBy(F.col("k").cast("string")).count()
        assert sorted(map(tuple, jobs.counts_so_far(spark, path).collect())) == sorted(map(tuple, want.collect()))


def test_summary_stream_equals_closed_windows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(spark, src, rows(1200), 300)
    stream = jobs.summary(jobs.file_stream(spark, src, "*.parquet", SCHEMA, 1), "ts", "k", F.col("v") > 3, F.col("v"))
    jobs.summary_stream(stream, out).awaitTermination()
    got = spark.read.parquet(f"{out}/summary")
    whole = jobs.summary(spark.createDataFrame(rows(1200), SCHEMA), "ts", "k", F.col("v") > 3, F.col("v"))
    top = rows(1200)[-1][1] - dt.timedelta(days=1)
    closed = whole.filter(F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.lit(top))
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))


def test_equal_times_over_a_border_of_batches(spark, tmp_path):
    src, out, t = str(tmp_path / "in"), str(tmp_path / "out"), dt.datetime(2024, 1, 1)
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    for row in [(1, t, 1, 10.0), (2, t, 1, 20.0), (3, t + dt.timedelta(minutes=1), 1, 30.0)]:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        jobs.value_change_stream(jobs.file_stream(spark, src, "*.parquet", SCHEMA), out, ["k"], "ts", "id", "v").awaitTermination()
    got = jobs.read_batches(spark, f"{out}/changes").select("id", "old_value", "new_value").collect()
    assert sorted(map(tuple, got)) == [(2, 10.0, 20.0), (3, 20.0, 30.0)]
