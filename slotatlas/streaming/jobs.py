"""Run-to-run state as Structured Streaming jobs.

A job only ever appends: each batch writes plain Parquet folders named by its batch id, below the job's folder on shared
storage. A batch that is run again after a failure overwrites its own folders with the same rows. What holds now is a
query over the log: the newest row of a key by time and tie, combined within tasks before the shuffle. `compacted` logs
become the `seed` of a job that starts anew, so a long log can be cut while the job is stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotatlas.functions.price import change_severity, pct_change, signed_pct
from slotatlas.operators import segmented, usage


def file_stream(spark: SparkSession, folder: str, file_glob: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


# --- logs by batch --------------------------------------------------------------------

def append(df: DataFrame, path: str, name: str, batch_id: int) -> None:
    """Rows of one batch; a repeated batch overwrites its own."""
    df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")


def begin(spark: SparkSession, path: str, name: str, schema, seed: DataFrame | None = None) -> None:
    """Batch -1 of a log: the seed, or no rows, so that the log can be read before the first batch."""
    rows = spark.createDataFrame([], schema) if seed is None else seed
    rows.write.mode("ignore").parquet(f"{path}/{name}/batch=-1")


def log(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame:
    """Rows of a log with their ``batch`` (older than ``before``; other folders are not read)."""
    df = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return df if before is None else df.filter(F.col("batch") < before)


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(*keys, "_s.*")


# --- value changes ----------------------------------------------------------------

def marked_late(batch: DataFrame, state: DataFrame, keys: list[str], ts: str, tie: str, value: str) -> DataFrame:
    """Rows of a batch with ``_late``: not after the state of their key, by time and then tie."""
    rows = segmented.join_groups(batch.select(*keys, ts, tie, value), state.select(*keys, F.struct(ts, tie).alias("_last")), keys, "left")
    return rows.withColumn("_late", F.coalesce(F.struct(ts, tie) <= F.col("_last"), F.lit(False))).drop("_last")


def batch_changes(marked: DataFrame, state: DataFrame, keys: list[str], ts: str, tie: str, value: str,
                  chunk_unit: str = "hour") -> DataFrame:
    """Change rows of one batch; its late rows take no part.

    The rows and the state row of the key run through a chunked lag, so a key
    that holds most of the batch is still spread over many tasks.
    """
    fresh = marked.filter(~F.col("_late")).drop("_late").withColumn("_new", F.lit(True)) \
        .unionByName(state.withColumn("_new", F.lit(False)))
    fresh = fresh.withColumn("_chunk", F.date_trunc(chunk_unit, ts))
    with_old = segmented.lag(fresh, keys, [ts, tie], "_chunk", {value: "old_value"})
    pct = pct_change("old_value", value)
    return with_old.filter("_new").filter(F.col("old_value").isNotNull() & (F.col("old_value") != F.col(value))).select(
        *keys, ts, tie, "old_value", F.col(value).alias("new_value"), pct.alias("pct"),
        signed_pct("old_value", value).alias("signed_pct"), change_severity(pct).alias("severity"))


def value_change_step(batch: DataFrame, batch_id: int, path: str, keys: list[str], ts: str, tie: str, value: str) -> None:
    """Changes, late rows and the last rows of the keys of one batch. A late last row does no harm: the log keeps the newer one."""
    cols = [*keys, ts, tie, value]
    seen = batch.select(F.struct(*keys).alias("_key")).distinct()
    known = log(batch.sparkSession, path, "state", batch_id).withColumn("_key", F.struct(*keys)).join(seen, "_key", "left_semi")
    state = newest(known.select(*cols), keys, [ts, tie]).persist()  # one row for each key of the batch
    marked = marked_late(batch, state, keys, ts, tie, value).persist()
    try:
        append(batch_changes(marked, state, keys, ts, tie, value), path, "changes", batch_id)
        append(marked.filter("_late").select(*cols), path, "late", batch_id)
        append(newest(batch.select(*cols), keys, [ts, tie]), path, "state", batch_id)
    finally:
        marked.unpersist()
        state.unpersist()


def value_change_stream(stream: DataFrame, path: str, keys: list[str], ts: str, tie: str, value: str,
                        seed: DataFrame | None = None, **trigger):
    """Remember the last value per key and write a change row for every new one."""
    begin(stream.sparkSession, path, "state", stream.select(*keys, ts, tie, value).schema, seed)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            value_change_step(batch, batch_id, path, keys, ts, tie, value)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint") \
        .trigger(**(trigger or {"availableNow": True})).start()


def compacted(spark: SparkSession, path: str, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The last row of each key of a stopped job: the seed of the next one."""
    return newest(log(spark, path, "state").drop("batch"), keys, [ts, tie])


# --- crawl upserts ------------------------------------------------------------------

def upsert_batch(old: DataFrame, batch: DataFrame, owner: str, row_key: str, today: str) -> DataFrame:
    """Owners with new rows: replaced. Owners that were tried in vain: rows kept, unverified.

    A batch row without ``row_key`` is an attempt that found nothing.
    """
    seen = batch.groupBy(owner).agg(F.max(F.col(row_key).isNotNull()).alias("_found"))
    kept = old.join(seen, owner, "left").filter(~F.coalesce(F.col("_found"), F.lit(False)))
    failed = F.col("_found").isNotNull()
    kept = kept.withColumns({
        "verified": F.when(failed, F.lit(False)).otherwise(F.col("verified")),
        "last_checked": F.when(failed, F.lit(today)).otherwise(F.col("last_checked"))}).drop("_found")
    return kept.unionByName(batch.filter(F.col(row_key).isNotNull()).select(*old.columns))


def upsert_step(batch: DataFrame, batch_id: int, path: str, owner: str, row_key: str, today: str) -> None:
    """The rows a batch found, and one row for each owner that was tried. Nothing is read."""
    append(batch.filter(F.col(row_key).isNotNull()), path, "rows", batch_id)
    tried = batch.groupBy(owner).agg(F.max(F.col(row_key).isNotNull()).alias("found"))
    append(tried.withColumn("day", F.lit(today)), path, "tries", batch_id)


def upsert_stream(stream: DataFrame, path: str, owner: str, row_key: str, today: str, seed: DataFrame, **trigger):
    """Log crawl batches upon the rows of ``seed``; ``upserted`` is the table they make."""
    spark = stream.sparkSession
    begin(spark, path, "rows", seed.schema, seed)
    begin(spark, path, "tries", None, seed.select(owner).distinct().withColumns({"found": F.lit(True), "day": F.lit("")}))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            upsert_step(batch, batch_id, path, owner, row_key, today)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint") \
        .trigger(**(trigger or {"availableNow": True})).start()


def upserted(spark: SparkSession, path: str, owner: str, before: int | None = None) -> DataFrame:
    """The table after all batches (before ``before``): the rows of the last batch that found an owner, unverified and
    with the day of the last try if that came later and was in vain."""
    rows = log(spark, path, "rows", before)
    state = log(spark, path, "tries", before).groupBy(owner).agg(
        F.max(F.when(F.col("found"), F.col("batch"))).alias("_from"), F.max("batch").alias("_last"),
        F.max_by("day", "batch").alias("_day"))
    vain = F.col("_last") > F.col("_from")
    current = rows.join(state, owner).filter(F.col("batch") == F.col("_from"))
    return current.withColumns({"verified": F.when(vain, F.lit(False)).otherwise(F.col("verified")),
                                "last_checked": F.when(vain, F.col("_day")).otherwise(F.col("last_checked"))}) \
        .drop("batch", "_from", "_last", "_day")


# --- submissions --------------------------------------------------------------------------

def gate_stream(stream: DataFrame, path: str, session: list[str], ts: str, within: str = "1 day", **trigger):
    """Accept the first good submission of each session, over batches, and forget a session after ``within``.

    Takes the columns of ``usage.good_submission``. Rows older than the watermark are dropped; ``late_rows`` counts them.
    """
    good = stream.filter(usage.good_submission()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within)
    return good.dropDuplicatesWithinWatermark(session).writeStream.format("parquet").option("path", f"{path}/accepted") \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def late_rows(query) -> int:
    """Rows a query dropped because they came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


# --- running counts -------------------------------------------------------------------------

def count_stream(stream: DataFrame, path: str, key: Column, **trigger):
    """Counts so far: after each batch the keys it changed are logged with their new count."""
    counts = stream.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    begin(stream.sparkSession, path, "counts", counts.schema)
    return counts.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: append(batch, path, "counts", batch_id)) \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def counts_so_far(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The count of each key after the batches (before ``before``). Counts only grow, so the largest is the newest."""
    return log(spark, path, "counts", before).groupBy("key").agg(F.max("n").alias("n"))


# --- run summary ----------------------------------------------------------------------

def summary(stream: DataFrame, ts: str, part: str, success: Column, rows: Column, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """attempted / success / rows per tumbling window and partition (batch or stream)."""
    src = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    if src.isStreaming:
        src = src.withWatermark("_ts", late)
    return src.groupBy(F.window("_ts", width).alias("w"), part).agg(
        F.count("*").alias("attempted"), F.count_if(success).alias("success"),
        F.sum(F.when(success, rows).otherwise(F.lit(0))).cast("bigint").alias("new_rows")) \
        .select(F.col("w.start").alias("window_start"), part, "attempted", "success", "new_rows")


def summary_stream(stream: DataFrame, path: str, **trigger):
    """Append closed windows to a table."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/summary") \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)
