"""Sources and sinks on written files."""

import json

from pyspark.sql import functions as F

from slotatlas import schemas
from slotatlas.sources import readers, writers


def test_envelope_files_and_quarantine(spark, tmp_path):
    (tmp_path / "studios_zug.json").write_text(json.dumps({"last_updated": "2026-01-01", "studios": [
        {"id": "a", "name": "A", "active": None, "pricing": {"single": 25}}, {"id": "b", "name": "B", "pricing": {"single": 29.5}}]}, indent=1))
    (tmp_path / "studios_uri.json").write_text("{ broken")
    (tmp_path / "studios_zug.enc.json").write_text('{"e": "x"}')
    rows, bad = readers.read_envelopes(spark, str(tmp_path), schemas.PLACE_ENVELOPE, "studios")
    assert sorted((r["part"], r["id"], r["pricing"]["single"], r["envelope_last_updated"]) for r in rows.collect()) == [
        ("zug", "a", 25.0, "2026-01-01"), ("zug", "b", 29.5, "2026-01-01")]
    assert [r["_file"].split("_")[-1] for r in bad.collect()] == ["uri.json"]


def test_dynamic_map_layouts(spark):
    docs = ['{"_meta": {"n": 1}, "s1": {"single": 25, "verified": true}, "date": "x"}', '{"studios": {"s2": {"card_10": "250-300"}}, "total": 1}',
            '{"zug": {"s3": {"single": null, "trial": 0}}, "bern": {"s4": {"single": 9}}}', "{broken"]
    got = readers.dynamic_map(spark.createDataFrame([(d,) for d in docs], "t string"), "t", ["single", "card_10", "trial"])
    assert sorted((r["part"] or "", r["id"], r["single"], r["card_10"]) for r in got.collect()) == [
        ("", "s1", "25", None), ("", "s2", None, "250-300"), ("bern", "s4", "9", None), ("zug", "s3", None, None)]


def test_decode_is_the_inverse_of_encode(spark):
    texts = ["", "a", "Zürich – «Öse»", "x" * 1000, '{"a": [1, 2]}\n']
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", readers.encode_payload("t"))
    got = df.select("t", "e", readers.decode_payload("e").alias("d")).collect()
    assert all(r["t"] == r["d"] and "\n" not in r["e"] for r in got)
    bad = spark.createDataFrame([("not base64!",), (None,)], "e string")
    assert [r[0] for r in bad.select(readers.decode_payload("e")).collect()] == [None, None]


def test_missing_changelog_is_empty(spark, tmp_path):
    assert readers.read_changelog(spark, str(tmp_path / "none")).count() == 0


def test_partitioned_write_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "part string, v int")
    writers.write_partitioned(df, path, "part", "d1")
    writers.write_partitioned(df.filter("part = 'b'").withColumn("v", F.lit(9)), path, "part", "d2")
    assert sorted((r["part"], r["v"], r["last_updated"]) for r in spark.read.parquet(path).collect()) == [("a", 1, "d1"), ("b", 9, "d2")]


def test_envelopes_split_big_partitions(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, F.lit("big")).otherwise(F.lit("small")).alias("part"), "id")
    docs = writers.envelopes(df, "part", "studios", "d", "id", per_doc=100)
    sizes = docs.select("part", F.size("studios").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == 1000 and max(r["n"] for r in sizes) < 200


def test_snapshot_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    for i in (1, 2):
        writers.write_snapshot(spark.range(i), path, f"r{i}")
    assert readers and writers.read_snapshot(spark, path).count() == 2
    assert writers.read_snapshot(spark, path, "r1").count() == 1
    latest = writers.read_snapshot(spark, path)
    plan = latest._jdf.queryExecution().executedPlan().toString().lower()
    filters = plan.split("partitionfilters: [")[1].split("]")[0]
    assert "subquery" in filters and latest.columns == ["id", "run_id"]


def test_broken_change_records_are_kept_apart(spark, tmp_path):
    good = {"timestamp": "t", "studio_id": "a", "canton": "c", "field": "single", "old_value": 1.0, "new_value": 2.0, "source": "s"}
    (tmp_path / "a.json").write_text(json.dumps(good) + "\n{broken\n" + json.dumps([good, good | {"studio_id": "b"}]) + "\n\n")
    (tmp_path / "b.json").write_text(json.dumps(good | {"old_value": "many"}) + "\n" + json.dumps(good) + "\n")
    rows, broken = readers.changelog_parts(spark, str(tmp_path))
    assert sorted(r["studio_id"] for r in rows.collect()) == ["a", "a", "a", "b"]
    assert sorted((r["file"].split("/")[-1], "many" in r["record"]) for r in broken.collect()) == [("a.json", False), ("b.json", True)]
    assert broken.count() == 2 and rows.count() == 4
    assert readers.changelog_parts(spark, str(tmp_path / "none"))[1].count() == 0
