"""Operators on small tables: skew, ties, idempotence, brute force."""

import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotatlas.operators import cleaning, facets, joins, publish, quality, ranking, reconcile, segmented, sequences, stats


def skewed(spark, n=600):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.6 else rng.choice([None, 2, 3, 4, 5]), i, i // 25, rng.choice([None, "a", "b", "c"]), rng.randint(1, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, t int, chunk int, v string, x int")


def test_segmented_equals_window(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("t")
    expected = df.select("t", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.lag("x").over(w).alias("b"),
                         F.lead("x").over(w).alias("f"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    out = segmented.carry_forward(df, ["k"], ["t"], "chunk", F.col("v"), "c")
    out = segmented.lag(out, ["k"], ["t"], "chunk", {"x": "b"})
    out = segmented.lead(out, ["k"], ["t"], "chunk", {"x": "f"})
    out = segmented.running_sum(out, ["k"], ["t"], "chunk", F.col("x"), "s")
    assert sorted(map(tuple, out.select("t", "c", "b", "f", "s").collect())) == sorted(map(tuple, expected.collect()))


def test_distributed_rank_equals_row_number(spark):
    df = skewed(spark)
    expected = df.select("t", F.row_number().over(Window.partitionBy("k").orderBy("x", "t")).alias("r"))
    got = ranking.distributed_rank(df, ["k"], [F.col("x"), F.col("t")], "r").select("t", "r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    whole = ranking.distributed_rank(df, [], [F.col("t")], "r")
    assert {(r["t"], r["r"]) for r in whole.collect()} == {(i, i + 1) for i in range(600)}


def brute_pairs(points, eps):
    merged = {}
    for i, p, x, y in points:
        merged.setdefault((p, x, y), []).append(i)
    pos = [(p, x, y, min(ids), len(ids)) for (p, x, y), ids in merged.items()]
    same = [(p, min(ids), i, 1, 1) for (p, _, _), ids in merged.items() for i in ids if i != min(ids)]
    return sorted(same + [(a[0], a[3], b[3], a[4], b[4]) for a in pos for b in pos
                          if a[0] == b[0] and a[3] < b[3] and abs(a[1] - b[1]) < eps and abs(a[2] - b[2]) < eps])


def test_close_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    points = [(i, i % 3, round(rng.uniform(0, 0.2), 3), round(rng.uniform(-0.1, 0.1), 3)) for i in range(300)]
    points += [(1000 + i, 0, 0.0505, 0.0505) for i in range(50)]  # one position, many rows
    points += [(2000, 1, 0.5, 0.5), (2001, 1, 0.75, 0.5)]  # exactly eps apart: no pair
    df = spark.createDataFrame(points, "id int, part int, x double, y double")
    for target in (2000, 3):  # with a target of 3 most cells are split
        got = joins.close_pairs(df, "part", "x", "y", "id", eps=0.02, target=target)
        assert sorted(map(tuple, got.collect())) == brute_pairs(points, 0.02)
    far = joins.close_pairs(df.filter("id >= 2000"), "part", "x", "y", "id", eps=0.25)
    assert far.count() == 0
    same = joins.same_position(df, "part", "x", "y", "id").filter("id_1 = 1000").first()
    assert same["n_same"] == 50


def test_active_rule(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "active boolean")
    assert [r[0] for r in df.select(facets.is_active()).collect()] == [True, False, True]


def slots_df(spark, rows):
    return spark.createDataFrame(rows, "class_id int, place_id int, day string, time_start string, time_end string, class_name string, verified boolean")


def test_garbage_and_idempotence(spark):
    df = slots_df(spark, [
        (1, 1, "Monday", "09:00", "10:00", "Yin", True), (2, 1, "Monday", "23:30", "00:30", "Late", True),
        (3, 1, "Monday", "09:00", "10:00", "10:00RachelVinyasa", True), (4, 1, "Monday", "x", "10:00", "a" * 45, True),
        (5, 1, "Monday", "09:00", "10:00", "x" * 40 + "camelCase", True), (6, 1, "Monday", "9:00", "10:00", None, True)])
    once = df.filter(~cleaning.is_garbage())
    assert sorted(r["class_id"] for r in once.collect()) == [1, 4, 6]
    assert once.filter(~cleaning.is_garbage()).count() == once.count()


def test_null_impossible(spark):
    df = spark.createDataFrame([(1, 1100.0, 50.0), (2, 3.0, None), (3, 100.0, 700.0)], "id int, single double, card_10 double")
    out = cleaning.null_impossible(df, {"single": (3, 100), "card_10": (60, 700)})
    assert sorted(map(tuple, out.collect())) == [(1, None, None, 2), (2, 3.0, None, 0), (3, 100.0, 700.0, 0)]


def test_slot_rules_stop_after_bad_clock_and_order(spark):
    df = slots_df(spark, [(1, 1, "Funday", "x", "10:00", "a", True), (2, 1, "Monday", "03:00", "02:00", "a", True),
                          (3, 1, "Monday", "03:00", "", "a", True), (4, 2, "Monday", "10:00", "10:15", "a", True), (5, 3, None, "9:00", "10:00", "a", True)])
    rules = [r for rs in quality.slot_rules().values() for r in rs]
    got = quality.run_rules(quality.with_clocks(df), rules, {"id": F.col("class_id")})
    assert sorted((r["id"], r["type"]) for r in got.collect()) == [
        (1, "invalid_day"), (1, "invalid_time"), (2, "end_before_start"), (2, "unusual_class_time"), (3, "invalid_time"),
        (4, "unusual_duration"), (5, "invalid_day")]
    parents = spark.createDataFrame([(9,)], "id int")
    orphans = quality.orphan_findings(df, parents, "place_id")
    assert sorted((r["entity_id"], r["value"]) for r in orphans.collect()) == [("2", "1"), ("3", "1")]
    assert quality.orphan_findings(df, parents, "place_id", count_all=True).count() == 3


def test_findings_carry_name_partition_and_source(spark):
    df = spark.createDataFrame([(1, "Lotus", "zh", 500.0, "web"), (2, None, "be", 600.0, None)], "id int, name string, part string, single double, platform string")
    found = quality.run_rules(df, quality.range_rules({"single": (3, 100)}, F.col("platform")), {"entity_id": F.col("id").cast("string")})
    named = quality.name_entities(found, df.filter("id = 1"))
    assert sorted((r.entity_id, r.entity_name, r.part, r.source) for r in named.collect()) == [("1", "Lotus", "zh", "web"), ("2", None, None, "")]
    groups = stats.duplicates(spark.createDataFrame([(2, "b", "x", "p"), (1, "a", "x", "p"), (3, "c", "y", "p")], "id int, name string, k string, part string"),
                              ["part", "k"], "id", label="name")
    r = quality.duplicate_findings(groups, "duplicate_name", "medium", "name", "first_id", "k").first()
    assert (r.entity_id, r.entity_name, r.part, r.value, r.source) == ("1", "a", "p", "x x2", "")


def test_snapshot_diff_skips_null_and_zero(spark):
    old = spark.createDataFrame([(1, 20.0, 0.0), (2, None, 100.0), (3, 30.0, 100.0)], "id int, a double, b double")
    new = spark.createDataFrame([(1, 30.1, 5.0), (2, 9.0, 80.0), (3, 36.0, 10.0)], "id int, a double, b double")
    got = {(r["id"], r["field"]): (r["severity"], r["signed_pct"] > 0) for r in joins.snapshot_diff(old, new, ["id"], ["a", "b"]).collect()}
    assert got == {(1, "a"): ("high", True), (3, "b"): ("high", False)}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "owner int, v string")
    new = spark.createDataFrame([(1, "x"), (3, "y")], "owner int, v string")
    once = reconcile.replace_by_key(old, new, "owner")
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "c"), (3, "y")]
    assert sorted(map(tuple, reconcile.replace_by_key(once, new, "owner").collect())) == sorted(map(tuple, once.collect()))


def test_best_attempt_order(spark):
    df = spark.createDataFrame([(1, 0, False, 3), (1, 1, True, 1), (1, 2, True, 2), (1, 3, True, 2), (2, 0, False, 1), (2, 1, False, 1)],
                               "k int, pos int, main boolean, n int")
    got = sequences.best_attempt(df, ["k"], F.col("main"), F.col("n"), "pos")
    assert sorted((r["k"], r["pos"]) for r in got.collect()) == [(1, 2), (2, 0)]


def test_miss_streak(spark):
    marks = "fffsffffffff" + "s"
    df = spark.createDataFrame([(1, i, i // 4, c == "f") for i, c in enumerate(marks)] + [(2, i, i // 4, i % 2 == 0) for i in range(20)],
                               "k int, t int, chunk int, bad boolean")
    got = sequences.until_miss_streak(df, ["k"], ["t"], "chunk", F.col("bad"), 6)
    assert got.filter("k = 1").count() == 10 and got.filter("k = 2").count() == 20


def test_miss_streak_against_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for key in [None, *range(30)]:
        going, streak = True, 0
        for t in range(2000 if key == 0 else rng.randrange(60)):
            bad = rng.choices([True, False, None], [8, 4, 1])[0] if key else rng.random() < 0.3
            rows.append((key, t, t // 3, bad))
            if going:
                want.add((key, t))
                streak = 0 if bad is False else streak + 1
                going = streak < 4
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, t int, chunk int, bad boolean")
    for chunk in ("chunk", "one"):
        got = sequences.until_miss_streak(df.withColumn("one", F.lit(0)), ["k"], ["t"], chunk, F.col("bad"), 4).select("k", "t").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert sequences.until_miss_streak(df.limit(0), ["k"], ["t"], "chunk", F.col("bad")).count() == 0


def test_merged_provenance_keeps_links(spark):
    df = spark.range(4).selectExpr(
        "id", "CASE WHEN id > 1 THEN named_struct('scrape_status', 'old', 'last_price_check', 'd', 'source_urls', map('website', 'w'), "
        "'booking_links', array('b')) END AS meta", "CASE id % 2 WHEN 0 THEN array('n') ELSE CAST(array() AS array<string>) END AS links", "CAST(NULL AS string) AS none")
    got = df.select("id", reconcile.merge_meta("meta", "none", "none", "none", "none", F.lit("now"), "links").alias("m")).select("id", "m.*")
    assert {r.id: (r.booking_links, r.last_scraped, r.last_price_check) for r in got.collect()} == {
        0: (["n"], "now", None), 1: ([], "now", None), 2: (["n"], "now", "d"), 3: (["b"], "now", "d")}


def test_robots_groups(spark):
    star = "User-agent: *\nDisallow: /"
    df = spark.createDataFrame([
        ("closed", star), ("other", "User-agent: Bad\nDisallow: /\nUser-agent: *\nDisallow: /private"), ("empty", ""),
        ("second", "User-agent: Bad\nAllow: /\n\nUser-agent: *\nCrawl-delay: 2\nDisallow: /\n"), ("crlf", star.replace("\n", "\r\n"))], "host string, body string")
    assert sorted(r[0] for r in cleaning.robots_disallowed(df).collect()) == ["closed", "crlf", "second"]


def test_sorts(spark):
    df = spark.createDataFrame([(1, "10:00", 30.0), (2, "9:00", None), (3, "x", 0.0)], "class_id int, time_start string, single double") \
        .withColumn("day", F.lit("Monday"))
    assert [r["class_id"] for r in df.orderBy(*facets.week_order()).collect()] == [2, 1, 3]
    assert [r["class_id"] for r in df.orderBy(F.asc_nulls_last("single")).collect()] == [3, 1, 2]


def test_locale_sort(spark):
    df = spark.createDataFrame([(1, "Zürich"), (2, "Öse"), (3, "Oase"), (4, "aare")], "id int, name string")
    assert [r["id"] for r in df.orderBy(*facets.sort_columns("name")).collect()] == [4, 3, 2, 1]


def test_duplicates_keep_lowest_id(spark):
    df = spark.createDataFrame([(5, "a"), (3, "a"), (3, "a"), (9, "b"), (1, None), (2, None), (7, " "), (8, " ")], "id int, n string")
    assert set(map(tuple, stats.duplicates(df, ["n"], "id").collect())) == {("a", 2, 3)}
    assert {(r["n"], r["id"]) for r in stats.duplicate_members(df, ["n"], "id").collect()} == {("a", 3), ("a", 5)}


def test_merge_keeps_check_dates(spark):
    old = spark.createDataFrame([(1, 10.0, 20.0, "o", "o")], "id int, a double, b double, a_checked string, b_checked string")
    new = spark.createDataFrame([(1, 11.0, None)], "id int, a double, b double")
    assert tuple(reconcile.merge_struct(old, new, "id", ["a", "b"], "n").first()) == (1, 11.0, 20.0, "n", "o")


def test_equal_positions_are_pairs(spark):
    from slotatlas.operators import joins
    df = spark.createDataFrame([(5, "p", 1.0, 1.0), (3, "p", 1.0, 1.0), (9, "p", 1.0, 1.0), (4, "p", 1.001, 1.0), (7, "q", 1.0, 1.0), (8, "p", None, 1.0)],
                               "id bigint, part string, x double, y double")
    for target in (1, 2000):
        got = joins.close_pairs(df, "part", "x", "y", "id", eps=0.01, target=target)
        assert set(map(tuple, got.collect())) == {("p", 3, 4, 3, 1), ("p", 3, 5, 1, 1), ("p", 3, 9, 1, 1)}


def test_answers_without_prices_tags_or_towns(spark):
    facts = spark.createDataFrame([("a", 3, 0, 0, None, None, None, None)], "part string, n_places long, n_slots long, n_tags long, lo double, hi double, top_tags string, top_cities string")
    answers = [q["acceptedAnswer"]["text"] for q in json.loads(publish.faq_docs(facts).first()["doc"])["mainEntity"]]
    assert answers == ["3 places with 0 weekly slots.", "No kinds are listed yet.", "Prices vary.", "No towns are listed yet."]
