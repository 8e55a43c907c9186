from pyspark.sql import functions as F

from slotatlas.llm import quality
from tests.llm import brute


def judged(spark, rows, labels, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return quality.judge(df, known, **options)


def sample(spark):
    good = [(k, " ".join(f"w{k}x{j}" for j in range(60)), "1", "en") for k in range(60)]
    bad = [(100 + k, " ".join(f"w{k}y{j}###" for j in range(60)), "1", "en") for k in range(30)]
    labels = [(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(30)]
    return good, bad, labels


def test_statistics_against_brute_force(spark):
    texts = [None, "", " ", "a", "a b c a b c", "x y\nx y\n\n \nx y", "r r r r r r", "a b c d a b c e a b c", "#* $%&|<>", "é 👩 x\x0by\x0cz",
             "w " * 5000, "a b c d " * 500, "  nbsp word"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.statistics(df).collect():
        assert tuple(r[n] for n in quality.STATISTICS) == brute.statistics(texts[r.doc_id]), texts[r.doc_id]


def test_rules_are_learned_and_keep_clean_texts(spark):
    good, bad, labels = sample(spark)
    rows = judged(spark, good + bad, labels).collect()
    assert {r.doc_id for r in rows if r.kept} == {k for k in range(60)}
    assert all(r.rule for r in rows if r.doc_id >= 100)
    assert rows[0].__fields__[:3] == ["doc_id", "text", "lang"]


def test_without_labels_only_the_base_rule_rejects(spark):
    good, bad, labels = sample(spark)
    odd = [(None, None, None, None), (7, "", "", ""), (8, "short text", "", ""), (9, "same " * 80, "", ""), (9, "same " * 80, "", "")]
    for known in ([], [(k, None, 0) for k in range(9)], [(k, 1, 0) for k in range(9)], [(k, 5, 0) for k in range(9)]):
        rows = judged(spark, good[:6] + odd, known, carry=["doc_id"]).collect()
        assert len(rows) == 11 and sum(r.kept for r in rows) == 6
    assert judged(spark, [], labels).count() == 0


def test_pruning_and_order_of_rules():
    cuts = {"a": [1.0], "b": [1.0]}
    table = [quality.Cell((1, 0), (50, 0), (20, 0)), quality.Cell((0, 0), (0, 200), (0, 90)), quality.Cell((0, 1), (10, 1), (5, 0)),
             quality.Cell((1, 1), (9, 0), (3, 0))]
    rules = quality.learn(table, cuts, precision=0.9)
    assert [str(r) for r in rules] == ["a > 1", "b > 1"]
    assert [(r.bad, r.good) for r in rules] == [(82, 0), (15, 1)]
    assert quality.learn([], cuts) == []


def test_many_distinct_words_have_no_repeat(spark):
    rows = spark.range(1).select(F.lit(1).alias("doc_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0), F.lit(2_999_999)), lambda i: F.conv(i.cast("string"), 10, 36))).alias("text"), F.lit(0).alias("words"), F.lit(0).alias("__lines"))
    out = quality.statistics(rows).select("n_words", "n_repeat_words", "words", "__lines").first()
    assert tuple(out) == (3_000_000, 0, 0, 0)


def test_windows_that_share_a_hash_are_compared(spark, monkeypatch):
    monkeypatch.setattr(quality, "window_hash", lambda *words: F.lit(7).cast("long"))
    texts = ["a b c d e f g", "a b c x a b c", "a b c a b c a b", "q a a a a r"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = [r.n_repeat_words for r in quality.statistics(df).orderBy("doc_id").collect()]
    assert got == [brute.statistics(t)[4] for t in texts] == [0, 6, 8, 4]
