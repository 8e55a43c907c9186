import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from slotatlas.llm import ngram_join
from tests.llm import brute


def check(spark, texts, extra="clash"):
    df = spark.createDataFrame([(i, t, extra) for i, t in texts.items()], "doc_id long, text string, class_id string")
    rows = {r.doc_id: r for r in ngram_join.join(df).collect()}
    want = brute.links(texts)
    assert {i: (r.class_id, r.n_links) for i, r in rows.items()} == want
    for i, r in rows.items():
        assert r.copy_of == min(j for j in texts if brute.grams(texts[j]) == brute.grams(texts[i]))


def test_copies_near_copies_and_odd_texts_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts, n = {}, 0
    for group in range(12):
        base = rng.choices(words, k=rng.choice([3, 8, 40, 120, 400]))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[n] = " ".join(copy)
            n += 1
    texts |= {n: None, n + 1: "", n + 2: "  \n", n + 3: "one two", n + 4: "one two", n + 5: "long " * 30000}
    check(spark, texts)


def test_one_large_group_of_near_copies_is_spread_over_blocks(spark):
    rng = random.Random(6)
    base = [f"b{k}" for k in range(200)]
    texts = {}
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(200)] = f"x{rng.randrange(50)}"
        texts[i] = " ".join(copy)
    check(spark, texts)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand here today ok")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in ngram_join.join(df).collect())
    assert rows == [(1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 2), (3, 3, 3, 0)]
    assert ngram_join.join(df.limit(0)).count() == 0


def test_null_and_repeated_ids_lose_no_documents(spark):
    rng = random.Random(8)
    text = lambda n=60: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    base, alone, other, third = text(), text(), text(), text()
    big = 2 ** 60 + 1  # no float
    rows = [(None, base), (9, base), (7, base), (8, [*base, "near"]), (None, alone), (big, other), (big, third), (None, [*third, "near"]), (big, other)]
    rows += [(None, ["x", *alone]), (3, text(2)), (None, None)]
    df = spark.createDataFrame([(i, t and " ".join(t), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    got = sorted((r.doc_id or -1, r.copy_of or -1, r.class_id or -1, r.n_links) for r in ngram_join.join(df.drop("k")).collect())
    assert got == sorted([(-1, 7, 7, 3), (9, 7, 7, 3), (7, 7, 7, 3), (8, 8, 7, 3), (-1, -1, -1, 1), (-1, -1, -1, 1), (big, big, big, 1),
                          (big, big, big, 1), (big, big, big, 1), (-1, -1, big, 1), (3, 3, 3, 0), (-1, -1, -1, 0)])
    kept = ngram_join.firsts(df).collect()
    assert len(kept) == 6 and {r.k for r in kept} - {4, 5, 8, 9} == {2, 6, 10, 11}
    assert len({r.k for r in kept} & {4, 9}) == len({r.k for r in kept} & {5, 8}) == 1
    names = ngram_join.join(df.withColumn("doc_id", F.concat(F.lit("n"), "k"))).collect()
    assert {r.doc_id: r.class_id for r in names}["n2"] == "n0"


def test_pipeline_keeps_one_row_of_each_group(spark):
    rows = [(None, "alone stands this text here today"), (5, "one text of the id five is"), (5, "something else has the same id"),
            (None, "a copy with and without id"), (6, "a copy with and without id"), (7, "a copy with and without id")]
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.ngram_jaccard_join(spark, df, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {(r.doc_id, r.text) for r in kept.collect()} == {*rows[:3], rows[4]}


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold ** rows) ** bands >= recall and bands * rows <= 128


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(500, 499), (498, 499)]
    roots = dict(map(tuple, ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert set(roots.values()) == {1, 100, 498} and len(roots) == 40 + 28 + 2


def test_overlaps_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30_000, n).astype(np.uint64)) for n in (1, 50, 5000, 12_000)]
    got = ngram_join.overlaps(sets, sets)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()
