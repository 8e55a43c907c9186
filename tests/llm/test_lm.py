import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from slotatlas.llm import lm
from tests.llm import brute

TEXTS = ["the cat sat", "the cat ran off", "the cat sat", None, "", "solo", "a b a b a b", "x " * 3000, "the dog sat on the cat"]


def test_scores_against_brute_force(spark):
    df = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(TEXTS)], "doc_id long, text string, score double")
    rows = {r.doc_id: r for r in lm.score(df).collect()}
    for k, want in enumerate(brute.scores(TEXTS)):
        assert rows[k].score == pytest.approx(want) and rows[k].n_words == len((TEXTS[k] or "").split())
        assert rows[k].mean_score == pytest.approx(want / max(1, rows[k].n_words))


def test_longer_orders_back_off_step_by_step(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "x b c")], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in lm.score(df, order=3, held_out=False).collect()}
    import math
    assert rows[1] == pytest.approx(math.log10(2 / 9) + math.log10(2 / 2) + math.log10(1 / 2))
    held = {r.doc_id: r.score for r in lm.score(df, order=3).collect()}
    assert held[1] == pytest.approx(math.log10(1 / 6) + math.log10(1 / 1) + math.log10(0.4 * 1 / 2))


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert len({round(r.score, 9) for r in lm.score(df).collect()}) == 1
    assert lm.score(df.limit(0)).count() == 0


def test_words_of_the_corpus_are_counted_with_the_n_grams(spark):
    """no job of its own cuts all texts into words in the JVM, whose heap stayed grown; every block still gets the whole number."""
    texts = [f"w{k} common w{k + 1}" for k in range(40)] + [None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.sparkContext.setJobGroup("lm", "lm")
    try:
        scored = lm.score(df)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lm")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = {r.doc_id: r.score for r in scored.collect()}
    assert [rows[k] for k in range(len(texts))] == pytest.approx(brute.scores(texts))


def test_dealing_gives_up_what_is_held():
    """beside the n-grams that are held, a part of their size is needed, not copies of all orders and parts."""
    rng = np.random.default_rng(7)
    held, made = defaultdict(list), []
    tracemalloc.start()
    try:
        for k in range(2 * 8):
            held[k % 2, k // 2].extend(rng.integers(0, 1 << 63, 100_000, np.uint64) * np.uint64(2) for _ in range(2))
        want = {key: np.unique(np.concatenate(grams)) for key, grams in held.items()}
        kept = sum(g.nbytes for g in want.values())
        tracemalloc.reset_peak()
        for batch in lm._dealt(held, 2, 4):
            made.append(batch.to_pylist())
            kept += sum(len(value) for r in made[-1] for value in r.values() if isinstance(value, bytes))
            assert tracemalloc.get_traced_memory()[1] - kept < 1.75 * 25_600_000
        assert not held
    finally:
        tracemalloc.stop()
    rows = sum(made, [])
    found = defaultdict(list)
    for r in rows:
        sizes = np.frombuffer(r["sizes"], np.int32)
        ends = np.cumsum(sizes)[:-1]
        for block, steps, counts in zip(np.frombuffer(r["blocks"], np.int32), np.split(lm.expand(r["grams"], np.uint64), ends),
                                        np.split(lm.expand(r["counts"], np.uint32), ends)):
            assert (counts == 1).all()
            found[r["gram_order"], int(block)].append(np.cumsum(steps, dtype=np.uint64))
    assert {k: np.concatenate(v).tolist() for k, v in found.items()} == {k: v.tolist() for k, v in want.items()}
