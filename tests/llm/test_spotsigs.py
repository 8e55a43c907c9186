import random

import pytest
import xxhash
from pyspark.sql import functions as F

from slotatlas.llm import spotsigs
from tests.llm import brute

BASE = "the cat of a house in the big town and the dog is on the red mat with no sound at all from the far hill"


def sets(print_):
    return {print_[k:k + 16] for k in range(0, len(print_), 16)}


def test_edited_and_next_texts(spark):
    texts = [(1, BASE), (2, BASE), (3, None), (4, ""), (5, "the of the of " * 20000), (6, "x"), (7, "!!!"), (9, "é 👩 " * 9), (12, BASE + " end")]
    df = spark.createDataFrame([(i, t, "c") for i, t in texts[::-1]], "doc_id long, text string, chunk string")
    rows = {r.doc_id: r for r in spotsigs.compare(df).collect()}
    whole = [(i, t or "") for i, t in texts]
    for k, (i, t) in enumerate(whole):
        after, half = whole[(k + 1) % len(whole)][1], len(t) // 2
        edited, r = t[:len(t) - half] + after[:half], rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited))
        a, b, n = sets(r.fingerprint), sets(r.edited_fingerprint), sets(rows[whole[(k + 1) % len(whole)][0]].fingerprint)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & n) / len(a | n))
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].near_next == 1.0
    assert rows[6].fingerprint != rows[7].fingerprint != rows[4].fingerprint == rows[3].fingerprint


def test_chains_skip_common_words(spark):
    def of(text):
        return set(spark.range(1).select(spotsigs.signatures(F.lit(text)).alias("s")).first().s)

    both = of("the cat of a house in big town and dog is far on hill") & of("The CAT, house - in big town and dog far hill")
    assert both


def test_runs_of_anchors_of_any_length_lose_no_chain(spark):
    rng = random.Random(4)
    texts = ["the " + "of " * k + "cat " + "in a " * k + "house by far sea" for k in (1, 8, 9, 30, 70_000)]
    texts += [" ".join(rng.choice(["the", "of", "und", "la", "x", "yy", "zoo"]) for _ in range(n)) for n in (40, 400, 4000)]
    texts += ["far cat " + "the of " * 100_000 + "end", "far cat " + "the " * 1000 + "end now", "the " * 5 + "cat sat " + "z" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    signed = lambda text, seed: xxhash.xxh64_intdigest(text.encode(), seed)
    for k, text in enumerate(texts):
        words, after, want, n = text.split(), [], set(), 0
        for w in reversed(words):
            if w not in spotsigs.ANCHORS:
                after = [w, *after][:2]
            elif len(after) == 2:
                want.add(signed(f"\x01{w} {after[0]} {after[1]} ", 42))
                n += 1
        if n < spotsigs.LEAST_SPOTS:
            assert want <= {x % 2 ** 64 for x in got[k]} and k == 8
        else:
            assert {x % 2 ** 64 for x in got[k]} == want


def test_repeated_rows_one_row_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "doc_id long, text string")
    assert spotsigs.compare(df).count() == 3
    one = spotsigs.compare(df.where("text = 'b'")).first()
    assert one.near_next == 1.0
    assert spotsigs.compare(df.limit(0)).count() == 0


def test_matches_against_all_pairs(spark):
    words = BASE.split()
    texts = [(k, " ".join(words * 3 + [f"in n{j} m{j} the o{j} p{j}" for j in range(k % 5)] + [f"the z{k}"] * (k > 10))) for k in range(20)]
    texts += [(30, None), (31, "plain text without common ones"), (32, " ".join(words * 3))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    members, pairs = spotsigs.matches(df, 0.8)
    rep = dict(map(tuple, members.collect()))
    prints = {r.doc_id: frozenset(r.s) for r in df.select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    assert {i: min(j for j in prints if prints[j] == prints[i]) for i in prints} == rep
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and len(prints[a] & prints[b]) >= 0.8 * len(prints[a] | prints[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
