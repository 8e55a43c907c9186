import random

import pytest

from slotatlas.llm import trie
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, depth int, chunk string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = trie.nodes(trie.rebuilt(df)).collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out}
    assert len(got) == len(out)
    return got


def some_rows(seed, convs, most, texts):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"][:1 + t % 2]), rng.choice(texts))
            for c in rng.sample(range(convs * 2), convs) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_brute_force(spark, seed):
    rows = some_rows(seed, 300, 6, ["a b", "a", "c  d\te", ""])
    assert run(spark, rows) == brute.trie(brute.rebuilt(rows))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(20, None, "user", "first"), (20, 0, None, None), (20, 0, "user", "x y"), (20, 0, "user", "x y"), (21, 1, "a", "b"), (21, 1, "a", "a"),
            (21, None, None, "n"), (22, 0, "user", None), (None, 0, "user", "nobody"), (23, 5, "", ""), (24, 0, "user", "first"), (45, 0, "q", "r")]
    assert run(spark, rows) == brute.trie(brute.rebuilt(rows))


def test_conversations_without_turns_and_without_donor(spark):
    rows = [(c, 0, "user", f"text {c % 3}") for c in range(101, 160)]
    want = brute.trie(brute.rebuilt(rows))
    assert run(spark, rows) == want and any(not t for t in brute.rebuilt(rows).values())


def test_one_long_conversation_and_many_equal_ones(spark):
    rows = [(0, t, "user", f"word {t % 7} " * (t % 3)) for t in range(150)] + [(c, t, "user", "same") for c in range(1, 400) for t in range(2)]
    assert run(spark, rows) == brute.trie(brute.rebuilt(rows))


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_end_lists_of_several_texts(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_TOGETHER", 3)
    ids = [*range(-7, 40), 10**15, 10**15 + 1]
    df = spark.createDataFrame([(i, 5, i) for i in ids] + [(i, 6, 0) for i in (3, 1)], "conv_id long, depth long, a long").withColumnRenamed("a", "b")
    df = df.selectExpr("conv_id", "depth", "0L as a", "0L as b")
    got = {r.depth: r.ends_sha256 for r in trie.digests(df, trie.NODE).collect()}
    assert got == {5: brute.sha(",".join(map(str, ids))), 6: brute.sha("1,3")}
