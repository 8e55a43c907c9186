"""Join of texts whose sets of word n-grams have a Jaccard similarity of at least a threshold.

MinHash banding with bands and rows chosen for a target recall: documents meet where all rows of a band agree, and
every pair that meets is verified on the full n-gram sets.

- Texts with equal n-gram sets form a class, keyed by a digest of the set. Only its representative (the row with the
  smallest id; rows without id come last) goes on. Ids are payload: they may be null or repeated.
- A band hash of one representative alone is dropped. The others gather in homes, around the band hash that they share
  with most, and homes are cut into blocks of about BLOCK members by hash. Two blocks are paired when some band hash
  has members of both. So a text travels once for each pair of blocks it belongs to, not once for each band or
  partner, and a group of any size is spread over many tasks of bounded size.
- A task verifies all pairs of two blocks at once. It gives the number of links for each member (copies included) and
  a spanning forest of its links, never the pairs themselves.
- Groups are the connected components of the forests.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotatlas.llm.bpe import map_text
from slotatlas.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Members of a block, about.
BLOCK = 128
#: Most classes that are broadcast.
LARGE = 2000
#: Entries a worker remembers before it starts anew. Has no influence on results.
REMEMBERED = 500_000
#: N-gram columns multiplied at a time.
COLUMNS = 8192
#: Columns that make and order the nodes of links: rows with an id first, by id, then by the digest of the n-gram set.
NODE = ["no_id", "id", "set_key"]
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """Bands and rows: the most selective bands (most rows) that reach the recall at the threshold within the hashes."""
    for rows in range(most_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold ** rows))) if threshold < 1 else 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("the recall needs more hashes")


class NGrams:
    """Sets of word n-grams as sorted 64-bit hashes. A text with fewer words has one n-gram: all of them."""

    def __init__(self, n: int):
        self.n, self.memo = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text or "")
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        memo = self.memo
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if not len(ids):
            return ids
        width = min(self.n, len(ids))
        grams = np.full(len(ids) - width + 1, width, np.uint64)
        for k in range(width):
            grams = (grams ^ ids[k:len(ids) - width + 1 + k]) * np.uint64(_MIX[0])
            grams ^= grams >> np.uint64(29)
        grams *= np.uint64(_MIX[1])
        return np.unique(grams ^ (grams >> np.uint64(32)))


class MinHash:
    """Band hashes of a set of 64-bit hashes."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20)
        self.shape = bands, rows
        self.factors = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        self.weights = rng.integers(0, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.names = rng.integers(0, 1 << 63, bands, np.uint64)

    def __call__(self, grams: np.ndarray) -> list[int]:
        if not len(grams):
            return []
        least = np.full(len(self.factors), ~np.uint64(0), np.uint64)
        for at in range(0, len(grams), 1024):
            part = grams[at:at + 1024, None] * self.factors + self.shifts
            np.minimum(least, part.min(axis=0), out=least)
        least ^= least >> np.uint64(31)
        bands = (least.reshape(self.shape) * self.weights).sum(axis=1, dtype=np.uint64) + self.names
        bands = (bands ^ (bands >> np.uint64(33))) * np.uint64(_MIX[1])
        return bands.view(np.int64).tolist()


def signatures(df: DataFrame, n: int, bands: int, rows: int, text: str = "text") -> DataFrame:
    """Replace the text by `set_key` (digest of the n-gram set), `n_grams` and `bands` (band hashes). Narrow."""
    def make():
        grams_of, minhash = NGrams(n), MinHash(bands, rows)

        def one(value):
            grams = grams_of(value)
            return [(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), len(grams), minhash(grams))]
        return lambda values: map(one, values)

    fields = [T.StructField("set_key", T.BinaryType()), T.StructField("n_grams", T.LongType()),
              T.StructField("bands", T.ArrayType(T.LongType()))]
    return map_text(df, text, fields, make, lambda row: 300)


def settled(met: DataFrame, rounds: int = 2) -> DataFrame:
    """(set_key, home): those that meet gather in few homes.

    The first home of a representative is the bucket that it shares with most others. In each round, all of a home move
    to the largest home that any of them shares a bucket with, so that the scattered rest of a group joins its core.
    """
    home = met.groupBy("set_key").agg(F.max(F.struct("members", "bucket")).alias("top")).select("set_key", F.col("top.bucket").alias("home"))
    for _ in range(rounds):
        home = materialize(home, "home")
        size = home.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
        seen = met.select("bucket", "set_key").join(home.join(size, "home"), "set_key")
        largest = seen.groupBy("bucket").agg(F.max(F.struct("size", "home")).alias("to"))
        moves = seen.select("bucket", "home").distinct().join(largest, "bucket").groupBy("home").agg(F.max("to").alias("to"))
        home = home.join(moves, "home").select("set_key", F.col("to.home").alias("home"))
    return home


def block_pairs(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_key, block) for representatives that meet another one, and the pairs of blocks to verify (low <= high)."""
    buckets = reps.select("set_key", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = materialize(buckets.join(shared, "bucket"), "met")
    home = settled(met)
    size = home.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.xxhash64("set_key", F.lit(1)), F.ceil(F.col("size") / BLOCK))
    blocks = materialize(home.join(size, "home").select("set_key", F.xxhash64("home", part).alias("block")), "blocks")
    touched = met.select("bucket", "set_key").join(blocks, "set_key").select("bucket", "block").distinct()
    pairs = touched.alias("a").join(touched.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.block") <= F.col("b.block")))
    return blocks, pairs.select(F.col("a.block").alias("low"), F.col("b.block").alias("high")).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    names, where = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    shared = np.zeros((len(left), len(right)), np.float32)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    order = np.argsort(where, kind="stable")
    where, rows = where[order], rows[order]
    for at in range(0, len(names), COLUMNS):
        lo, hi = np.searchsorted(where, [at, at + COLUMNS])
        has = np.zeros((len(left) + len(right), min(COLUMNS, len(names) - at)), np.float32)
        has[rows[lo:hi], where[lo:hi] - at] = 1
        shared += has[:len(left)] @ has[len(left):].T
    return shared


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, exactly."""
    a, b = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    found = np.zeros((len(a), len(b)), bool)
    if not len(a) or not len(b):
        return found
    # sizes alone rule out most pairs of unlike lengths: those sorted far apart are not multiplied
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    for at in range(0, len(ia), 32):
        rows = ia[at:at + 32]
        near = ib[(b[ib] >= threshold * a[rows[0]] - 1e-9) & (threshold * b[ib] <= a[rows[-1]] + 1e-9)]
        if not len(near):
            continue
        both = overlaps([left[k] for k in rows], [right[k] for k in near]).astype(np.int64)
        union = a[rows][:, None] + b[near][None, :] - both
        found[np.ix_(rows, near)] = (both >= threshold * union - 1e-9) & (both > 0)
    return found


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges to the smallest number of each component of the links between two lists of numbers."""
    label = {int(x): int(x) for x in [*left, *right]}

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    for i, j in zip(*np.nonzero(links)):
        x, y = root(int(left[i])), root(int(right[j]))
        if x != y:
            label[max(x, y)] = min(x, y)
    return ((x, root(x)) for x in label if root(x) != x)


def verify(texts: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Rows `no_id, id, set_key, links, to_no_id, to_id, to_set_key`: links found in one pair of blocks, and the edge of its
    forest (to itself: none)."""
    both = [F.struct("low", "high", F.col(x).alias("block")) for x in ("low", "high")]
    sides = pairs.select(F.explode(F.array_distinct(F.array(*both))).alias("pair")).select("pair.*")
    dealt = texts.join(sides, "block").select("low", "high", "block", *NODE, "copies", "text")

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        grams_of = NGrams(n)
        rows = rows.sort_values(NODE, kind="stable", ignore_index=True)
        sets = [grams_of(x) for x in rows["text"]]
        low = (rows["block"] == rows["low"]).to_numpy()
        one = bool((rows["low"] == rows["high"]).all())
        copies = rows["copies"].to_numpy()
        a, b = np.flatnonzero(low), np.flatnonzero(low if one else ~low)
        found = linked([sets[k] for k in a], [sets[k] for k in b], threshold)
        if one:
            np.fill_diagonal(found, False)
        links = np.zeros(len(rows), np.int64)
        links[a] += found @ copies[b]
        if not one:
            links[b] += found.T @ copies[a]
        parent = np.arange(len(rows))
        for x, y in forest(found, a, b):
            parent[x] = y
        keep = np.flatnonzero(links > 0)
        to = rows[NODE].iloc[parent[keep]].add_prefix("to_").reset_index(drop=True)
        return pd.concat([rows[NODE].iloc[keep].reset_index(drop=True), pd.DataFrame({"links": links[keep]}), to], axis=1)

    node = [texts.schema[c] for c in NODE]
    to = [T.StructField(f"to_{f.name}", f.dataType) for f in node]
    return dealt.groupBy("low", "high").applyInPandas(check, T.StructType([*node, T.StructField("links", T.LongType()), *to]))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node in edges (a, b).

    Alternating star contractions; every round is written to the shared folder, so lost executors cost one round.
    """
    def star(df: DataFrame, smaller: bool) -> DataFrame:
        both = df if smaller else df.union(df.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a") if not smaller else both
        joined = moved.join(least, "a")
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y"))
        if smaller:
            out = out.union(least.select("a", "m"))
        return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        now = materialize(star(star(now, False), True), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Add `no_id, id, text_key`, never null: whether the id is missing, the id (any value if it is), and a digest of the text."""
    id_type = df.select(F.col(f"`{doc_id}`")).schema[0].dataType
    return df.select("*", F.col(f"`{doc_id}`").isNull().alias("no_id"), F.coalesce(F.col(f"`{doc_id}`"), F.lit("0").cast(id_type)).alias("id"),
                     F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("text_key"))


def id_of(node: str = "") -> Column:
    return F.when(~F.col(f"{node}no_id"), F.col(f"{node}id"))


def classify(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Signed rows (`no_id, id, text_key, set_key`) of (doc_id, text), and the classes of equal n-gram sets.

    A class has `set_key, copies, n_links`, its representative `first` (a row's no_id, id, text_key) and the node `root` of
    its group: no_id, id and set_key of the group's first class.
    """
    docs = keyed(docs, "doc_id", "text").drop("doc_id")
    bands, rows = choose_bands(threshold, recall)
    signed = materialize(signatures(docs, n, bands, rows), "signatures")
    first = F.min(F.struct("no_id", "id", "text_key", "bands"))
    reps = signed.groupBy("set_key").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")).select("set_key", "first.*", "copies")
    reps = materialize(reps, "representatives")
    blocks, pairs = block_pairs(reps)
    wanted = blocks.join(reps.drop("bands"), "set_key")
    row = ["no_id", "id", "text_key"]
    texts = docs.join(wanted, row).dropDuplicates(row)  # equal rows have equal texts: one of them is enough
    found = materialize(verify(texts, pairs, n, threshold), "links")
    roots = components(found.select(F.struct(*NODE).alias("a"), F.struct(*(F.col(f"to_{c}").alias(c) for c in NODE)).alias("b")))
    counts = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    classes = reps.join(counts, "set_key", "left").join(roots.select(F.col("node.set_key").alias("set_key"), "root"), "set_key", "left")
    classes = classes.select("set_key", "copies", F.struct(*row).alias("first"), F.coalesce("root", F.struct(*NODE)).alias("root"),
                             (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.drop("bands", "n_grams"), materialize(classes, "classes")


def firsts(df: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `df` for each group of copies and near copies: the one with the smallest id, one without id where no row has one."""
    signed, classes = classify(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n, threshold, recall)
    row = ["no_id", "id", "text_key"]
    kept = classes.where(F.col("root.set_key") == F.col("set_key")).select("first.*")
    return keyed(df, doc_id, text).join(kept, row, "left_semi").dropDuplicates(row).select(df.columns)


def join(df: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: `doc_id, copy_of, class_id, n_links`.

    `copy_of` is the smallest id with the same n-gram set, `class_id` the smallest id of the group connected by links
    (null only where no row has an id), `n_links` the number of other rows with a similarity of at least the threshold
    (copies included). Texts without words (null, empty, blank) count as copies of each other. Rows are told apart by
    their n-gram sets, whatever their ids: rows that repeat an id, or have none, have the links of their own text. An
    empty table gives an empty result.
    """
    signed, classes = classify(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n, threshold, recall)
    classes = classes.select("set_key", "copies", id_of("first.").alias("copy_of"), id_of("root.").alias("class_id"), "n_links")
    # a class may hold a third of all rows: classes of more than `many` rows, LARGE at most, are broadcast
    members, result = signed.select(id_of().alias("doc_id"), "set_key"), ["doc_id", "copy_of", "class_id", "n_links"]
    many = max(1000, signed.count() // LARGE)
    large = F.broadcast(classes.where(F.col("copies") > many).drop("copies"))
    rest = members.join(large.select("set_key"), "set_key", "left_anti").join(classes.where(F.col("copies") <= many), "set_key")
    return members.join(large, "set_key").select(result).union(rest.select(result))
