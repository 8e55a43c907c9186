"""Trie of conversations: how often each sequence of first turns occurs, without holding a conversation in one row.

Identical conversations are collapsed into one weighted sequence with the list of those that end there. A sequence that
is no proper prefix of another one (anti-join) is a leaf. The prefixes of the sequences, one row each, are then
aggregated by weight into nodes.

A prefix is known by its depth and 120 bits that are folded from hashes of its (place, role, text). Folding is exclusive
or, so long conversations are cut into chunks of the row order, folded apart and carried on by one row for each chunk:
the largest task holds one chunk, not one conversation. Joins on a common prefix are left to adaptive skew joins, sums
over it are combined before they are shuffled.

Sums below a node need no walk: a sequence that starts with the node brings its weight times the words from there to its
end, less each distinct node once, which is brought by the sequence that holds the node's smallest member.

Null roles and texts are empty ones. Rows without `conv_id` belong to no conversation and make no node. Turns with equal
numbers come by role, then text; a null number comes first. Repeated rows are turns of their own. An empty table has no
node, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotatlas.llm.common import SPACES, SPACES_RE, materialize, shuffle_partitions

NODE = ["depth", "a", "b"]
#: Neighbouring ids whose decimals travel as one text on the way to their digest.
IDS_TOGETHER = 1 << 14


def n_words(text: Column) -> Column:
    """Words between white space."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES_RE))).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with `place` (from 1) in their conversation and the `chunk` of the row order they lie in; written once.

    Rows are dealt by ranges of the order, which splits a long conversation; a chunk is one such range.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).withColumn("chunk", F.spark_partition_id())
    ranged = materialize(ranged, "turns")
    inner = Window.partitionBy("conv_id", "chunk")
    local = ranged.withColumn("place", F.row_number().over(inner.orderBy("turn", "role", "text")).cast("long"))
    outer = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).select(
        "conv_id", "chunk", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    return local.join(before, ["conv_id", "chunk"]).withColumn("place", F.col("place") + F.col("before")).drop("before")


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns are taken from another one: `conv_id`, `chunk`, `place`, `role`, `text`.

    Conversation c starts with the first h turns (all, if fewer) of conversation c - c % `every`, and goes on with its
    own after its first h; h is the checksum of its decimal id modulo `most`. A conversation without turns is one row
    with place 0.
    """
    turns = materialize(numbered(conversations), "numbered")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("donor"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    donors = convs.where("conv_id = donor").select("donor", F.least("n", F.lit(most - 1)).alias("there"))
    convs = convs.join(donors, "donor", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("conv_id", "donor", "n", "h", "taken"), "conversations")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h").select(
        "conv_id", "chunk", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "role", "text")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("donor"), "place", "role", "text")
    heads = convs.select("conv_id", "donor", "taken").join(heads, "donor").where("place <= taken").select(
        "conv_id", F.lit(-1).alias("chunk"), "place", "role", "text")
    bare = convs.where("taken = 0 and n <= h").select("conv_id", F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("place"),
                                                      F.lit("").alias("role"), F.lit("").alias("text"))
    return own.unionByName(heads).unionByName(bare)


def folded(turns: DataFrame) -> DataFrame:
    """For each conversation and place (0 included): the prefix up to there (`a`, `b`), the one before (`up_a`, `up_b`),
    `words` of the last turn and `before`, the words of all turns ahead of it."""
    mark = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    half = lambda k: F.when(F.col("place") > 0, F.conv(F.substring("mark", k, 15), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    slim = turns.withColumn("mark", mark).select(
        "conv_id", "chunk", F.col("place").alias("depth"), half(1).alias("x"), half(16).alias("y"),
        F.when(F.col("place") > 0, n_words(F.col("text"))).otherwise(F.lit(0).cast("long")).alias("words"))
    slim = materialize(slim, "marks")
    inner = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = slim.groupBy("conv_id", "chunk").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("words").alias("w"))
    carry = sums.select("conv_id", "chunk", F.coalesce(F.bit_xor("x").over(outer), zero).alias("cx"),
                        F.coalesce(F.bit_xor("y").over(outer), zero).alias("cy"), F.coalesce(F.sum("w").over(outer), zero).alias("cw"))
    rows = slim.select("*", F.bit_xor("x").over(inner).alias("fx"), F.bit_xor("y").over(inner).alias("fy"), F.sum("words").over(inner).alias("fw"))
    rows = rows.join(carry, ["conv_id", "chunk"])
    a, b = F.col("fx").bitwiseXOR(F.col("cx")), F.col("fy").bitwiseXOR(F.col("cy"))
    return rows.select("conv_id", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"), b.bitwiseXOR(F.col("y")).alias("up_b"),
                       "words", (F.col("fw") + F.col("cw") - F.col("words")).alias("before"))


def digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each key (`ends_sha256`).

    Neighbouring ids become texts first, wherever they lie; one task then passes the texts of a key through the digest
    one after the other and holds one at a time.
    """
    block = F.floor(F.col("conv_id") / IDS_TOGETHER)
    texts = ends.groupBy(*key, block.alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = texts.select(*key, "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for *own, ids in zip(*(batch.column(k).to_pylist() for k in (*key, "ids"))):
                if own != now:
                    if digest:
                        out.append((*now, digest.hexdigest()))
                    now, digest = own, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield pa.record_batch([pa.array(x) for x in zip(*out)], names=[*key, "ends_sha256"])
                out = []
        if digest:
            yield pa.record_batch([pa.array([x]) for x in (*now, digest.hexdigest())], names=[*key, "ends_sha256"])

    schema = ", ".join(f"{k} long" for k in key) + ", ends_sha256 string"
    return texts.repartition(*key).sortWithinPartitions(*key, "block").select(*key, "ids").mapInArrow(run, schema)


def nodes(turns: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns, the textless root included.

    Takes `conv_id`, `chunk`, `place`, `role`, `text` as `rebuilt` gives them. Returns `conv_id` (smallest member),
    `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`.
    """
    rows = materialize(folded(turns), "prefixes")
    whole = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "a", "b", (F.col("before") + F.col("words")).alias("total")), "depth").alias("s")) \
        .select("conv_id", "s.*")
    whole = materialize(whole, "whole")
    sequences = whole.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("total").alias("total"))
    sequences = materialize(sequences, "sequences")
    # the prefixes of the sequences, with the root as a prefix of each
    zero = F.lit(0).cast("long")
    prefixes = rows.where("depth > 0").join(sequences.select("conv_id"), "conv_id", "left_semi")
    prefixes = prefixes.unionByName(sequences.select("conv_id", *(zero.alias(c) for c in ("depth", "a", "b", "up_a", "up_b", "words", "before"))))
    prefixes = materialize(prefixes, "sequence_prefixes")
    held = prefixes.join(sequences.select("conv_id", "weight", "total", F.col("depth").alias("length")), "conv_id")
    proper = held.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    # a sequence holds the smallest member of its nodes from some depth on
    first = prefixes.groupBy(*NODE).agg(F.min_by(F.struct("conv_id", "before"), "conv_id").alias("f")).select("f.conv_id", "depth", "f.before")
    first = first.groupBy("conv_id").agg(F.min_by(F.struct(F.col("depth").alias("own_depth"), F.col("before").alias("own_before")), "depth").alias("o")) \
        .select("conv_id", "o.*")
    held = held.join(leaves, "conv_id", "left").join(first, "conv_id", "left")
    once = F.when(F.col("own_depth").isNull(), 0).otherwise(
        F.col("total") - F.when(F.col("depth") >= F.col("own_depth"), F.col("before")).otherwise(F.col("own_before")))
    found = held.groupBy(*NODE, "up_a", "up_b").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.coalesce(F.sum("leaf"), zero).alias("n_leaves"),
        (F.sum(F.col("weight") * (F.col("total") - F.col("before"))) - F.sum(once)).alias("saved_tokens"))
    found = materialize(found, "nodes")
    up = found.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    children = up.groupBy(*NODE).agg(F.count("*").alias("n_children"))
    parents = found.join(children, NODE).select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
                                                F.col("conv_id").alias("parent_conv_id"))
    out = found.join(children, NODE, "left").join(digests(whole.select(*NODE, "conv_id"), NODE), NODE, "left")
    out = out.join(parents, ["depth", "up_a", "up_b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
