"""Spot signatures: chains of content words after common-word anchors. Built-in functions only.

A signature is an anchor with the next two content words behind it. A text's fingerprint is the sorted set of its
hashed signatures; likeness is the Jaccard similarity of two sets. To match a whole table, sets are partitioned by
length (sets of lengths too far apart cannot reach the threshold) and only meet where the prefixes that must overlap do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotatlas.llm.common import let, materialize, shuffle_partitions

#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine er es für im ist mit nicht sich sie und von zu "
    "au aux ce dans de du elle en est et il la le les ne par pas pour que qui se sur un une "
    "con del el las los no para su una y").split()
#: Texts with fewer spot signatures are described by all runs of three words too.
LEAST_SPOTS = 4


def _any_of(words: list[str]) -> str:
    """Alternatives grouped by first letter, so that most words fail after one look."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        tails.setdefault(w[0], []).append(w[1:])
    return f"(?=[{''.join(sorted(tails))}])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(tails.items())) + ")"


#: Stands before each anchor once a text is prepared.
_MARK = "\x01"
_ANCHOR = f"(?<= )(?={_any_of(ANCHORS)} )"
_STOP, _CONTENT = f"{_MARK}[^ ]+ ", f"[^ {_MARK}][^ ]* "
#: All of a run of anchors, with the next two content words where there are as many. A match takes the whole run and the
#: search goes on behind it, so no anchor is looked at more than a few times, however many stand in a row.
_ANCHORS = f"(?:{_STOP})++"
_SPOT = f"(?=({_ANCHORS}(?:{_CONTENT}(?:{_STOP})*+{_CONTENT})?+)){_ANCHORS}"
_RUN = "(?<= )(?=([^ ]+ [^ ]+ [^ ]+ ))"


def _chains(run: Column) -> Column:
    """`n` anchors of a run and `chains`, the hashes of its distinct anchors, each with the two content words; 0 and none without."""
    def of(content: Column) -> Column:
        anchors = F.split(F.rtrim(F.regexp_extract(run, f"^{_ANCHORS}", 0)), " ")
        hashed = let(anchors, lambda a: F.struct(F.size(a).alias("n"), F.transform(
            F.array_distinct(a), lambda x: F.xxhash64(F.concat(x, F.lit(" "), content))).alias("chains")))
        return F.when(content != "", hashed).otherwise(F.struct(F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("chains")))

    return let(F.regexp_replace(run, _STOP, ""), of)


def signatures(text: Column) -> Column:
    """Sorted set of hashed signatures. Never empty: a text with fewer than three words stands for itself.

    Words are ASCII letters and digits and all that is beyond ASCII, in lower case.
    """
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[\\x00-/:-`{-\\x7f]+", " ")), F.lit(" "))
    marked = F.regexp_replace(words, _ANCHOR, _MARK)
    spots = F.transform(F.regexp_extract_all(marked, F.lit(_SPOT), F.lit(1)), _chains)
    runs = F.transform(F.regexp_extract_all(words, F.lit(_RUN), F.lit(1)), lambda x: F.xxhash64(x, F.lit(3)))

    def chosen(s: Column) -> Column:
        chains, n = F.flatten(s["chains"]), F.aggregate(s["n"], F.lit(0), lambda a, x: a + x)
        return F.when(n >= LEAST_SPOTS, F.array_sort(F.array_distinct(chains))).otherwise(
            let(F.concat(chains, runs), lambda few: F.array_sort(F.array_distinct(
                F.when(F.size(few) > 0, few).otherwise(F.array(F.xxhash64(text, F.lit(1))))))))

    return let(spots, chosen)


def fingerprint(sigs: Column) -> Column:
    """The set as text: 16 hexadecimal digits for each signature."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    return let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))


def next_to(df: DataFrame) -> DataFrame:
    """Add `next`: the struct of the other columns of the row after, by `doc_id`; after the last comes the first.

    Rows are cut into chunks by quantiles of the id, so no task sees more than its chunk. The first row of each chunk is
    also appended to the chunk before. Rows with equal ids follow each other by text.
    """
    spark = df.sparkSession
    parts = 4 * shuffle_partitions(spark)
    cuts = df.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or []
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts)))).cast("array<bigint>")
    chunk = F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))), F.lit(-1))
    rows = df.withColumn("chunk", chunk)
    firsts = sorted(map(tuple, rows.groupBy("chunk").agg(F.min("doc_id")).collect()))  # a row for each chunk
    into = [(doc, firsts[k - 1][0]) for k, (_, doc) in enumerate(firsts)]
    link = spark.createDataFrame(into, "first_id long, into int")
    heads = df.join(F.broadcast(link), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("into").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("into").alias("chunk"), F.lit(True).alias("head"))
    return rows.withColumn("head", F.lit(False)).unionByName(heads)


def compare(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and the likeness to the next document.

    The edited text has the last half of the code points replaced by as many of the next document's first ones (or all
    it has). Null is the empty text. A single document is its own next one; repeated rows follow each other.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    signed = next_to(docs).withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("chunk").orderBy("head", "doc_id", "text")
    rows = signed.withColumn("next", F.lead(F.struct("text", "sigs")).over(order)).where(~F.col("head"))
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.call_function("substring", F.col("text"), F.lit(1), size - half),
                      F.call_function("substring", F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), "sigs", F.col("next.sigs").alias("next_sigs"), edited.alias("edited"))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                       likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                       likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def matches(df: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (`doc_id, rep`) and pairs (`a, b, likeness`) of representatives whose sets reach the threshold.

    Rows with equal sets share a representative, the smallest id. Sets are partitioned by length so that partners are
    in the same or in neighbouring partitions; two meet if they share one of the signatures that are smallest in the
    order of a hash (the prefix that any two sets of that likeness must share), and lengths prune again before sets are
    compared.
    """
    step = math.log(1 / threshold)
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), signatures(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("sigs"))
    docs = materialize(docs.withColumn("set_key", F.sha2(fingerprint(F.col("sigs")), 256)), "spots")
    reps = docs.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    members = docs.select("doc_id", "set_key").join(reps, "set_key").select("doc_id", "rep")
    sets = docs.join(reps, "set_key").where(F.col("doc_id") == F.col("rep")).dropDuplicates(["set_key"]).select("rep", "sigs")
    sets = sets.withColumn("size", F.size("sigs")).withColumn("part", F.floor(F.log(F.col("size")) / step).cast("int"))
    prefix = F.slice("sigs", 1, F.col("size") - F.ceil(F.lit(threshold - 1e-9) * F.col("size")).cast("int") + 1)
    index = sets.select("part", "rep", "size", F.explode(prefix).alias("sig"))
    probe = index.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    a, b = index.alias("a"), probe.alias("b")
    near = (F.least("a.size", "b.size") >= F.lit(threshold - 1e-9) * F.greatest("a.size", "b.size")) & (F.col("a.rep") != F.col("b.rep"))
    meet = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.sig") == F.col("b.sig")) & near)
    meet = meet.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()
    left, right = (sets.select(F.col("rep").alias(c), F.col("sigs").alias(f"{c}_sigs")) for c in ("a", "b"))
    pairs = meet.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("a_sigs"), F.col("b_sigs")).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= threshold)
