"""Secret scans over an incremental ledger of blobs. Built-in functions only.

Every version of a text is addressed by its content (SHA-256). The ledger keeps, under a path, which blobs a version of
the rules has seen and what it found there; a scan looks at unseen pairs of blob and rule version only, adds them, and
joins the findings back to every row that holds the blob. Texts for which no rule's gate opens hold nothing: they are
marked as seen, but neither they nor their rows are shuffled. Findings are written before the blobs are marked as seen, so
a job that dies in between scans those blobs again, and reading takes equal findings once.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MASK = "[secret]"
#: Parts into which rows that share a blob are dealt when findings return to them.
PARTS = 16


class Rule(NamedTuple):
    """A pattern, without look-around if it has a least length; `gate` is a cheap pattern that every text with a match contains."""

    kind: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 0


#: Kinds, patterns and least lengths of the base rules.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"(?i:passw|secret|token|api_?key)", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", least=18),
    Rule("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),  # the runs of sixteen and more
]
#: Further kinds of this operator.
FURTHER = [
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", r"gh[oprsu]_"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", r"xox[abeoprs]-"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", r"AIza"),
    # from the head of a run of its characters, each run read once
    Rule("jwt", r"eyJ(?<![A-Za-z0-9_-]eyJ)[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    # from the start of a run of scheme characters, so that a long run is read once
    Rule("url", r"(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]*+://[A-Za-z0-9._~%+-]++:[A-Za-z0-9._~%!$&*+-]{3,}+@", r"://[A-Za-z0-9._~%+-]++:"),
]
RULES = BASE + FURTHER
RULES_VERSION = 4
FOUND = "version int, blob string, number int, kind string, start long, end long"
SEEN = "version int, blob string"


def suspect(text: Column, rules: list[Rule]) -> Column:
    """Whether any gate opens. A text without holds nothing, and needs to travel nowhere."""
    return reduce(lambda a, b: a | b, [text.rlike(rule.gate) for rule in rules])


def find(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, number, kind, start, end) of all matches in (blob, text): leftmost, not overlapping within a kind.

    Places count code points from 0, ends are exclusive. They are running sums over what stands between the matches.
    """
    kinds = []
    for number, rule in enumerate(rules):
        gated = F.col("text").rlike(rule.gate)
        kinds.append(F.struct(F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"),
                              F.when(gated, F.split("text", rule.pattern, -1)).alias("between"),
                              F.when(gated, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).alias("found")))
    hit = blobs.select("blob", F.explode(F.filter(F.array(*kinds), lambda k: F.size(k["found"]) > 0)).alias("k"))
    each = hit.select("blob", "k.number", "k.kind", F.posexplode(F.arrays_zip("k.between", "k.found")).alias("at", "m")).select(
        "blob", "number", "kind", "at", F.col("m.found").alias("found"), F.char_length("m.between").alias("gap"))
    each = each.where(F.col("found").isNotNull())  # after the last match
    before = Window.partitionBy("blob", "number").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("found")
    passes = F.lit(True)
    for number, rule in enumerate(rules):
        if rule.least:
            taken = F.char_length(F.regexp_extract("found", rule.pattern, rule.group)) >= rule.least
            passes = F.when(F.col("number") == number, taken).otherwise(passes)
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(before).cast("long"))
    return placed.where(passes).select("blob", "number", "kind", (F.col("end") - size).cast("long").alias("start"), "end")


class Ledger:
    """Findings and seen blobs below a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, rules: list[Rule] = RULES, version: int = RULES_VERSION):
        self.spark, self.path, self.rules, self.version = spark, path.rstrip("/"), rules, version
        for name, schema in (("found", FOUND), ("seen", SEEN)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        schema = {"found": FOUND, "seen": SEEN}[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("version") == self.version).drop("version").distinct()

    def update(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Scan the blobs of `df` that this version of the rules has not seen: one text for each, if a gate opens for it."""
        held = df.select(F.col(f"`{doc_id}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        held = held.withColumn("blob", blob_of("text"))
        unseen = held.groupBy("blob").agg(F.min("doc").alias("doc")).join(self.read("seen"), "blob", "left_anti")
        chosen = unseen.select(F.col("blob").alias("of"), F.col("doc").alias("holder"))
        texts = held.where(suspect(F.col("text"), self.rules)).join(chosen, (F.col("blob") == F.col("of")) & F.col("doc").eqNullSafe(F.col("holder")), "left_semi")
        new = find(texts.select("blob", "text"), self.rules).distinct()
        stamp = F.lit(self.version).cast("int").alias("version")
        new.select(stamp, "blob", "number", "kind", "start", "end").write.mode("append").parquet(f"{self.path}/found")
        unseen.select(stamp, "blob").write.mode("append").parquet(f"{self.path}/seen")

    def findings(self) -> DataFrame:
        """One row for each blob with findings: `spans`, sorted by start, then kind as listed.

        `covered` of a span is the largest end before it.
        """
        order = Window.partitionBy("blob").orderBy("start", "number", "end").rowsBetween(Window.unboundedPreceding, -1)
        spans = self.read("found").withColumn("covered", F.coalesce(F.max("end").over(order), F.lit(0)))
        span = F.struct("start", "number", "end", "kind", "covered")
        return spans.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def blob_of(text: str) -> Column:
    return F.sha2(F.col(f"`{text}`"), 256)


def scan(df: DataFrame, ledger: Ledger, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of `df` with the `spans` of its text: an array, empty where nothing is found.

    Null is the empty text. Repeated rows and copies of a text have equal results. `carry` are the columns to keep
    (default: all but one called `spans`).
    """
    ledger.update(df, doc_id, text)
    own = [c for c in (df.columns if carry is None else carry) if c.lower() not in ("spans", "__blob", "__part", "__suspect")]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(*(F.col(f"`{c}`") for c in own), F.sha2(whole, 256).alias("__blob"), suspect(whole, ledger.rules).alias("__suspect"),
                     F.pmod(F.xxhash64(f"`{doc_id}`"), F.lit(PARTS)).alias("__part"))
    found = ledger.findings().select(F.col("blob").alias("__blob"), "spans", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint,kind:string,covered:bigint>>")
    carried = [F.col(f"`{c}`") for c in own]
    held = rows.where("__suspect").join(found, ["__blob", "__part"], "left").select(*carried, F.coalesce("spans", none).alias("spans"))
    return held.unionByName(rows.where("NOT __suspect").select(*carried, none.alias("spans")))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mask in place of each stretch that spans cover."""
    def piece(s: Column) -> Column:
        gap = F.call_function("substring", text, (s["covered"] + 1).cast("int"), F.greatest(s["start"] - s["covered"], F.lit(0)).cast("int"))
        return F.concat(gap, F.when((s["start"] >= s["covered"]), F.lit(MASK)).otherwise(F.lit("")))

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    rest = F.call_function("substring", text, (last + 1).cast("int"), F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, piece), ""), rest)).otherwise(text)
