"""Registered queries of the operators in this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotatlas.llm import bpe, licenses, lm, ngram_join, packing, pieces, quality, secrets, sharding, spelling, spotsigs, trie, warc
from slotatlas.llm.common import materialize, table
from slotatlas.session import run_dir

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn
    return wrap


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, VOCAB, decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return judged.select("doc_id", *quality.STATISTICS, "base_failed", "kept", "rule")


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=5, threshold=0.8, recall=0.9999)


@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), order=2, held_out=True)


@query("op5_spot_signatures")
def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare(table(spark, sf_dir, "documents"))


@query("op6_slot_sharding")
def op6_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialize(sharding.measured(table(spark, sf_dir, "documents")), "measured")
    size, rows = sharding.slot_totals(records)
    store = sharding.SlotMap(spark, run_dir(spark, "slot_map"))
    first = store.store(sharding.even_map(16), size)
    version = store.store(sharding.rebalance(store.load(first), size, 16), size)
    placed = sharding.place(records, store.load(version), rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(spark, run_dir(spark, "ledger"))
    scanned = secrets.scan(table(spark, sf_dir, "documents"), ledger, carry=["doc_id"])
    base = F.filter("spans", lambda s: s["number"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *(count(rule.kind) for rule in secrets.BASE),
                          F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


@query("op8_best_fit")
def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, VOCAB, RANKS, capacity=1024, end_id=2)


@query("op9_warc")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"), run_dir(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                        "url_key", "captured_at", "archive", "record_offset", "record_length")


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialize(spelling.counted(table(spark, sf_dir, "documents"), shortest=6, least=5), "words")
    return spelling.variants(words, factor=5)


@query("op12_sentencepiece")
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.encode(docs, PIECES, end=True, spans="spans", spelled="spelled", decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("spelled", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
                       F.sha2("spans", 256).alias("spans_sha256"))


@query("op13_conversation_trie")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(table(spark, sf_dir, "conversations")))
