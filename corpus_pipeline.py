"""The training-data pipeline: stages that each apply one operator to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotatlas.llm import ngram_join, packing, quality, secrets
from slotatlas.llm.common import materialize, table
from slotatlas.llm.queries import RANKS, VOCAB
from slotatlas.session import run_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    return quality.judge(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("kept").select(COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest id, if any has one."""
    return ngram_join.firsts(docs.select(COLUMNS), n=5, threshold=0.8, recall=0.9999)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; `n_chars` follows."""
    scanned = secrets.scan(docs.select(COLUMNS), secrets.Ledger(spark, run_dir(spark, "ledger")))
    masked = scanned.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences."""
    return packing.pack_documents(docs, VOCAB, RANKS, capacity=1024, end_id=2)


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", ngram_jaccard_join), ("secret_scan", secret_scan),
          ("best_fit_packing", best_fit_packing)]
#: SQL has neither the learned rules nor the tokenizer; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
