"""From raw documents to packed training sequences, one operator at each stage.

Each stage takes all that the one before kept, as rows with the columns of
``documents``, and is written and read again in between. The last returns the
pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scopeledger.llm import exact, mixing, packing, quality, simhash, similar
from scopeledger.llm.common import stage
from scopeledger.llm.queries import ALPHA, CAP_EPOCHS, DELTA, SEQUENCE_TOKENS, WEIGHTS, table, tokenizer_paths


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoffs leave."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), alpha=ALPHA, delta=DELTA)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    SimHash links fingerprints within two bits, which pivot tables and equal
    blocks find; most copies alike at 0.8 lie further apart, and five-word
    shingles link those as well.
    """
    return similar.drop_similar(docs, known=simhash.near_rows(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their targets."""
    return mixing.mix(docs, WEIGHTS, CAP_EPOCHS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places."""
    return packing.pack(docs, tokenizer_paths(), limit=SEQUENCE_TOKENS)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither fingerprints nor the tokenizer; tests compare its operators with brute-force versions, one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{i}")
    return docs
