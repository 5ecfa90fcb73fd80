"""The corpus pipeline: quality rules, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the docs of the next one.  All but the last return the
columns of ``documents``; the last returns doc_id, n_tokens, ids_sha256 and
decoded_sha256 of every row of the mix (documents that are taken k times have k
rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldquant.llm import bpe, minhash, mixing, quality
from fieldquant.llm.common import Scratch, table
from fieldquant.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or lies far outside its language and source."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group (five-word shingles, similarity 0.8)."""
    return minhash.representatives(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their shares of the words."""
    return mixing.mixed(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]
#: The estimates, bands and Newton steps have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        new = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        docs = before = new
    return STAGES[-1][1](spark, docs, sf_dir)
