"""The registered queries of this subpackage: operator N on its whole table with production parameters."""

from __future__ import annotations

import os

from . import bpe, chat, embed_dedup, licenses, minhash, mixing, pst, quality, sharding, tokenfile
from .common import Scratch, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.path.realpath(public_tokenizers.path(name))


def op1_suffix_tree_scores(spark, sf_dir):
    return pst.score(table(spark, sf_dir, "documents"))


def op2_spherical_kmeans_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_chat_snapshots(spark, sf_dir):
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op4_entropy_balanced_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_packed_shards(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"), 8)


def op6_minhash_near_dups(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, bands=24, rows=6)


def op7_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_license_rules(spark, sf_dir):
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op9_token_file(spark, sf_dir):
    return tokenfile.write(table(spark, sf_dir, "documents"), tokenizer_path(), Scratch(spark, "tokenfile")).digest()


def op10_quality_outliers(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql():
    return {"op3_chat_snapshots": chat.ORACLE, "op8_license_rules": licenses.oracle()}
