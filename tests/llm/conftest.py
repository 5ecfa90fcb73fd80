"""Small tables with what corpora hold at their worst."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

VOCAB = [f"w{k}" for k in range(300)]


def prose(rnd, n, vocab=VOCAB):
    return " ".join(rnd.choice(vocab) + rnd.choice(["", "", "", ".", ","]) for _ in range(n))


def awkward():
    """(doc_id, text, lang, source, n_chars) rows: nulls everywhere, empty, blank, very long, repeated, odd characters."""
    rnd = random.Random(11)
    long = prose(rnd, 30_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", "en", None), (4, "One", None, "b"), (5, "Two words", "en", "b"),
        (6, long, "en", "a"), (7, long, "en", "a"), (8, long + " tail", None, None), (9, "x" * 70_000, "de", "b"), (10, " non breaking　blanks are letters here ", "fr", "c"),
        (11, "don't we'll <|endoftext|> stop\n\nstop  \t now 1234567 éè中文\U0001f600́", "fr", "c"), (12, "line\nline\n line\n\nline\n#$%&|<>* * *", "fr", "c"), (13, "a b c d e a b c d e f g a b c d e", "de", "z"),
        (14, "Straße ÀÉ İ K", "de", "\U0001f600"), (None, "a text without an id but with some words", "en", "a"), (None, None, None, None), (16, "\x00 nul \x1f unit \x85 nel", "en", "￿"),
    ]
    rows += [(20 + k, prose(rnd, rnd.randrange(20, 60)), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])) for k in range(60)]
    rows += [rows[20], rows[20], rows[0]]  # repeated rows
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = {"size": "'x'", "n": "7", "counts": "cast(null as binary)", "band": "1", "component_id": "2", "kept": "'no'", "copies": "0", "held": "true", "chunk": "3", "n_words": "-1", "shard": "'s'", "taken": "4", "cell": "5", "word": "'w'", "key": "null", "bucket": "6", "gk": "'g'", "m0": "1.5", "a00": "'a'", "d2": "9", "sk": "'k'", "__m_size": "3", "__q_kept": "false", "__kept_id": "1", "u0": "8"}


@pytest.fixture(scope="session")
def awkward_rows():
    return awkward()


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward_rows):
    """The rows, over several partitions, with further columns whose names clash with operators' own."""
    df = spark.createDataFrame(awkward_rows, SCHEMA).repartition(3)
    return df.selectExpr("*", *[f"{v} as {k}" for k, v in CLASH.items()])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
