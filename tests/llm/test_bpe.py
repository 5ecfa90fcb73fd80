"""op7 and op9 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldquant.llm import bpe, tokenfile
from fieldquant.llm.bpe import Codec
from fieldquant.llm.common import Scratch
from fieldquant.llm.queries import op7_bpe_round_trip, op9_token_file, tokenizer_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return Codec(f.read())


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute7(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


def brute9(library, rows):
    out, at = [], 0
    for i, ids in sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes())):
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


def table(sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    return list(zip(d.doc_id.tolist(), d.text.tolist()))


def test_round_trip_query(spark, sf, library):
    assert sorted((tuple(r) for r in op7_bpe_round_trip(spark, sf).collect()), key=repr) == brute7(library, table(sf))


def test_token_file_query(spark, sf, library):
    assert sorted((tuple(r) for r in op9_token_file(spark, sf).collect()), key=repr) == brute9(library, table(sf))


def test_awkward_rows(awkward_docs, awkward_rows, no_docs, library, spark):
    rows = [r[:2] for r in awkward_rows]
    assert sorted((tuple(r) for r in bpe.round_trip(awkward_docs, tokenizer_path()).collect()), key=repr) == brute7(library, rows)
    f = tokenfile.write(awkward_docs, tokenizer_path(), Scratch(spark, "test"))
    assert sorted((tuple(r) for r in f.digest().collect()), key=repr) == brute9(library, rows)
    whole = {(r.doc_id, r.start): np.frombuffer(r.ids, "<u4").tolist() for r in f.read().collect()}
    assert {(i, s): (n, c) for i, s, n, c in brute9(library, rows)} == {k: (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in whole.items()}
    assert bpe.round_trip(no_docs, tokenizer_path()).collect() == []
    assert tokenfile.write(no_docs, tokenizer_path(), Scratch(spark, "test")).digest().collect() == []


def test_a_token_file_at_a_path_of_ones_own(spark, awkward_docs, no_docs, tmp_path):
    f = tokenfile.write(awkward_docs, tokenizer_path(), Scratch(spark, "test"), to=f"{tmp_path}/tokens")
    g = tokenfile.open_file(spark, f"{tmp_path}/tokens")
    key = lambda r: r.start
    assert sorted(map(tuple, f.read().collect()), key=lambda r: r[1]) == sorted(map(tuple, g.read().collect()), key=lambda r: r[1])
    rows = sorted(g.read().collect(), key=key)
    assert (g.header["n_docs"], g.header["n_ids"]) == (len(rows), sum(r.n_tokens for r in rows)) and [len(r.ids) for r in rows] == [4 * r.n_tokens for r in rows]
    tokenfile.write(no_docs, tokenizer_path(), Scratch(spark, "test"), to=f"{tmp_path}/none")
    assert tokenfile.open_file(spark, f"{tmp_path}/none").digest().collect() == []
    spark.range(1).selectExpr("'other' as format").write.parquet(f"{tmp_path}/bad/header")
    with pytest.raises(ValueError):
        tokenfile.open_file(spark, f"{tmp_path}/bad")


def test_encode_and_decode_frames(spark, library):
    rows = [(1, "Hello there, world"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    e = bpe.encode(df, tokenizer_path())
    assert {r.doc_id: r.ids for r in e.collect()} == {i: library.encode(t or "").ids for i, t in rows}
    assert {r.doc_id: r.text for r in bpe.decode(e, tokenizer_path()).collect()} == {1: "Hello there, world", 2: "", 3: ""}


def ids_of(codec, texts):
    import pyarrow as pa

    ids, bounds = codec.encode_batch(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


pieces = st.sampled_from([" ", "  ", "\n", "\t", "'s", "'re", "'", "1", "23", "a", "The", "ing", "é", "中", "\U0001f600", "<|endoftext|>", "<|endof", "text|>", "#", "!!", " ", "　", "́", "ß", "²", "Ⅷ", "\x00", "\x85", " ", "zqx"])
texts = st.one_of(st.text(max_size=60), st.lists(pieces, max_size=25).map("".join))


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=4))
def test_any_text(codec, library, many):
    many = [t.encode("utf-8", "ignore").decode() for t in many]
    assert ids_of(codec, many) == [library.encode(t, add_special_tokens=False).ids for t in many]


def test_words_that_greed_gets_wrong_and_long_ones(codec, library):
    rnd = random.Random(3)
    many = ["".join(rnd.choice("aeiounrstlmdcp") for _ in range(rnd.choice([3, 8, 20, 39, 40, 41, 300]))) for _ in range(600)] + ["ab" * 20_000]
    assert ids_of(codec, many) == [library.encode(t, add_special_tokens=False).ids for t in many]


def test_decoding_of_arbitrary_ids(codec, library):
    rng = np.random.default_rng(2)
    for _ in range(50):
        ids = rng.integers(0, 50257, 12)
        raw = bytes(codec.decode_batch(ids)[0])
        assert bpe.valid_text(raw).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_variable_bytes(values):
    c, d = tokenfile.vbyte_encode(np.array(values, np.uint32))
    assert tokenfile.vbyte_decode(c, d, len(values)).tolist() == values and len(c) == -(-len(values) // 4)


def test_frequent_ids_take_one_byte_and_blocks_hold_whole_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 500)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    f = tokenfile.write(d, tokenizer_path(), Scratch(spark, "test"))
    b = f.blocks.collect()
    assert all(sum(r.lens) == r.n and len(r.lens) == len(r.doc_ids) for r in b) and len(b) > 20
    ids = [i for r in f.read().collect() for i in np.frombuffer(r.ids, "<u4").tolist()]
    n = pd.Series(ids).value_counts()
    rank = {r.id: r.rank for r in f.ranks.collect()}
    assert [n[i] for i in sorted(rank, key=rank.get)] == sorted(n.tolist(), reverse=True)
    assert sum(len(r.data) for r in b) == sum(1 + (rank[i] > 255) for i in ids)


def test_words_that_fit_are_remembered_even_if_not_all_do(library, monkeypatch):
    with open(tokenizer_path(), encoding="utf-8") as f:
        codec = Codec(f.read())
    monkeypatch.setattr(Codec, "KNOWN", 30)
    asked, encode_words = [], codec.encode_words
    monkeypatch.setattr(codec, "encode_words", lambda data, offsets: asked.append(len(offsets) - 1) or encode_words(data, offsets))
    many = [f" word{chr(97 + k)}{chr(97 + j)}" for k in range(5) for j in range(8)] + [" " + "long" * 20]
    for _ in range(3):
        assert ids_of(codec, many) == [library.encode(t, add_special_tokens=False).ids for t in many]
    assert asked == [41, 11, 11]


def test_words_that_differ_in_little_are_told_apart(codec, library):
    many = [" " + x for n in (6, 7, 8, 14, 15, 16, 21, 22, 23, 24, 40) for x in ("a" * n, "a" * (n - 1) + "b", "b" + "a" * (n - 1), "é" * (n // 2))]
    many += ["\x00" * n for n in range(1, 26)]
    for _ in range(2):  # new, then known
        assert ids_of(codec, many) == [library.encode(t, add_special_tokens=False).ids for t in many]
    assert ids_of(codec, many[::-1]) == [library.encode(t, add_special_tokens=False).ids for t in many[::-1]]


def test_fixed_maps():
    rng = np.random.default_rng(5)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 60, 3000), np.arange(3000) << 32, np.arange(300)]))
    m = bpe._Map(keys, np.arange(len(keys)))
    ask = np.concatenate([keys, keys + 1, [-1, 7 << 40]])[: 2 * len(keys)].reshape(2, -1)
    want = {int(k): v for v, k in enumerate(keys)}
    assert m.get(ask, -5).tolist() == [[want.get(int(k), -5) for k in row] for row in ask]
    assert m.get(np.array([-1, -2]), -5).tolist() == [-5, -5] and m.get(np.zeros((3, 0), np.int64), -5).shape == (3, 0)
