"""op6 against all pairs of full sets."""

import random

import pandas as pd
import pytest
from conftest import prose
from helpers import lower, words

from fieldquant.llm import minhash
from fieldquant.llm.common import Scratch
from fieldquant.llm.components import connected
from fieldquant.llm.queries import op6_minhash_near_dups


def shingles(text, k):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    """(doc_id, size, component, kept) of each row; rows of one doc_id are one document; without an id: through the text."""
    sets = [shingles(t, k) for _, t in rows]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    full = [(i, s) for (i, _), s in zip(rows, sets) if s and i is not None]
    for n, (i, s) in enumerate(full):
        for j, t in full[:n]:
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    by_set = {}
    for i, s in full:
        by_set[s] = min(root(i), by_set.get(s, root(i)))
    out = []
    for (i, _), s in zip(rows, sets):
        c = i if not s else root(i) if i is not None else by_set.get(s)
        out.append((i, len(s), c, i == c))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def same(df, rows, k, percent):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=key) == sorted(brute(rows, k, percent), key=key)
    return got


def edited(rnd, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, groups, size):
    """Chains of near copies around the threshold, exact copies, and texts that share a passage."""
    rnd = random.Random(seed)
    rows, passage = [], prose(rnd, 40)
    for _ in range(groups):
        t = prose(rnd, rnd.randrange(60, 200))
        for _ in range(size):
            rows.append(t if rnd.random() < 0.2 else (t := edited(rnd, t, rnd.choice([0, 1, 2, 3, 8]))))
    rows += [prose(rnd, 60) + " " + passage for _ in range(20)] + ["a", "A", "a b", "a  B", "a b c", "A B C d"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_query(spark, sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    got = same(op6_minhash_near_dups(spark, sf), list(zip(d.doc_id.tolist(), d.text.tolist())), 3, 85)
    assert any(not r[3] for r in got)


@pytest.mark.parametrize("seed,k,percent,shape", [(1, 3, 85, {}), (2, 5, 80, {"bands": 32, "rows": 5})])
def test_chains(spark, seed, k, percent, shape):
    rows = corpus(seed, 12, 9)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    same(minhash.near_duplicates(df, k, percent, **shape), rows, k, percent)


def test_one_group_of_near_copies_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = corpus(3, 1, 160)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    same(minhash.near_duplicates(df, 3, 85), rows, 3, 85)


def test_awkward_rows(awkward_docs, awkward_rows, no_docs):
    same(minhash.near_duplicates(awkward_docs, 3, 85), [r[:2] for r in awkward_rows], 3, 85)
    assert minhash.near_duplicates(no_docs).collect() == []


def test_representatives_keep_columns(awkward_docs, awkward_rows):
    out = minhash.representatives(awkward_docs)
    assert out.columns == awkward_docs.columns
    want = sorted((r[0] is None, r[0] or 0) for r in brute([r[:2] for r in awkward_rows], 5, 80) if r[3])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == want


def test_components(spark):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(200)] + [(1000, x) for x in range(1001, 1300)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (None, 3), (7, None), (1, 0), (1, 0)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in connected(df, Scratch(spark, "test"), "a", "b").collect()}
    assert got == {x: root(x) for x in up}
    assert connected(df.filter("a = 5 and b = 5"), Scratch(spark, "test"), "a", "b").collect() == []


def test_defaults_go_together():
    """A pair at the default threshold is missed with a probability below 1e-5."""
    import inspect

    for f in (minhash.near_duplicates, minhash.representatives):
        d = {k: p.default for k, p in inspect.signature(f).parameters.items()}
        assert (1 - (d["percent"] / 100) ** d["rows"]) ** d["bands"] < 1e-5
