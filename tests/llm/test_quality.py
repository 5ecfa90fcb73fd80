"""op10: counts in plain Python, estimates by the definition in numpy."""

import numpy as np
import pandas as pd
from helpers import words

from fieldquant.llm import quality as q
from fieldquant.llm.queries import op10_quality_outliers


def counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = {}
    for k in range(len(w) - 4):
        windows.setdefault(tuple(w[k : k + 5]), []).append(k)
    hit = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


def failed(c):
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def brute(rows):
    """(doc_id, 5 counts, base_failed, kept) of (doc_id, text, lang, source)."""
    every = [counts(t) for _, t, _, _ in rows]
    grid = []
    for n, chars, sym, dup, rep, lines in every:
        x = (np.log((chars + 120) / (n + 20)), np.sqrt(sym / (n + 20)), dup / (lines + 5), rep / (n + 20))
        grid.append([int(np.rint(v * q.GRID)) for v in x])
    good = [k for k, c in enumerate(every) if not failed(c)]
    size, by_lang = {}, {}
    for k in good:
        size[rows[k][2:]] = size.get(rows[k][2:], 0) + 1
    for (lang, _), n in size.items():
        by_lang[lang] = by_lang.get(lang, 0) + (n if n < q.LEAST else 0)
    rest = sum(n for (lang, _), n in size.items() if n < q.LEAST and by_lang[lang] < q.LEAST)

    def group(r):
        if r[2:] not in size:
            return None
        if size[r[2:]] >= q.LEAST:
            return r[2:]
        if by_lang[r[2]] >= q.LEAST:
            return (r[2],)
        return "rest" if rest >= q.LEAST else "whole"

    bins = lambda d: np.floor(np.log1p(np.minimum(d, 1e9)) * 128).astype(int)
    floor = np.diag(np.square(q.FLOOR))
    distance = {}
    for g in {group(r) for r in rows} - {None}:
        x = np.array([grid[k] for k in good if g == "whole" or group(rows[k]) == g], float)
        m = np.median(x, axis=0)
        d = np.median(np.abs(x - m), axis=0)
        m, a = m / q.GRID, np.diag(1 / ((d * 1.4826 / q.GRID) ** 2 + np.square(q.FLOOR)))
        far = lambda y, m, a: np.maximum(np.einsum("ni,ij,nj->n", y / q.GRID - m, a, y / q.GRID - m), 0)
        for _ in range(q.STEPS):
            b = bins(far(x, m, a))
            near = x[b <= np.ceil(np.quantile(b, q.SHARE))]
            m = near.mean(axis=0)
            cov = near.T @ near / len(near) - np.outer(m, m)
            m, a = m / q.GRID, np.linalg.inv(cov / q.GRID**2 + floor)
        a = a / max(1.0, np.expm1((np.median(bins(far(x, m, a))) + 1) / 128) / q.MEDIAN) * (q.CUTOFF / q.cutoff(len(x)))
        for k, r in enumerate(rows):
            if group(r) == g:
                distance[k] = far(np.array([grid[k]], float), m, a)[0]
    return [(r[0], *c[:5], failed(c), not failed(c) and distance.get(k, 0.0) <= q.CUTOFF) for k, (r, c) in enumerate(zip(rows, every))]


def same(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:6])
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(brute(rows), key=key)


def test_query(spark, sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    same(op10_quality_outliers(spark, sf).collect(), list(zip(d.doc_id.tolist(), d.text.tolist(), d.lang.tolist(), d.source.tolist())))


def test_groups_of_every_kind(spark):
    """A large source, small ones pooled by language, and small languages pooled together."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(900):
        n = int(rng.integers(12, 80))
        w = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) for _ in range(n)]
        t = " ".join(w)
        if k % 37 == 0:
            t = t.replace("a", "#$ ")
        if k % 41 == 0:
            t = "\n".join([t[:40]] * 4 + [t])
        lang, source = ("en", "big") if k < 400 else ("en", f"s{k % 9}") if k < 700 else (f"l{k % 5}" if k % 7 else None, "tiny" if k % 3 else None)
        rows.append((k, t, lang, source))
    got = q.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)).collect()
    same(got, rows)
    assert 0 < sum(not r.kept and not r.base_failed for r in got) < 100


def test_cutoffs_hold_their_level():
    """Squared distances of new points from estimates of normal samples, by simulation at a rarity that can be counted."""
    rng = np.random.default_rng(3)
    assert q.cutoff(5) == float("inf") and abs(q.cutoff(10**6) - q.CUTOFF) < 0.1
    assert all(q.cutoff(n) >= q.cutoff(n + 1) for n in range(20, 3000))
    for m in (15, 40):
        far = 0
        for _ in range(4000):
            x, y = rng.normal(size=(m, 4)), rng.normal(size=(50, 4))
            z = y - x.mean(axis=0)
            far += (np.einsum("ni,ij,nj->n", z, np.linalg.inv(np.cov(x, rowvar=False)), z) > q.cutoff(m / q.SHARE)).sum()
        assert far <= 8  # of 200,000, about 0.2 expected


def test_few_documents_still_get_a_verdict(spark):
    """Languages of three documents each are judged by the whole corpus, junk among them is rejected."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) for _ in range(40)), f"l{k // 300}", "s") for k in range(300)]
    rows += [(900, "#$%&|<>* " * 40 + "ab cd ef", "rare", "s"), (901, "#$%&|<>* " + rows[0][1], "rare", "t"), (902, rows[1][1], None, None)]
    got = {r.doc_id: r.kept for r in q.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    same(q.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect(), rows)
    assert not got[900] and got[902]


def test_awkward_rows(awkward_docs, awkward_rows, no_docs):
    same(q.verdicts(awkward_docs).collect(), [r[:4] for r in awkward_rows])
    assert q.verdicts(no_docs).collect() == []


def test_accepted_keeps_columns(awkward_docs, awkward_rows, no_docs):
    out = q.accepted(awkward_docs)
    assert out.dtypes == awkward_docs.dtypes
    want = sorted((r[0] is None, r[0] or 0) for r in brute([r[:4] for r in awkward_rows]) if r[7])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == want
    assert q.accepted(no_docs).collect() == []


def test_junk_is_rejected_and_prose_kept(spark):
    sf = "/root/testdata/sf0.01"
    d = pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id"])
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    got = pd.DataFrame([(r.doc_id, r.kept) for r in op10_quality_outliers(spark, sf).collect()], columns=["doc_id", "kept"]).merge(labels, on="doc_id")
    assert len(d) == 1000 and got.kept[got.quality == 1].mean() > 0.95 and got.kept[got.quality == 0].mean() < 0.1
