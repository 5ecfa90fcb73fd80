"""op4 against the mix's defining conditions, solved by bisection in Python."""

import math
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from helpers import near, words

from fieldquant.llm import mixing
from fieldquant.llm.queries import op4_entropy_balanced_mix


def brute_targets(total):
    """Water filling by repetition: whoever is above the cap is cut, the rest is shared by weight again."""
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in total)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    cut = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in cut)
        w = sum(weight[s] for s in names if s not in cut)
        out = {s: 3.0 * total[s] if s in cut else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in cut and out[s] > 3 * total[s]}
        if not over:
            return out
        cut |= over


def rates(sizes, target):
    """min(3, exp(l * size)) of the l that meets the target."""
    lo, hi = -200.0, 200.0
    mean = sum(sizes) / len(sizes)
    r = lambda lam: [min(3.0, math.exp(min(2.0, lam * s / mean))) for s in sizes]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(s * x for s, x in zip(sizes, r(mid))) < target else (lo, mid)
    return r(lo)


def check(got, rows):
    """rows: (doc_id, text, source)."""
    size = [len(words(t)) for _, t, _ in rows]
    total = defaultdict(int)
    for s, (_, _, src) in zip(size, rows):
        total[src] += s
    target = brute_targets(total)
    source = {i: src for i, _, src in rows}
    want = sorted(((i, s, total[src], round(target[src], 6)) for s, (i, _, src) in zip(size, rows)), key=repr)
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got), key=repr) == want
    taken = defaultdict(int)
    of = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        of[(r.doc_id, r.size)].append(r)
        if r.doc_id is not None:
            taken[source[r.doc_id]] += r.taken
    return taken, target, total


def test_query(spark, sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    rows = list(zip(d.doc_id.tolist(), d.text.tolist(), d.source.tolist()))
    got = op4_entropy_balanced_mix(spark, sf).collect()
    taken, target, _ = check(got, rows)
    least = defaultdict(lambda: 10**9)
    for _, t, s in rows:
        if words(t):
            least[s] = min(least[s], len(words(t)))
    assert all(abs(taken[s] - target[s]) <= max(least[s], 0.01 * target[s]) for s in target)
    assert Counter(map(tuple, got)) == Counter(map(tuple, op4_entropy_balanced_mix(spark, sf).collect()))


def test_copies_are_the_balanced_rates_rounded(spark):
    rnd = random.Random(8)
    rows = [(k, "w " * int(2 ** rnd.uniform(0, 9)), f"s{k % 4}") for k in range(1600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)).collect()
    taken, target, _ = check(got, rows)
    src = {i: s for i, _, s in rows}
    for s in target:
        mine = [r for r in got if src[r.doc_id] == s]
        off = [abs(r.copies - w) for r, w in zip(mine, rates([r.size for r in mine], target[s]))]
        assert abs(taken[s] - target[s]) <= 1 and sum(x < 1.001 for x in off) >= 0.98 * len(off)


def test_awkward_rows(awkward_docs, awkward_rows):
    got = mixing.mix(awkward_docs).collect()
    check(got, [(r[0], r[1], r[3]) for r in awkward_rows if r[0] is not None] + [(r[0], r[1], r[3]) for r in awkward_rows if r[0] is None])


def test_hot_source_and_ties(spark):
    rows = [(k, "same size here", "hot") for k in range(3000)] + [(5000 + k, "x " * (k % 5 + 1), f"s{k % 7}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    taken, target, total = check(mixing.mix(df).collect(), rows)
    assert all(abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]) for s in target)
    assert near(sum(target.values()), sum(total.values())) or sum(target.values()) <= sum(total.values())


def test_mixed_rows_keep_their_columns(awkward_docs):
    sizes = Counter()
    for r in mixing.mix(awkward_docs).collect():
        sizes[r.doc_id] += r.copies
    out = mixing.mixed(awkward_docs)
    assert out.columns == awkward_docs.columns and out.dtypes == awkward_docs.dtypes
    assert Counter(r.doc_id for r in out.collect()) == +sizes


def test_many_distinct_sizes_and_one_very_long_text(spark):
    """More sizes than any fold would hold, and a document of half its source."""
    rows = [(k, "w " * (k + 1), "a") for k in range(300)] + [(1000, "w " * 40_000, "a")] + [(2000 + k, "w " * (7 * k + 3), "b") for k in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)).collect()
    taken, target, _ = check(got, rows)
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)


def test_rounding_in_one_law(spark):
    """The same rounding for 6,000 distinct sizes of a source as for few: words end within half the smallest size."""
    rnd = random.Random(3)
    data = [("s", size, rnd.randrange(1, 9), 0, rnd.random()) for size in range(5, 6005)] + [("t", 9, 400, 2, 150.5), ("t", 1000, 1, 1, 0.25)]
    df = spark.createDataFrame([(k, z, n, b, n * w if k == "s" else w) for k, z, n, b, w in data], "sk string, size bigint, n bigint, base bigint, want double")
    got = {(r.sk, r.size): r for r in mixing.rounded(df).collect()}
    assert len(got) == len(data) and all(0 <= r.extra < r.n and 0 <= r.base and r.base * r.n + r.extra <= 3 * r.n for r in got.values())
    for sk, least in (("s", 5), ("t", 9)):
        want = sum(z * (b * n + (n * w if sk == "s" else w)) for k, z, n, b, w in data if k == sk)
        assert abs(want - sum(z * (r.base * r.n + r.extra) for (k, z), r in got.items() if k == sk)) <= least


def test_native(spark, sf):
    plan = op4_entropy_balanced_mix(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)], [(1, "one document", "a")]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(r.taken == r.size for r in got)
