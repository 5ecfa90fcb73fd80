"""op5: the law of near equal bytes, groups, slots, and best fit itself."""

import random
import zlib
from collections import defaultdict

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldquant.llm import sharding
from fieldquant.llm.queries import op5_packed_shards


def check(got, rows, n=8):
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    shard_bytes, slots, home = [0] * n, defaultdict(list), defaultdict(set)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        shard_bytes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        home[(r.text_crc32, r.size)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in home.values())  # equal texts share a shard
    return shard_bytes


def test_query(spark, sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    b = check(op5_packed_shards(spark, sf).collect(), list(zip(d.doc_id.tolist(), d.text.tolist())))
    assert max(b) - min(b) <= 0.01 * sum(b) / 8


def test_awkward_rows(awkward_docs, awkward_rows, no_docs):
    check(sharding.shards(awkward_docs).collect(), [r[:2] for r in awkward_rows])
    assert sharding.shards(no_docs).collect() == []


def test_a_third_of_all_rows_is_one_group(spark):
    rnd = random.Random(1)
    rows = [(k, "the same text") for k in range(1500)] + [(2000 + k, "t" * rnd.randrange(1, 60) + str(k)) for k in range(3000)]
    b = check(sharding.shards(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)
    rest = sorted(b)[:-1]
    assert max(rest) - min(rest) <= 0.02 * sum(rest) / 7


def brute_best_fit(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(free, b) for b, free in enumerate(bins) if free >= sizes[i]]
        b = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append(max(capacity, sizes[i]))
        bins[b] -= sizes[i]
        out[i] = b
    return out, len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(1, 80))
def test_pack_is_best_fit_decreasing(sizes, capacity):
    assert sharding.pack(sizes, capacity) == brute_best_fit(sizes, capacity)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 500), max_size=80), st.integers(1, 9))
def test_balance_uses_no_more_bins(sizes, n):
    out = sharding.balance(sizes, n)
    assert all(0 <= b < n for b in out)


def test_fixed_capacity(spark):
    rows = [(k, "a" * (k % 9 * 10) + str(k)) for k in range(400)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), None, 2000).groupBy("shard").sum("__s_size").collect()
    total = sum(len(t) + 1 for _, t in rows)
    assert all(r[1] <= 2000 for r in out) and len(out) <= total / 2000 * 1.25 + 1


def test_fixed_capacity_over_cells(spark, monkeypatch):
    """Groups of every size: no shard above the capacity but for a group that is, nearly as few as the bytes need, numbers without gaps."""
    monkeypatch.setattr(sharding, "CELL", 4)
    monkeypatch.setattr(sharding, "LARGE", 16)
    rnd = random.Random(5)
    rows = [(k, "x" * int(2 ** rnd.uniform(0, 9)) + str(k % 1900)) for k in range(4000)] + [(9000, "y" * 5000), (9001, None), (9002, "")] + [(9100 + k, "third " * 20) for k in range(11)]
    for capacity in (1500, 4000, 10**9):
        got = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), capacity=capacity).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        size, home, group = defaultdict(int), defaultdict(set), defaultdict(int)
        for r in got:
            size[r.shard] += r["__s_size"]
            home[r["__s_key"]].add(r.shard)
            group[r["__s_key"]] += r["__s_size"]
        assert all(len(s) == 1 for s in home.values()) and sorted(size) == list(range(len(size)))
        over = [g for g in group.values() if g > capacity]
        assert sum(b > capacity for b in size.values()) == len(over)
        least = -(-(sum(size.values()) - sum(over)) // capacity) + len(over)
        assert len(size) <= least * 1.15 + 2
        again = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), capacity=capacity).collect()
        assert sorted((r.doc_id, r.shard) for r in again) == sorted((r.doc_id, r.shard) for r in got)


def test_capacity_of_awkward_rows(awkward_docs, awkward_rows, no_docs):
    got = sharding.assign(awkward_docs, capacity=100_000).collect()
    assert len(got) == len(awkward_rows) and sharding.assign(no_docs, capacity=10).collect() == []


def test_many_balanced_shards(spark):
    rows = [(k, "z" * (k % 97)) for k in range(97)] + [(1000 + k, "z" * 50 + str(k)) for k in range(20_000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), 600).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r["__s_size"]
    mean = sum(size.values()) / 600
    # the least capacity that 600 bins need: what it leaves free is in one of them
    assert len(size) == 600 and max(size.values()) <= 1.02 * mean and sorted(size.values())[1] >= 0.95 * mean
