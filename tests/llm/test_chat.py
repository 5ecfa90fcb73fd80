"""op3 against prefix comparison in Python."""

import random

from fieldquant.llm import chat


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    groups = {}
    for c, t in convs.items():
        groups.setdefault(tuple(t), []).append(c)
    out = []
    for t, cs in groups.items():
        if not any(len(o) > len(t) and o[: len(t)] == t for o in groups):
            out.append((min((c for c in cs if c is not None), default=None), len(t), len(cs), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3).selectExpr("*", "1 as k", "2 as n", "'x' as p0", "3 as copies", "4 as n_turns", "5 as kept_id", "6 as x")
    k = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in chat.formatted(df).collect()), key=k) == sorted(brute(rows), key=k)


def test_snapshots_copies_and_near_prefixes(spark):
    rnd, rows, c = random.Random(2), [], 0
    for _ in range(40):
        turns = [(rnd.choice(["user", "assistant"]), rnd.choice(["hi", "yes", "no", "", None, "long " * 50])) for _ in range(rnd.randrange(1, 9))]
        for n in {len(turns), *(rnd.randrange(1, len(turns) + 1) for _ in range(3))}:  # logged as it grew
            for _ in range(rnd.choice([1, 1, 2])):
                rows += [(c, k, *t) for k, t in enumerate(turns[:n])]
                c += 1
    rnd.shuffle(rows)
    check(spark, rows)


def test_awkward_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (2, 0, "user", ""), (3, None, "user", ""), (None, 0, "a", "b"), (None, 1, "a", "b"), (4, 0, "u", "t"), (4, 0, "u", "t"), (5, 0, "u", "t"), (6, 7, "u", "t" * 100_000), (7, 0, "userx", ""), (8, 0, "user", "x")]
    check(spark, rows)


def test_empty_and_nothing_but_null_ids(spark):
    check(spark, [])
    check(spark, [(None, 1, None, None), (None, 0, None, None)])


def test_the_null_id_is_no_string_id(spark):
    rows = [(None, 0, "a", "null's"), ("-", 0, "a", "dash's"), ("c-", 0, "a", "other"), (None, 1, "a", "more")]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    got = {r.conv_id: (r.n_turns, r.rendered.count("<|im_start|>")) for r in chat.formatted(df).collect()}
    assert got == {None: (2, 2), "-": (1, 1), "c-": (1, 1)}
