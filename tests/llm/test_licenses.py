"""op8: planted licences, wrapped and respelt, and what is not one."""

import duckdb
import pandas as pd
import pytest

from fieldquant.llm import licenses

MIT = "\n\n".join(licenses.SENTENCES[k][0] for k in (2, 3, 4))
GPL = " ".join(licenses.SENTENCES[k][0] for k in (21, 23, 24))


def wrapped(text, width=50):
    out, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


CASES = [
    ("nothing here", 0, ""), (None, 0, ""), ("", 0, ""), ("A permission slip and a warranty card.", 0, ""),
    ("Intro.\nReleased under the MIT License.\nmore", 1, "MIT"), ("text before. released UNDER the mit   license. text after", 1, "MIT"),
    (MIT, 3, "MIT"), ("Copyright someone\n\n" + wrapped(GPL), 3, "GPL-3.0-or-later"), (licenses.SENTENCES[23][0], 1, "unknown"),
    ("Licensed under CC BY-NC 4.0.\n" + MIT, 4, "MIT,CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.", 2, "CC-BY-4.0"),
    ("filler words here. " * 30_000 + "\nReleased under the MIT License.", 1, "MIT"),
]


def test_planted(spark):
    rows = [(k, t) for k, (t, _, _) in enumerate(CASES)] + [(4, CASES[4][0]), (None, CASES[4][0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as left", "'x' as hit0", "3 as licenses", "4 as a")
    got = licenses.scanned(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_sentences, r.licenses) for r in got) == sorted([(False, k, n, x) for k, (_, n, x) in enumerate(CASES)] + [(False, 4, 1, "MIT"), (True, 0, 1, "MIT")])


def test_empty(spark):
    assert licenses.scanned(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(licenses.oracle()).fetchall())
    got = sorted((r.doc_id, r.licenses, r.n_sentences) for r in licenses.scanned(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    assert got == sorted((i, x, n) for i, n, x in want)


def test_sql_on_notices_of_both_forms(spark, tmp_path):
    """The SQL knows what the operator knows, on every planted form and on texts that hold a wrapped notice beside lines."""
    bsd = "\n\n".join(wrapped(licenses.SENTENCES[k][0]) for k in (30, 31, 32))
    more = ["Copyright 2020 Foo\nLicensed under the MIT License.\n\n" + bsd, bsd + "\na\nb\nLicensed under the ISC License.\nc", "x\n\n" + wrapped(GPL, 30) + "\n" + MIT, "\ue000 a\ue000b\nLicensed under the MIT License.", "a\nb\nc\nLicensed under the MIT License.\nd. e! f\n\n\n g"]
    spark.createDataFrame([(k, t) for k, t in enumerate([c[0] for c in CASES] + more)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(licenses.oracle()).fetchall())
    assert sorted((r.doc_id, r.n_sentences, r.licenses) for r in licenses.scanned(spark.read.parquet(f"{tmp_path}/d")).collect()) == want


def test_identifiers_far_apart_make_no_licence(spark):
    one, two, three = (licenses.SENTENCES[k][0] for k in (30, 31, 32))
    gap = lambda n: " ".join(f"Sentence number {k} here." for k in range(n))
    rows = [(n, f"{one}\n\n{gap(n)} {two} {three}") for n in (0, licenses.GAP, licenses.GAP + 1)]
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: (3, "BSD-2-Clause"), licenses.GAP: (3, "BSD-2-Clause"), licenses.GAP + 1: (3, "unknown")}


def test_every_licence_has_a_rule_that_a_text_can_meet(spark):
    text = lambda run: "\n\n".join(licenses.SENTENCES[i][0] for i in run)
    df = spark.createDataFrame([(k, text(run)) for k, (_, run) in enumerate(licenses.RULES)], "doc_id bigint, text string")
    got = {r.doc_id: r.licenses for r in licenses.scanned(df).collect()}
    assert all(name in got[k].split(",") for k, (name, _) in enumerate(licenses.RULES)), [(licenses.RULES[k], got[k]) for k in got if licenses.RULES[k][0] not in got[k]]


def test_marks_cover_all_sentences():
    import re

    assert all(re.search(licenses.MARKS, s.lower()) for all_ in licenses.SENTENCES.values() for s in all_)


def test_planted_lines_of_the_table_are_found(spark, sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    for name, line in (("MIT", "MIT License"), ("Apache-2.0", "Apache License"), ("GPL-3.0-only", "GNU General Public License, version 3"), ("CC-BY-NC-4.0", "CC BY-NC 4.0")):
        want = set(d.doc_id[d.text.str.contains(line, regex=False, na=False)])
        got = {r.doc_id for r in licenses.scanned(spark.read.parquet(f"{sf}/documents.parquet")).collect() if name in r.licenses.split(",")}
        assert got == want


def test_every_known_sentence_is_found_alone_and_wrapped(spark):
    every = [s for all_ in licenses.SENTENCES.values() for s in all_]
    rows = [(2 * k + w, "Before it.\n\n" + (wrapped(s, 30) if w else s) + "\n\nAfter it.") for k, s in enumerate(every) for w in (0, 1)]
    got = {r.doc_id: r.n_sentences for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(n >= 1 for n in got.values()), [every[k // 2] for k, n in got.items() if n < 1]


def test_a_notice_on_a_line_and_a_wrapped_one(spark):
    bsd = "\n\n".join(wrapped(licenses.SENTENCES[k][0]) for k in (30, 31, 32))
    line = "Copyright 2020 Foo\nLicensed under the MIT License."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'
    rows = [(1, f"{line}\n\n{bsd}"), (2, f"{bsd}\n\n{line}"), (3, f"{line}\n\n{wrapped(licenses.SENTENCES[2][0])}"), (4, f"{apache}\n\n{wrapped(GPL)}"), (5, f"\ue000 a\ue000b\n{line}\n\n{bsd}")]
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    both = (4, "BSD-2-Clause,MIT")
    assert got == {1: both, 2: both, 3: (2, "MIT"), 4: (5, "GPL-3.0-or-later,Apache-2.0"), 5: both}
