"""The pipeline: each stage on its own input, and run() as the stages one after the other."""

from collections import Counter

import corpus_pipeline as cp

from fieldquant.llm import bpe, minhash, mixing, quality
from fieldquant.llm.queries import tokenizer_path


def staged(spark, sf, tmp, docs):
    out = []
    for k, (name, f) in enumerate(cp.STAGES):
        new = f(spark, docs, sf)
        assert k == len(cp.STAGES) - 1 or new.columns == docs.columns
        new.write.parquet(f"{tmp}/{k}")
        docs = spark.read.parquet(f"{tmp}/{k}")
        out.append(docs)
    return out


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good, single, mixed, last = staged(spark, sf, tmp_path, docs)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.verdicts(docs).collect() if r.kept}
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in minhash.near_duplicates(good, 5, 80).collect() if r.kept}
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter({r.doc_id: r.copies for r in mixing.mix(single).collect()})
    assert Counter(map(tuple, last.collect())) == Counter(map(tuple, bpe.round_trip(mixed, tokenizer_path()).collect()))
    assert Counter(map(tuple, cp.run(spark, sf).collect())) == Counter(map(tuple, last.collect()))


def test_awkward_rows_and_none(spark, sf, tmp_path, awkward_docs, no_docs):
    found = staged(spark, sf, f"{tmp_path}/a", awkward_docs)
    assert found[-1].count() > 0 and found[0].count() >= found[1].count()
    assert staged(spark, sf, f"{tmp_path}/b", no_docs)[-1].count() == 0


def test_registered():
    import __spark_entry__ as e

    q = e.queries()
    assert "pipeline" in q and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11))
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 4
