"""python -m fieldquant compress | decompress | analyze: pipelines on files.

A source is a raw binary file or folder (--dtype f4 or f8) or a table of any
format that Spark reads (--format, with --index and --value).
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from .operators import stats
from .plans import pipeline
from .plans.pipeline import Config
from .sources import fields, rawbinary
from .sources.fields import Shape


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldquant", description=__doc__.split("\n")[0])
    todo = p.add_subparsers(dest="task", required=True)
    for name in ("compress", "decompress", "analyze"):
        t = todo.add_parser(name)
        t.add_argument("source", help="the field, or for decompress the archive")
        if name != "analyze":
            t.add_argument("to", help="where the result is written")
        t.add_argument("--dtype", choices=sorted(rawbinary.WIDTH), help="raw binary numbers of this type")
        t.add_argument("--format", default="parquet")
        t.add_argument("--index", default="i")
        t.add_argument("--value", default="v")
        t.add_argument("--shape", help="x fastest, such as 3600x1800")
        if name == "decompress":
            t.add_argument("--compare", help="the original field: quality is printed")
        else:
            t.add_argument("--eb", type=float, default=0.1)
            t.add_argument("--mode", choices=["abs", "rel"], default="rel")
            t.add_argument("--radius", type=int, default=512)
            t.add_argument("--predictor", default="lorenzo")
            t.add_argument("--codec", default="huffman")
            t.add_argument("--zigzag", action="store_true")
    return p


def _field(spark: SparkSession, a: argparse.Namespace, path: str) -> DataFrame:
    shape = Shape.parse(a.shape) if a.shape else None
    if a.dtype:
        return fields.from_table(rawbinary.read(spark, path, a.dtype), "i", "v", shape)
    return fields.from_table(spark.read.format(a.format).load(path), a.index, a.value, shape)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fieldquant").getOrCreate()
    if a.task == "decompress":
        back = pipeline.decompress(pipeline.read_archive(spark, a.source))
        if a.dtype:
            rawbinary.register(spark)
            kind = "float" if a.dtype == "f4" else "double"
            back.selectExpr("i", f"cast(v as {kind}) as v").sortWithinPartitions("i").write.format("rawbinary").option("dtype", a.dtype).mode("append").save(a.to)
        else:
            back.write.mode("overwrite").format(a.format).save(a.to)
        if a.compare:
            stats.assess(stats.paired(_field(spark, a, a.compare), back)).show(truncate=False)
        return
    ndim = Shape.parse(a.shape).ndim if a.shape else 1
    cfg = Config(a.eb, a.mode, a.radius, ndim, a.predictor, a.zigzag, a.codec)
    for w in cfg.warnings:
        print(f"warning: {w.name}")
    if a.task == "analyze":
        pipeline.analyze(_field(spark, a, a.source), cfg).filter("freq > 0").orderBy("code").show(2 * cfg.radius, truncate=False)
        return
    began = time.perf_counter()
    archive = pipeline.compress(_field(spark, a, a.source), cfg)
    archive.write(a.to)
    print(f"seconds: {time.perf_counter() - began:.3f}")
    found = pipeline.read_archive(spark, a.to)
    pipeline.lengths(found).show(truncate=False)
    pipeline.sizes(found).show(truncate=False)


if __name__ == "__main__":
    main()
