"""Run lengths of codes.

Runs are found inside blocks, where a window is bounded; runs that touch a block's
end are joined by a second pass over one row a run of a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def encode(df: DataFrame, v: str = "code", block: int = 65_536) -> DataFrame:
    """field_id, start, len, value of each run in the order of i (dense from 0)."""
    b = df.select("field_id", "i", F.col(v).alias("value"), F.floor(F.col("i") / block).alias("b"))
    w = Window.partitionBy("field_id", "b").orderBy("i")
    b = b.withColumn("new", (~F.col("value").eqNullSafe(F.lag("value").over(w)) | F.lag("i").over(w).isNull()).cast("int"))
    b = b.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = b.groupBy("field_id", "b", "run", "value").agg(F.min("i").alias("start"), F.count("*").alias("len"))
    # across blocks: only a block's first and last run can be part of a longer one
    edge = Window.partitionBy("field_id", "b")
    runs = runs.withColumn("head", F.col("start") == F.min("start").over(edge)).withColumn("tail", F.col("start") == F.max("start").over(edge))
    inner, outer = runs.filter(~(F.col("head") | F.col("tail"))), runs.filter(F.col("head") | F.col("tail"))
    u = Window.partitionBy("field_id").orderBy("start")  # two rows a block
    new = ~F.col("head") | ~F.col("value").eqNullSafe(F.lag("value").over(u)) | F.lag("start").over(u).isNull()
    outer = outer.withColumn("all", F.sum(new.cast("int")).over(u.rowsBetween(Window.unboundedPreceding, 0)))
    outer = outer.groupBy("field_id", "all", "value").agg(F.min("start").alias("start"), F.sum("len").alias("len"))
    return inner.select("field_id", "start", "len", "value").unionByName(outer.select("field_id", "start", "len", "value"))


def decode(runs: DataFrame) -> DataFrame:
    return runs.select("field_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("i"), F.col("value").alias("code"))
