"""Outliers: dense codes to a sparse list and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of outliers from which a field counts as not compressible at its bound.
MOST_OUTLIERS = 0.1


def gather(df: DataFrame, radius: int, d: str = "d") -> DataFrame:
    """field_id, i, val (delta + radius) of the outliers; a filter, in no order."""
    return df.filter(F.abs(F.col(d)) >= radius).select("field_id", "i", (F.col(d) + radius).alias("val"))


def gather_by(df: DataFrame, keep: Column, v: str) -> tuple[DataFrame, DataFrame]:
    """(elements for which keep is false, the field with them set to 0)."""
    return df.filter(~keep).select("field_id", "i", F.col(v).alias("val")), df.withColumn(v, F.when(keep, F.col(v)).otherwise(0))


def scatter(df: DataFrame, cells: DataFrame, out: str = "val") -> DataFrame:
    """df with the cells' values at their places, null elsewhere.  An equi-join on (field_id, i)."""
    c = cells.select(F.col("field_id").alias("__f"), F.col("i").alias("__i"), F.col("val").alias(out))
    return df.join(c, (F.col("field_id") == F.col("__f")) & (F.col("i") == F.col("__i")), "left").drop("__f", "__i")


def nonzero(df: DataFrame, v: str = "v") -> DataFrame:
    return df.filter(F.col(v) != 0).select("field_id", "i", F.col(v).alias("val"))


def split_by_radius(df: DataFrame, radius: int, code: str = "code") -> DataFrame:
    return df.filter((F.col(code) >= 2 * radius) | (F.col(code) <= 0))


def split_by_binary(df: DataFrame, radius: int, code: str = "code") -> DataFrame:
    return df.filter(F.col(code) != radius)


def status(df: DataFrame, radius: int, d: str = "d") -> DataFrame:
    """field_id, n, n_outliers, status: TOO_MANY_OUTLIERS from a tenth on."""
    g = df.groupBy("field_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col(d)) >= radius).alias("n_outliers"))
    return g.withColumn("status", F.when(F.col("n_outliers") >= F.col("n") * MOST_OUTLIERS, "TOO_MANY_OUTLIERS").otherwise("SUCCESS"))


def first_invalid(df: DataFrame, book_size: int, code: str = "code") -> DataFrame:
    """field_id, first i with a code that the book doesn't have."""
    return df.groupBy("field_id").agg(F.min(F.when(F.col(code) >= book_size, F.col("i"))).alias("first_invalid"))


def anchors(df: DataFrame, step: int = 8) -> DataFrame:
    """The lattice of every step-th point of each axis."""
    on = (F.col("x") % step == 0) & (F.col("y") % step == 0) & (F.col("z") % step == 0)
    return df.filter(on).select("field_id", (F.col("x") / step).cast("bigint").alias("ax"), (F.col("y") / step).cast("bigint").alias("ay"), (F.col("z") / step).cast("bigint").alias("az"), "v")
