"""Histograms of codes and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, code: str = "code") -> DataFrame:
    """field_id, code, freq; partial counts before the shuffle, so a peak costs nothing."""
    return df.groupBy("field_id", F.col(code).alias("code")).agg(F.count("*").alias("freq"))


def densify(hist: DataFrame, bins: int) -> DataFrame:
    """All bins of every field, absent ones with 0."""
    every = hist.select("field_id").distinct().select(F.col("field_id"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("code"))
    h = hist.select(F.col("field_id").alias("__f"), F.col("code").alias("__c"), "freq")
    return every.join(h, (F.col("field_id") == F.col("__f")) & (F.col("code") == F.col("__c")), "left").select("field_id", "code", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"))


def histogram_centered(df: DataFrame, radius: int, code: str = "code") -> DataFrame:
    """The same as histogram(): all but the centre are counted, the centre is what is left."""
    rest = df.filter(F.col(code) != radius).groupBy("field_id", F.col(code).alias("code")).agg(F.count("*").alias("freq"))
    n = df.groupBy("field_id").agg(F.count("*").alias("n"))
    off = rest.groupBy("field_id").agg(F.sum("freq").alias("off"))
    center = n.join(off, "field_id", "left").select("field_id", F.lit(radius).alias("code"), (F.col("n") - F.coalesce("off", F.lit(0))).alias("freq")).filter("freq > 0")
    return rest.unionByName(center)


def entropy(hist: DataFrame) -> DataFrame:
    """field_id, n, top_share, entropy in bits, and bounds of a Huffman code's bits a symbol.

    With the largest share p1: a redundancy of at least 1 - H(p1) for p1 > 0.4
    and of at most p1 + 0.086.
    """
    n = hist.groupBy(F.col("field_id").alias("__f")).agg(F.sum("freq").alias("n"))
    p = F.col("freq") / F.col("n")
    g = hist.join(n, F.col("field_id") == F.col("__f")).groupBy("field_id", "n").agg(F.max(p).alias("top_share"), F.sum(F.when(F.col("freq") > 0, -p * F.log2(p)).otherwise(0.0)).alias("entropy"))
    p1 = F.col("top_share")
    binary = F.when(p1 < 1, -p1 * F.log2(p1) - (1 - p1) * F.log2(1 - p1)).otherwise(0.0)
    g = g.withColumn("low_bits", F.col("entropy") + F.when(p1 > 0.4, 1 - binary).otherwise(0.0))
    return g.withColumn("high_bits", F.col("entropy") + p1 + 0.086)
