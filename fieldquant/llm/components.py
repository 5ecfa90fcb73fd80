"""Connected components by alternating large-star and small-star.

Neither step sends a vertex's whole neighbourhood to one task: minima are
pre-aggregated, and the join that hands them back is an equi-join whose hot keys
Spark splits.  Each round is written to the shared folder, so lineage stays
short and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = both.join(least, F.col("u") == F.col("w")).filter(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("h"), F.sum(F.hash("v", "u").cast("bigint")).alias("g")).first()
    return r["n"], r["h"], r["g"]


def connected(edges: DataFrame, scratch: Scratch, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every vertex with an edge; component: the smallest vertex reachable.

    Edges are undirected; nulls and loops are ignored, repeats are harmless, no
    edges give no rows.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.write(e, "edges", narrow=True)
    before = _mark(e)
    while before[0]:
        new = scratch.write(_small(_large(e)), "stars", narrow=True)
        scratch.drop(e)
        e, now = new, _mark(new)
        if now == before:
            break
        before = now
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
