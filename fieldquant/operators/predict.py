"""Lorenzo prediction inside tiles, forward and inverse, as windows.

A stencil of n dimensions is n differences along one axis each; its inverse is n
running sums.  The frame is dealt by (field, tile) once; as every window's keys
contain these, forward and inverse need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import quant
from ..sources.fields import tile_keys, with_tiles

#: Tiles of one, two and three dimensions: large ones and those of the prototype.
PRODUCTION = {1: (1024,), 2: (32, 32), 3: (8, 8, 8)}
PROTOTYPE = {1: (256,), 2: (16, 16), 3: (8, 8, 8)}


def _lines(tile: tuple[int, ...], axis: int):
    """The window along one axis inside a tile."""
    other = [a for k, a in enumerate("xyz"[: len(tile)]) if k != axis]
    return Window.partitionBy(*tile_keys(tile), *other).orderBy("xyz"[axis])


def dealt(df: DataFrame, tile: tuple[int, ...]) -> DataFrame:
    return with_tiles(df, tile).repartition(*tile_keys(tile))


def forward(df: DataFrame, tile: tuple[int, ...], q: str = "q", out: str = "d", deal: bool = True) -> DataFrame:
    """Adds the difference between q and its prediction; outside of the tile q counts as 0."""
    df = dealt(df, tile) if deal else df
    df = df.withColumn(out, F.col(q))
    for axis in range(len(tile)):
        df = df.withColumn(out, F.col(out) - F.coalesce(F.lag(out).over(_lines(tile, axis)), F.lit(0)))
    return df


def inverse(df: DataFrame, tile: tuple[int, ...], d: str = "d", out: str = "q", deal: bool = True) -> DataFrame:
    """Adds the running sums of d along every axis of the tile."""
    df = dealt(df, tile) if deal else df
    df = df.withColumn(out, F.col(d))
    for axis in range(len(tile)):
        df = df.withColumn(out, F.sum(out).over(_lines(tile, axis).rowsBetween(Window.unboundedPreceding, 0)))
    return df


def forward_untiled(df: DataFrame, q: str = "q", out: str = "d", block: int = 65_536) -> DataFrame:
    """Differences over a whole field of one dimension: each block also gets the last element of the one before."""
    own = df.withColumn("__b", F.floor(F.col("x") / block)).withColumn("__own", F.lit(True))
    halo = own.filter(F.col("x") % block == block - 1).withColumn("__b", F.col("__b") + 1).withColumn("__own", F.lit(False))
    w = Window.partitionBy("field_id", "__b").orderBy("x")
    both = own.unionByName(halo).withColumn(out, F.col(q) - F.coalesce(F.lag(q).over(w), F.lit(0)))
    return both.filter("__own").drop("__b", "__own")


def inverse_untiled(df: DataFrame, d: str = "d", out: str = "q", block: int = 65_536) -> DataFrame:
    """Running sum over a whole field: sums inside blocks, plus the sum of the blocks before (one row a block)."""
    b = df.withColumn("__b", F.floor(F.col("x") / block))
    w = Window.partitionBy("field_id", "__b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    sums = b.groupBy("field_id", "__b").agg(F.sum(d).alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy("field_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("field_id").alias("__f"), F.col("__b").alias("__c"), before.alias("__before"))
    out_df = b.withColumn(out, F.sum(d).over(w)).join(sums, (F.col("field_id") == F.col("__f")) & (F.col("__b") == F.col("__c")))
    return out_df.withColumn(out, F.col(out) + F.col("__before")).drop("__b", "__c", "__f", "__before")


def forward_lines(df: DataFrame, ndim: int, q: str = "q", out: str = "d") -> DataFrame:
    """Differences over whole fields of two or three dimensions, without tiles: along each axis, line by line."""
    return _lines_of(df, ndim, q, out, lambda c, w: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)))


def inverse_lines(df: DataFrame, ndim: int, d: str = "d", out: str = "q") -> DataFrame:
    return _lines_of(df, ndim, d, out, lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _lines_of(df: DataFrame, ndim: int, of: str, out: str, step) -> DataFrame:
    df = df.withColumn(out, F.col(of))
    for axis in "xyz"[:ndim]:
        df = df.withColumn(out, step(out, Window.partitionBy("field_id", *[a for a in "xyz"[:ndim] if a != axis]).orderBy(axis)))
    return df


def errors_of_values(df: DataFrame, ndim: int, eb: str = "eb", v: str = "v", out: str = "step", block: int = 65_536) -> DataFrame:
    """The approximation of loop-carried predictors that can be a window: errors against the original neighbours of a whole
    field, in steps of twice the bound, halves to even, of any size."""
    df = forward_untiled(df, v, out, block) if ndim == 1 else forward_lines(df, ndim, v, out)
    return df.withColumn(out, quant.prequantize_half_even(F.col(out), F.col(eb)))


def zero_share(d: Column) -> Column:
    """Aggregate: share of elements that are predicted exactly."""
    return F.count_if(d == 0) / F.count("*")
