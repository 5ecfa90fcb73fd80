"""Down-sampling, byte planes, spatial variation and perturbation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from ..sources.fields import tile_keys, with_tiles


def binning2d(df: DataFrame, fx: int, fy: int) -> DataFrame:
    """Means of fx x fy cells; cells at an edge are of what there is."""
    return df.groupBy("field_id", F.floor(F.col("x") / fx).alias("bx"), F.floor(F.col("y") / fy).alias("by")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def lag_pairs(df: DataFrame, lags: tuple[int, ...], every: int = 1) -> DataFrame:
    """field_id, lag, o, x: places i (every `every`-th) and i + lag, by an equi-join."""
    a = df.filter(F.col("i") % every == 0).select("field_id", F.col("v").alias("o"), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("i") + k).alias("j")) for k in lags])).alias("p"))
    b = df.select(F.col("field_id").alias("__f"), F.col("i").alias("__i"), F.col("v").alias("x"))
    return a.join(b, (F.col("field_id") == F.col("__f")) & (F.col("p.j") == F.col("__i"))).select("field_id", F.col("p.lag").alias("lag"), "o", "x")


def variogram(df: DataFrame, lags: tuple[int, ...], every: int = 1) -> DataFrame:
    """field_id, lag, n, and means of absolute (madogram), squared and binary differences."""
    d = F.col("x") - F.col("o")
    return lag_pairs(df, lags, every).groupBy("field_id", "lag").agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("madogram"), F.avg(d * d).alias("squared"), F.avg((d != 0).cast("double")).alias("binary"))


def variogram_2d(df: DataFrame, offsets: tuple[tuple[int, int], ...], tile: int | None = None) -> DataFrame:
    """field_id, dx, dy, n, and means of absolute and squared differences of points (x, y) and (x + dx, y + dy); with a tile,
    of pairs inside one tile only."""
    to = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in offsets])
    a = df.select("field_id", "x", "y", F.col("v").alias("o"), F.explode(to).alias("p"))
    if tile:
        a = a.filter(" and ".join(f"floor({c} / {tile}) = floor(p.{c} / {tile})" for c in "xy"))
    b = df.select(F.col("field_id").alias("__f"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("v").alias("w"))
    d = F.col("w") - F.col("o")
    both = a.join(b, (F.col("field_id") == F.col("__f")) & (F.col("p.x") == F.col("__x")) & (F.col("p.y") == F.col("__y")))
    return both.groupBy("field_id", F.col("p.dx").alias("dx"), F.col("p.dy").alias("dy")).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("madogram"), F.avg(d * d).alias("squared"))


def variogram_fit(vario: DataFrame, y: str = "madogram") -> DataFrame:
    """The regression of a variogram on distance."""
    return vario.groupBy("field_id").agg(F.regr_slope(y, "lag").alias("slope"), F.regr_intercept(y, "lag").alias("intercept"), F.regr_r2(y, "lag").alias("r2"))


def tile_variance(df: DataFrame, tile: int, lags: tuple[int, ...]) -> DataFrame:
    """Mean squared difference by distance of pairs inside a tile."""
    t = with_tiles(df, (tile,))
    w = Window.partitionBy(*tile_keys((tile,))).orderBy("x")
    t = t.select("field_id", *[F.pow(F.col("v") - F.lag("v", k).over(w), 2).alias(f"s{k}") for k in lags])
    diffs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in lags])
    return t.select("field_id", F.explode(diffs).alias("d")).filter("d.s is not null").groupBy("field_id", F.col("d.lag").alias("lag")).agg(F.avg("d.s").alias("variance"))


def bits_of(df: DataFrame, v: str = "v", single: bool = True) -> DataFrame:
    """field_id, i, u: the float's bits as an unsigned number (Arrow reinterprets; Spark has no such cast)."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            raw = b.column("v").to_numpy(zero_copy_only=False)
            u = raw.astype("<f4").view("<u4").astype(np.int64) if single else raw.astype("<f8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column("field_id"), b.column("i"), pa.array(u)], names=["field_id", "i", "u"])

    return df.select("field_id", "i", F.col(v).alias("v")).mapInArrow(run, "field_id string, i bigint, u bigint")


def byte_plane(u: Column, k: int) -> Column:
    """Byte k of a number, 0 the lowest."""
    return F.shiftright(u, 8 * k).bitwiseAND(F.lit(255))


def plane_ratios(bits: DataFrame, width: int = 4, chunk: int = 65_536) -> DataFrame:
    """field_id, plane, ratio: how well zstd packs each byte plane, in chunks."""
    ship(bits.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        u = t.sort_by("i").column("u").to_numpy()
        z = zstandard.ZstdCompressor()
        size = [len(z.compress(((u >> (8 * k)) & 255).astype(np.uint8).tobytes())) for k in range(width)]
        return pa.table({"field_id": [t.column("field_id")[0].as_py()] * width, "plane": pa.array(range(width), pa.int32()), "raw": pa.array([len(u)] * width, pa.int64()), "packed": pa.array(size, pa.int64())})

    c = bits.withColumn("c", F.floor(F.col("i") / chunk)).groupBy("field_id", "c").applyInArrow(run, "field_id string, plane int, raw bigint, packed bigint")
    return c.groupBy("field_id", "plane").agg((F.sum("raw") / F.sum("packed")).alias("ratio"))


def shuffled_blocks(df: DataFrame, tile: int, share: float, seed: int) -> DataFrame:
    """v permuted inside a sampled share of the tiles; the sample and the order come from MD5 of seed and number, so reruns
    agree, in SQL too."""
    t = with_tiles(df, (tile,))
    mark = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")).cast("binary"))
    chosen = F.conv(F.substring(mark(F.col("tx")), 1, 8), 16, 10).cast("bigint") % 1_000_000 < int(share * 1_000_000)
    keys = tile_keys((tile,))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("x"))
    order = F.when(chosen, mark(F.col("i")))
    a = t.withColumn("r", place).drop("v")
    b = t.select(*[F.col(k).alias(f"__{k}") for k in keys], F.row_number().over(Window.partitionBy(*keys).orderBy(order, "x")).alias("__r"), "v")
    return a.join(b, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("r") == F.col("__r")]).select("field_id", "i", "x", "y", "z", "v")
