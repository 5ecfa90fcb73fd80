"""Interpolation of three dimensions on blocks of 33 x 9 x 9 points between anchors.

Every eighth point of each axis is an anchor and stored.  Levels of 4, 2 and 1
fill in what lies between, along z, y and x in turn, from reconstructed values:
cubic where four points are at hand, quadratic near a side, linear or a copy
otherwise; the bound is tighter on coarse levels.  A block also holds the planes
that begin the next blocks; they are predicted again there from the same points,
so blocks are independent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from . import sparse

STEP = 8
BLOCK = (32, 8, 8)
ALPHA, BETA = 1.25, 2.0


@dataclass(frozen=True)
class Levels:
    """How much tighter the bound is on coarse levels: eb / min(alpha^level, beta), level 0 being the finest."""

    alpha: float = ALPHA
    beta: float = BETA

    def bound(self, eb: float, unit: int) -> float:
        return eb / min(self.alpha ** int(np.log2(unit)), self.beta)


def _guess(a: np.ndarray, k: int, unit: int) -> np.ndarray:
    """The value at k of the first axis from points at odd distances of unit."""
    n, has = a.shape[0], lambda j: 0 <= j < a.shape[0]
    l3, l1, r1, r3 = k - 3 * unit, k - unit, k + unit, k + 3 * unit
    if has(l3) and has(r3):
        return (-a[l3] + 9 * a[l1] + 9 * a[r1] - a[r3]) / 16
    if has(r3):
        return (3 * a[l1] + 6 * a[r1] - a[r3]) / 8
    if has(l3) and has(r1):
        return (-a[l3] + 6 * a[l1] + 3 * a[r1]) / 8
    return (a[l1] + a[r1]) / 2 if has(r1) else a[l1]


def walk(x: np.ndarray, eb: float, visit, levels: Levels = Levels()) -> None:
    """Fills x (z, y, x; anchors given) by visit(index, guess, bound) -> values."""
    nz, ny, nx = x.shape
    for unit in (4, 2, 1):
        b, two = levels.bound(eb, unit), 2 * unit
        # z: between planes that exist at twice the unit in y and x; then y; then x
        for axis, grid in ((0, (None, slice(0, ny, two), slice(0, nx, two))), (1, (slice(0, nz, unit), None, slice(0, nx, two))), (2, (slice(0, nz, unit), slice(0, ny, unit), None))):
            moved = np.moveaxis(x, axis, 0)
            other = tuple(g for g in grid if g is not None)
            for k in range(unit, moved.shape[0], two):
                index = list(grid)
                index[axis] = k
                guess = _guess(moved[(slice(None), *other)], k, unit)
                x[tuple(index)] = visit(tuple(index), guess, b)


def compress_block(v: np.ndarray, known: np.ndarray, eb: float, radius: int, levels: Levels = Levels()) -> tuple[np.ndarray, np.ndarray]:
    """(codes, outlier values); known: points inside the field, others are taken as predicted."""
    x = np.zeros_like(v)
    x[::STEP, ::STEP, ::STEP] = v[::STEP, ::STEP, ::STEP]
    codes, kept = np.full(v.shape, radius, np.int64), np.zeros_like(v)

    def visit(index, guess, b):
        e = v[index] - guess
        step = np.floor((np.floor(np.abs(e) / b) + 1) / 2) * np.sign(e)
        ok = (np.abs(step) < radius) & (np.abs(guess + step * 2 * b - v[index]) <= b)
        inside = known[index]
        codes[index] = np.where(inside, np.where(ok, step + radius, 0), radius)
        kept[index] = np.where(inside & ~ok, v[index], 0)
        return np.where(inside, np.where(ok, guess + step * 2 * b, v[index]), guess)

    walk(x, eb, visit, levels)
    return codes, kept


def rebuild_block(anchors: np.ndarray, codes: np.ndarray, kept: np.ndarray, eb: float, radius: int, levels: Levels = Levels()) -> np.ndarray:
    x = np.zeros(codes.shape)
    x[::STEP, ::STEP, ::STEP] = anchors
    walk(x, eb, lambda index, guess, b: np.where(codes[index] == 0, kept[index], guess + (codes[index] - radius) * 2 * b), levels)
    return x


def _dealt(df: DataFrame) -> DataFrame:
    """Each point in its block and, on a block's first plane, in the blocks before."""
    for axis, size in zip("xyz", BLOCK):
        own = F.floor(F.col(axis) / size).cast("bigint")
        also = F.when((F.col(axis) % size == 0) & (F.col(axis) > 0), F.array(own, own - 1)).otherwise(F.array(own))
        df = df.withColumn(f"b{axis}", F.explode(also))
    return df


def _places(t: pa.Table):
    """(index of each point in its block, whether the block is its own)."""
    x, y, z = (t.column(c).to_numpy() for c in "xyz")
    bx, by, bz = (t.column(f"b{c}")[0].as_py() for c in "xyz")
    mine = (x < (bx + 1) * BLOCK[0]) & (y < (by + 1) * BLOCK[1]) & (z < (bz + 1) * BLOCK[2])
    return (z - bz * BLOCK[2], y - by * BLOCK[1], x - bx * BLOCK[0]), mine


SIDES = (BLOCK[2] + 1, BLOCK[1] + 1, BLOCK[0] + 1)
_KEYS = ["field_id", "bx", "by", "bz"]


def encode(df: DataFrame, radius: int = 512, levels: Levels = Levels()) -> DataFrame:
    """field_id, i, x, y, z, code, val (the value of an outlier, else null), and on one row a block its place and anchors.

    df: field_id, i, x, y, z, v, eb.  Anchors beyond a ragged end repeat the last plane, so they are stored by block.
    """
    ship(df.sparkSession)
    v = _dealt(df.select("field_id", "i", "x", "y", "z", F.col("v").cast("double").alias("v"), F.col("eb").cast("double").alias("eb")))

    def run(t: pa.Table) -> pa.Table:
        at, mine = _places(t)
        a, known = np.zeros(SIDES), np.zeros(SIDES, bool)
        a[at], known[at] = t.column("v").to_numpy(), True
        for axis in range(3):  # beyond the field: the last plane again, so that anchors exist everywhere
            last = int(at[axis].max())
            a = np.take(a, np.minimum(np.arange(SIDES[axis]), last), axis=axis)
        codes, kept = compress_block(a, known, t.column("eb")[0].as_py(), radius, levels)
        code, value = codes[at][mine], kept[at][mine]
        n = len(code)
        own = t.filter(pa.array(mine)).select(["field_id", "i", "x", "y", "z"])
        first = [[k] + [None] * (n - 1) for k in (t.column(c)[0].as_py() for c in ("bx", "by", "bz"))]
        corner = pa.array([a[::STEP, ::STEP, ::STEP].reshape(-1).tolist()] + [None] * (n - 1), pa.list_(pa.float64()))
        out = [pa.array(code, pa.int32()), pa.array(value, mask=code != 0), *(pa.array(k, pa.int64()) for k in first), corner]
        return pa.Table.from_arrays([*own.columns, *out], names=[*own.column_names, "code", "val", "bx", "by", "bz", "anchors"])

    return v.groupBy(*_KEYS).applyInArrow(run, "field_id string, i bigint, x bigint, y bigint, z bigint, code int, val double, bx bigint, by bigint, bz bigint, anchors array<double>")


def decode(codes: DataFrame, outliers: DataFrame, anchors: DataFrame, radius: int = 512, levels: Levels = Levels()) -> DataFrame:
    """field_id, i, x, y, z, v.  codes: field_id, i, x, y, z, code, eb; outliers: field_id, i, val; anchors: a row a block."""
    ship(codes.sparkSession)
    c = _dealt(sparse.scatter(codes, outliers))
    lattice = anchors.select(*[F.col(k).alias(f"__{k}") for k in _KEYS], "anchors")
    # a block's anchors travel with its first point
    first = F.col("i") == F.min("i").over(Window.partitionBy(*_KEYS))
    c = c.withColumn("first", first).join(lattice, [F.col(k) == F.col(f"__{k}") for k in _KEYS])
    c = c.select(*_KEYS, "i", "x", "y", "z", "eb", "code", F.col("val").cast("double").alias("val"), F.when(F.col("first"), F.col("anchors")).alias("anchors"))

    def run(t: pa.Table) -> pa.Table:
        at, mine = _places(t)
        code, kept = np.full(SIDES, radius, np.int64), np.zeros(SIDES)
        code[at], kept[at] = t.column("code").to_numpy(), t.column("val").fill_null(0.0).to_numpy()
        corner = np.array(next(x for x in t.column("anchors").to_pylist() if x is not None)).reshape([len(range(0, n, STEP)) for n in SIDES])
        back = rebuild_block(corner, code, kept, t.column("eb")[0].as_py(), radius, levels)
        own = t.filter(pa.array(mine)).select(["field_id", "i", "x", "y", "z"])
        return own.append_column("v", pa.array(back[at][mine]))

    return c.groupBy(*_KEYS).applyInArrow(run, "field_id string, i bigint, x bigint, y bigint, z bigint, v double")


def round_trip(df: DataFrame, eb: float, radius: int = 512, levels: Levels = Levels()) -> DataFrame:
    """field_id, i, v, code, xv: compressed and rebuilt."""
    e = encode(df.withColumn("eb", F.lit(float(eb))), radius, levels)
    codes = e.select("field_id", "i", "x", "y", "z", "code", F.lit(float(eb)).alias("eb"))
    back = decode(codes, e.filter("val is not null").select("field_id", "i", "val"), e.filter("anchors is not null").select(*_KEYS, "anchors"), radius, levels)
    both = back.select(F.col("field_id").alias("__f"), F.col("i").alias("__i"), F.col("v").alias("xv")).join(e.select("field_id", "i", "code"), (F.col("field_id") == F.col("__f")) & (F.col("i") == F.col("__i")))
    return df.select("field_id", "i", "v").join(both.select("__f", "__i", "xv", "code"), (F.col("field_id") == F.col("__f")) & (F.col("i") == F.col("__i"))).select("field_id", "i", "v", "code", "xv")
