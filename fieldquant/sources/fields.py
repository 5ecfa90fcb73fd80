"""Fields: dense arrays of one to three dimensions in long form (field_id, i, x, y, z, v).

x runs fastest: i = x + y * lx + z * lx * ly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: Rows of a table of one row (or one book) a field that are sent to every executor; more are joined by shuffle.
MOST_SENT = 100_000


@dataclass(frozen=True)
class Shape:
    x: int
    y: int = 1
    z: int = 1

    def __post_init__(self):
        if min(self.x, self.y, self.z) < 1 or self.length <= 1:
            raise ValueError(f"a field has two elements at least: {self}")

    @property
    def length(self) -> int:
        return self.x * self.y * self.z

    @property
    def ndim(self) -> int:
        return 1 if self.z == 1 and self.y == 1 else 2 if self.z == 1 else 3

    @classmethod
    def parse(cls, text: str, slowest_first: bool = False) -> Shape:
        """'3600x1800' and the like; delimiters x * - , m."""
        parts = [int(p) for p in re.split(r"[x*\-,m]", text.strip()) if p]
        return cls(*(reversed(parts) if slowest_first else parts))


def check_dtype(df: DataFrame, value: str) -> None:
    """Fields are of 32- or 64-bit floats."""
    if not isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType)):
        raise TypeError(f"unsupported type of a field: {df.schema[value].dataType.simpleString()}")


def from_table(df: DataFrame, index: str, value: str, shape: Shape | None = None, name: str = "field") -> DataFrame:
    """A column as a field; without a shape in one dimension.  No shuffle: coordinates are arithmetic on the index."""
    check_dtype(df, value)
    i = F.col(index).cast("bigint")
    lx, ly = (shape.x, shape.y) if shape else (0, 0)
    x = i % lx if shape and shape.ndim > 1 else i
    y = F.floor(i / lx) % ly if shape and shape.ndim > 2 else F.floor(i / lx) if shape and shape.ndim > 1 else F.lit(0)
    z = F.floor(i / (lx * ly)) if shape and shape.ndim > 2 else F.lit(0)
    return df.select(F.lit(name).alias("field_id"), i.alias("i"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), z.cast("bigint").alias("z"), F.col(value).alias("v"))


def from_arrays(df: DataFrame, row: str, values: str, width: int, name: str = "field") -> DataFrame:
    """Rows of a fixed width as a field of two dimensions (x: place in the array, y: row)."""
    e = df.select(F.col(row).cast("bigint").alias("y"), F.posexplode(values).alias("x", "v"))
    return e.select(F.lit(name).alias("field_id"), (F.col("y") * width + F.col("x")).alias("i"), F.col("x").cast("bigint").alias("x"), "y", F.lit(0).cast("bigint").alias("z"), F.col("v").cast("double").alias("v"))


def many(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One field for each key, elements in the order of `order`."""
    x = (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return df.select(F.col(key).cast("string").alias("field_id"), x.alias("i"), x.alias("x"), zero.alias("y"), zero.alias("z"), F.col(value).alias("v"))


def with_tiles(df: DataFrame, tile: tuple[int, ...]) -> DataFrame:
    """Adds tx (ty, tz): the tile of each element, the unit inside which predictors work."""
    for axis, size in zip("xyz", tile):
        df = df.withColumn(f"t{axis}", F.floor(F.col(axis) / size).cast("bigint"))
    return df


def tile_keys(tile: tuple[int, ...]) -> list[str]:
    return ["field_id", *[f"t{a}" for a, _ in zip("xyz", tile)]]


def frame_names(prefix: str, suffix: str, first: int, last: int, width: int = 5) -> list[str]:
    """prefix00001suffix, ... of a numbered sequence of files."""
    return [f"{prefix}{k:0{width}d}{suffix}" for k in range(first, last + 1)]


def random_field(spark: SparkSession, n: int, seed: int, normal: bool = False, name: str = "random") -> DataFrame:
    """Reproducible test data for a given partitioning."""
    v = F.randn(seed) if normal else F.rand(seed)
    return from_table(spark.range(n).withColumn("v", v), "id", "v", name=name)


def counted(few: DataFrame) -> tuple[DataFrame, bool]:
    """(few, whether it has MOST_SENT rows at most); if so it has been read and is a local table from now on."""
    rows = few.limit(MOST_SENT + 1).toArrow()
    small = rows.num_rows <= MOST_SENT
    return (few.sparkSession.createDataFrame(rows, few.schema) if small else few), small


def beside(df: DataFrame, few: DataFrame, on: tuple[str, ...] = ("field_id",), how: str = "inner") -> DataFrame:
    """df with the columns of few, which has few rows a field.

    few is counted by reading it: up to MOST_SENT rows go to every executor, so a
    large field is never dealt to one task by its name.  With more, fields are many
    and a shuffle by name spreads them.
    """
    few, small = counted(few)
    names = [F.col(c).alias(f"__on{k}") for k, c in enumerate(on)]
    few = few.select(*names, *[c for c in few.columns if c not in on])
    match = [F.col(c) == F.col(f"__on{k}") for k, c in enumerate(on)]
    return df.join(F.broadcast(few) if small else few, match, how).drop(*[f"__on{k}" for k in range(len(on))])


def value_range(field: DataFrame) -> DataFrame:
    """field_id, lo, hi, rng: one row a field."""
    return field.groupBy("field_id").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi")).withColumn("rng", F.col("hi") - F.col("lo"))


def with_error_bound(field: DataFrame, eb: float, mode: str = "rel") -> DataFrame:
    """Adds eb: as given (abs) or times the field's range (rel)."""
    if mode == "abs":
        return field.withColumn("eb", F.lit(float(eb)))
    if mode not in ("rel", "r2r"):
        raise ValueError(f"unknown error mode: {mode}")
    return beside(field, value_range(field).select("field_id", (F.lit(float(eb)) * F.col("rng")).alias("eb")))


def stride_index(lx: int, ly: int, x: Column, y: Column, z: Column) -> Column:
    return x + y * lx + z * lx * ly
