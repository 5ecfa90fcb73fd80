"""Element-wise functions on columns: quantizers, zigzag, reports.  All are plain Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prequantize(v: Column, eb: Column) -> Column:
    """Round half away from zero of v in units of twice the error bound."""
    return F.round(v.cast("double") * (1 / (2 * eb))).cast("bigint")


def prequantize_half_even(v: Column, eb: Column) -> Column:
    """The variant of numeric libraries that round halves to even."""
    return F.rint(v.cast("double") * (1 / (2 * eb))).cast("bigint")


def dequantize(q: Column, eb: Column) -> Column:
    return q.cast("double") * (2 * eb)


def is_quantizable(d: Column, radius: int) -> Column:
    return F.abs(d) < radius


def postquantize(d: Column, radius: int) -> Column:
    """Code in (0, 2 * radius); 0 marks an outlier."""
    return F.when(is_quantizable(d, radius), d + radius).otherwise(F.lit(0)).cast("int")


def zigzag(x: Column) -> Column:
    return F.when(x >= 0, 2 * x).otherwise(-2 * x - 1)


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 0, F.floor(z / 2)).otherwise(-F.floor((z + 1) / 2)).cast("bigint")


def postquantize_zigzag(d: Column, radius: int) -> Column:
    """Zigzag code; outliers get 0 as well and are told apart by the outlier list."""
    return F.when(is_quantizable(d, radius), zigzag(d)).otherwise(F.lit(0)).cast("int")


def fuse(code: Column, outlier: Column, radius: int) -> Column:
    """The delta from code and outlier value (null: none); outliers are stored as delta + radius."""
    return F.coalesce(outlier, F.lit(0)) + code - radius


def serial_quantize(error: Column, eb: Column, radius: int) -> Column:
    """The quantizer of predictors that read reconstructed neighbours."""
    return (F.floor((F.floor(F.abs(error) / eb) + 1) / 2) * F.signum(error)).cast("bigint") + radius


# predicates


def equals(x: Column, value) -> Column:
    return x == F.lit(value)


def in_ball(x: Column, radius: float) -> Column:
    return F.abs(x) < radius


def in_shifted_ball(x: Column, radius: float) -> Column:
    return (x >= 0) & (x < 2 * radius)


# preprocessing


def log_transform(v: Column) -> Column:
    return F.when(v > 0, F.ln(v))


def shifted_log(v: Column, shift: float) -> Column:
    return log_transform(v + shift)


def to_float32(v: Column) -> Column:
    return v.cast("float")


# reports


def compression_ratio(raw: Column, stored: Column) -> Column:
    return F.try_divide(raw.cast("double"), stored.cast("double"))


def bitrate(width_bits: int, ratio: Column) -> Column:
    """Bits an element; by the element's real width."""
    return F.try_divide(F.lit(float(width_bits)), ratio)


def throughput_gb(n_bytes: Column, ms: Column) -> Column:
    return F.try_divide(n_bytes.cast("double") / 1e9, ms / 1e3)


def psnr(value_range: Column, mse: Column) -> Column:
    return 20 * F.log10(F.nullif(value_range, F.lit(0.0))) - 10 * F.log10(F.nullif(mse, F.lit(0.0)))


def register_sql(spark) -> None:
    """zigzag, unzigzag, prequantize and dequantize as SQL functions that Catalyst inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION zigzag(x BIGINT) RETURNS BIGINT RETURN CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION unzigzag(z BIGINT) RETURNS BIGINT RETURN CASE WHEN z % 2 = 0 THEN z DIV 2 ELSE -((z + 1) DIV 2) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION prequantize(v DOUBLE, eb DOUBLE) RETURNS BIGINT RETURN CAST(round(v * (1 / (2 * eb))) AS BIGINT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dequantize(q BIGINT, eb DOUBLE) RETURNS DOUBLE RETURN q * (2 * eb)")
