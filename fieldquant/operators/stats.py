"""Statistics and quality of fields: one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import quant
from ..sources.fields import beside

TOLERANCE = 1.001


def extrema(df: DataFrame) -> DataFrame:
    g = df.groupBy("field_id").agg(F.count("*").alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("avg_v"))
    return g.withColumn("range_v", F.col("max_v") - F.col("min_v"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(field_id, i, o, x) of two versions of a field."""
    l, r = a.select("field_id", "i", F.col("v").alias("o")), b.select(F.col("field_id").alias("__f"), F.col("i").alias("__i"), F.col("v").alias("x"))
    return l.join(r, (F.col("field_id") == F.col("__f")) & (F.col("i") == F.col("__i"))).drop("__f", "__i")


def assess(p: DataFrame) -> DataFrame:
    """Quality of x against o: ranges, MSE, PSNR, NRMSE, correlation, largest errors."""
    e = F.col("o") - F.col("x")
    g = p.groupBy("field_id").agg(
        F.count("*").alias("n"), F.min("o").alias("min_o"), F.max("o").alias("max_o"), F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.avg(e * e).alias("mse"), F.corr("o", "x").alias("coeff"), F.stddev_pop("o").alias("std_o"), F.stddev_pop("x").alias("std_x"),
        F.max(F.abs(e)).alias("max_abs_err"), F.max(F.try_divide(F.abs(e), F.nullif(F.abs("o"), F.lit(0.0)))).alias("max_pwrrel_err"),
    )
    rng = F.col("max_o") - F.col("min_o")
    return g.withColumn("psnr", quant.psnr(rng, F.col("mse"))).withColumn("nrmse", F.try_divide(F.sqrt("mse"), rng)).withColumn("max_rel_err", F.try_divide(F.col("max_abs_err"), rng))


def error_sums(p: DataFrame) -> DataFrame:
    """Sums of co-deviation, squared error and squared deviations."""
    n = F.count("*")
    return p.groupBy("field_id").agg((F.covar_pop("o", "x") * n).alias("sum_corr"), F.sum(F.pow(F.col("o") - F.col("x"), 2)).alias("sum_err_sq"), (F.var_pop("o") * n).alias("sum_var_o"), (F.var_pop("x") * n).alias("sum_var_x"))


def max_error(p: DataFrame) -> DataFrame:
    """The largest error and its first place."""
    best = F.max(F.struct(F.abs(F.col("o") - F.col("x")).alias("e"), (-F.col("i")).alias("j"))).alias("b")
    return p.groupBy("field_id").agg(best).select("field_id", F.col("b.e").alias("max_err"), (-F.col("b.j")).alias("i"))


def error_bounded(p: DataFrame, eb) -> DataFrame:
    """First place with an error beyond the tolerated bound; eb: a column or number."""
    eb = eb if hasattr(eb, "alias") else F.lit(float(eb))
    g = p.groupBy("field_id").agg(F.min(F.when(F.abs(F.col("o") - F.col("x")) > TOLERANCE * eb, F.col("i"))).alias("first_violation"))
    return g.withColumn("bounded", F.col("first_violation").isNull())


def identical(p: DataFrame) -> DataFrame:
    return p.groupBy("field_id").agg(F.bool_and(F.col("o").eqNullSafe(F.col("x"))).alias("identical"))


def autocorrelation(df: DataFrame, lags: tuple[int, ...] = (1, 2)) -> DataFrame:
    """corr(v[i], v[i + k]); pairs meet by an equi-join on i + k, so no field is in one window."""
    out = None
    for k in lags:
        a = df.select("field_id", F.col("i").alias("i"), F.col("v").alias("o"))
        b = df.select(F.col("field_id").alias("__f"), (F.col("i") - k).alias("__i"), F.col("v").alias("x"))
        one = a.join(b, (F.col("field_id") == F.col("__f")) & (F.col("i") == F.col("__i"))).groupBy("field_id").agg(F.corr("o", "x").alias("coeff")).withColumn("lag", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select("field_id", "lag", "coeff")


def value_histogram(df: DataFrame, bins: int = 16, log: bool = False, zoom: tuple[float, float] | None = None) -> DataFrame:
    """Counts of equal bins between each field's extrema, or between zoom's (values outside are left out); empty bins have
    no row.  log: of log10 |v|, zeros left out."""
    if log:
        df = df.filter("v <> 0").withColumn("v", F.log10(F.abs("v")))
    if zoom:
        df = df.filter(F.col("v").between(*map(float, zoom)))
    d = beside(df, df.groupBy("field_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    b = F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col("v") - F.col("lo")) * bins, F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))))
    return d.groupBy("field_id", F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("freq"))


#: Rank error of the sketches that bracket a percentile, as a share of a field.
BRACKET = 1e-3


def percentiles(df: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """Exact percentiles by rank.

    Mergeable sketches bracket each percentile; values below a bracket are
    counted, and only those inside, some hundredths of a field at most, are ranked.
    """
    deep = int(2 / BRACKET)
    v = F.col("v").cast("double")
    ends = [(max(0.0, s - 2 * BRACKET), min(1.0, s + 2 * BRACKET)) for s in shares]
    sketch = df.groupBy("field_id").agg(F.percentile_approx(v, [x for e in ends for x in e], deep).alias("q"), F.count("v").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))
    brackets = F.array(*[
        F.struct(F.lit(k).alias("k"), (F.col("least") if e[0] == 0 else F.col("q")[2 * k]).alias("lo"), (F.col("most") if e[1] == 1 else F.col("q")[2 * k + 1]).alias("hi"))
        for k, e in enumerate(ends)
    ])
    each = beside(df.select("field_id", v.alias("v")), sketch.select("field_id", "n", brackets.alias("b"))).select("field_id", "v", "n", F.explode("b").alias("b"))
    each = each.filter(F.col("v") <= F.col("b.hi"))
    below = F.col("v") < F.col("b.lo")
    # all that is below a bracket is one row of it
    c = each.groupBy("field_id", "n", F.col("b.k").alias("k"), F.when(~below, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("field_id", "k").orderBy(F.col("v").asc_nulls_first())
    c = c.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("v is not null")
    kind = df.schema["v"].dataType
    return c.groupBy("field_id").agg(*[F.min(F.when((F.col("k") == k) & (F.col("upto") >= F.ceil(F.col("n") * s)), F.col("v"))).cast(kind).alias(f"p{round(100 * s)}") for k, s in enumerate(shares)])


def report(header: DataFrame) -> DataFrame:
    """Sizes of an archive's parts; header: field_id, raw_bytes, and bytes of parts."""
    parts = [c for c in header.columns if c.endswith("_bytes") and c != "raw_bytes"]
    total = sum((F.col(c) for c in parts), F.lit(0))
    return header.withColumn("total_bytes", total).withColumn("ratio", quant.compression_ratio(F.col("raw_bytes"), F.col("total_bytes")))
