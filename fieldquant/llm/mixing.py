"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Each source has a target of words.  Among all document rates r with
sum(r * size) = target and 0 <= r <= CAP, those nearest to "every document once"
in relative entropy are r = min(CAP, exp(lambda * size)); lambda solves the
convex dual, one number a source.  Rates depend on source and size only, so the
Newton iterations run over the table of (source, size, count), not over the
documents.  All sums are of integers (rates in 1e-9), so reruns agree to the bit.

Rates become copies in two steps.  Sizes of a source are taken in bands (each up to
twice its least).  Within a band, running sums over the sizes, largest first, are
rounded, but for the band's CARRIERS most frequent sizes and its smallest: these
are gone through from the largest to the smallest over all bands, and each takes
what rounding has left so far.  So the error of a source ends at about half a small
document, by one law at any number of sizes.  Within a (source, size) class
the documents with the smallest hashes get the extra copy; classes are dealt
over BUCKETS hash buckets, and only the bucket in which the number is reached
needs a rank, so a class with a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Names, Scratch, word_count

CAP = 3
UNIT = 1_000_000_000
BUCKETS = 256
#: Sizes of a band (there are some 40 bands) that take what rounding leaves.
CARRIERS = 64
#: Classes that are sent to every executor; beyond it they are joined by shuffle.
BROADCAST_CLASSES = 200_000
_DEC = "decimal(38,0)"


def _sk(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(hist: DataFrame) -> DataFrame:
    """sk, total, docs, target, weight of each source; hist: sk, size, n.

    The weights 1, 2, 3 repeat over the sources by code point, null last.  A
    target above CAP times its source's size is cut there and the excess is
    shared by weight again until none is above; that fixed point is found by
    going through the sources by CAP * total / weight.  The two windows without
    a partition see one row a source.
    """
    per = hist.groupBy("sk").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("sk") == "n", "sk"))
    per = per.withColumn("weight", ((rank - 1) % 3 + 1).cast("bigint"))
    order = Window.orderBy((F.col("total") / F.col("weight")).asc(), "sk")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    per = per.withColumn("rest", F.sum("total").over(every) - CAP * F.coalesce(F.sum("total").over(before), zero))
    per = per.withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero))
    per = per.withColumn("cut", (CAP * F.col("total")).cast(_DEC) * F.col("weights").cast(_DEC) < F.col("rest").cast(_DEC) * F.col("weight").cast(_DEC))
    first = F.min(F.when(~F.col("cut"), F.struct(F.col("total") / F.col("weight"), F.col("sk"), F.col("rest").alias("rest"), F.col("weights").alias("weights")))).over(every)
    per = per.withColumn("first", first)
    level = F.col("first.rest").cast("double") * F.col("weight") / F.col("first.weights")
    target = F.when(F.col("cut"), (CAP * F.col("total")).cast("double")).otherwise(level)
    return per.select("sk", "total", "docs", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _rate(lam: Column, z: Column, full: Column) -> Column:
    return F.when(full, F.lit(float(CAP))).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(lam * z, F.lit(2.0)))))


def solve(hist: DataFrame, per: DataFrame, scratch: Scratch, most: int = 100) -> DataFrame:
    """sk, lam, scale, full of each source: Newton steps on the dual, halving where a step leaves its bracket.

    hist: sk, size, n with size > 0.  A source is solved within a quarter word or
    what rates in steps of 1e-9 can tell apart; RuntimeError if one isn't after
    `most` steps.
    """
    least = hist.groupBy("sk").agg(F.min("size").alias("least"))
    s = per.filter("total > 0").join(least, "sk")
    s = s.withColumn("scale", F.col("total") / F.col("docs")).withColumn("full", F.col("target") >= CAP * F.col("total"))
    z = F.col("least") / F.col("scale")
    up = F.col("target") > F.col("total")
    s = s.select(
        "sk", "target", "total", "scale", "full", F.lit(0.0).alias("lam"), F.col("full").alias("done"),
        F.when(up, F.lit(0.0)).otherwise(F.ln(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("total")) / z).alias("lo"),
        F.when(up, F.ln(F.lit(float(CAP))) / z).otherwise(F.lit(0.0)).alias("hi"),
    )
    state = scratch.write(s.coalesce(1), "dual")
    for _ in range(most):
        z = F.col("size") / F.col("scale")
        r = F.round(_rate(F.col("lam"), z, F.col("full")) * UNIT).cast("bigint")
        words = (F.col("n") * F.col("size")).cast(_DEC)
        slope = F.when(r < CAP * UNIT, words * F.round(z * r).cast(_DEC)).otherwise(F.lit(0).cast(_DEC))
        keys = ["sk", "target", "total", "scale", "full", "lam", "done", "lo", "hi"]
        g = hist.join(state, "sk").groupBy(*keys).agg(F.sum(words * r.cast(_DEC)).cast("double").alias("h"), F.sum(slope).cast("double").alias("d"))
        off = F.col("h") / UNIT - F.col("target")
        done = F.col("done") | (F.abs(off) <= F.greatest(F.lit(0.25), F.greatest("target", "total") * 1e-9))
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        g = g.withColumn("off", off).withColumn("now", done).withColumn("lo2", lo).withColumn("hi2", hi)
        step = F.col("lam") - F.try_divide(F.col("off"), F.col("d") / UNIT)
        inside = step.isNotNull() & (step > F.col("lo2")) & (step < F.col("hi2"))
        lam = F.when(F.col("now"), F.col("lam")).when(inside, step).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        new = scratch.write(g.select("sk", "target", "total", "scale", "full", lam.alias("lam"), F.col("now").alias("done"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi")).coalesce(1), "dual")
        scratch.drop(state)
        state = new
        if not state.filter(~F.col("done")).take(1):
            return state
    raise RuntimeError(f"the dual of a source isn't solved after {most} steps")


def rounded(c: DataFrame) -> DataFrame:
    """c (sk, size, n, base, want: copies of a class beyond base for each document) with whole extra copies of each class."""
    c = c.withColumn("band", F.length(F.bin("size")))
    band = Window.partitionBy("sk", "band")
    down = band.orderBy(F.col("size").desc())
    carries = (F.row_number().over(band.orderBy(F.col("n").desc(), "size")) <= CARRIERS) | (F.row_number().over(band.orderBy("size")) == 1)
    c = c.withColumn("carries", carries).withColumn("plain", F.when(F.col("carries"), F.lit(0.0)).otherwise(F.col("want")))
    c = c.withColumn("to", F.floor(F.sum("plain").over(down.rowsBetween(Window.unboundedPreceding, 0)) + 0.5))
    c = c.withColumn("extra", F.col("to") - F.coalesce(F.lag("to").over(down), F.lit(0)))
    c = c.withColumn("extra", F.when(F.col("carries"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least("extra", "n"))).cast("bigint"))
    c = c.withColumn("off", (F.col("size") * (F.col("plain") - F.col("extra"))).cast("decimal(38,6)"))
    one = F.when(F.col("carries"), F.struct("size", "n", "base", "want"))
    bands = c.groupBy("sk", "band").agg(F.sum("off").cast("double").alias("off"), F.collect_list(one).alias("of"))
    bands = bands.groupBy("sk").agg(F.sort_array(F.collect_list(F.struct("band", "off", F.sort_array("of", asc=False).alias("of"))), asc=False).alias("all"))
    none = F.expr("array()").cast("array<struct<size:bigint,more:bigint>>")

    def take(acc: Column, x: Column) -> Column:
        size, n = x["size"], x["n"]
        more = F.greatest(-x["base"] * n, F.least((CAP - x["base"]) * n, F.round(x["want"] + acc["carry"] / size).cast("bigint")))
        return F.struct((acc["carry"] + size * (x["want"] - more)).alias("carry"), F.concat(acc["out"], F.array(F.struct(size.alias("size"), more.alias("more")))).alias("out"))

    def through(acc: Column, x: Column) -> Column:
        return F.aggregate(x["of"], F.struct((acc["carry"] + x["off"]).alias("carry"), acc["out"].alias("out")), take)

    moved = bands.select("sk", F.inline(F.aggregate("all", F.struct(F.lit(0.0).alias("carry"), none.alias("out")), through, lambda a: a["out"])))
    c = c.join(moved, ["sk", "size"], "left").withColumn("extra", F.col("extra") + F.coalesce("more", F.lit(0)))
    # beyond one copy a document, all documents get whole copies more or fewer
    all_ = F.col("base") * F.col("n") + F.col("extra")
    c = c.withColumn("all", all_).withColumn("base", F.floor(F.col("all") / F.col("n")).cast("bigint"))
    return c.select("sk", "size", "n", "base", (F.col("all") - F.col("base") * F.col("n")).cast("bigint").alias("extra"))


def classes(sizes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(classes, sources) of doc_id, source, __m_size: for each (sk, size) the copies of every document (base), the
    bucket up to which they get one more (upto), how many do in bucket upto (rest); for each sk total and target."""
    bucketed = sizes.groupBy(_sk(F.col("source")).alias("sk"), F.col("__m_size").alias("size"), _bucket().alias("bucket")).agg(F.count("*").alias("n"))
    bucketed = scratch.write(bucketed, "buckets", narrow=True)
    hist = scratch.write(bucketed.groupBy("sk", "size").agg(F.sum("n").alias("n")), "sizes-by-source", narrow=True)
    per = scratch.write(targets(hist).coalesce(1), "targets")
    bucketed, hist = bucketed.filter("size > 0"), hist.filter("size > 0")
    dual = solve(hist, per, scratch)

    r = _rate(F.col("lam"), F.col("size") / F.col("scale"), F.col("full"))
    c = hist.join(dual.drop("total", "target"), "sk").withColumn("r", F.round(r * UNIT) / UNIT)
    c = c.withColumn("base", F.floor("r")).withColumn("want", F.col("n") * (F.col("r") - F.col("base")))
    copies = rounded(c.select("sk", "size", "n", "base", "want"))

    b = bucketed.select("sk", "size", "bucket", F.col("n").alias("m"))
    b = b.withColumn("upper", F.sum("m").over(Window.partitionBy("sk", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    hit = copies.filter("extra > 0 and extra < n").join(b, ["sk", "size"]).filter("upper >= extra")
    hit = hit.groupBy("sk", "size", "extra").agg(F.min(F.struct("bucket", (F.col("upper") - F.col("m")).alias("under"))).alias("x"))
    hit = hit.select("sk", "size", F.col("x.bucket").alias("upto"), (F.col("extra") - F.col("x.under")).alias("rest"))
    out = copies.join(hit, ["sk", "size"], "left")
    # all or none of a class: a bucket before the first or after the last
    upto = F.coalesce("upto", F.when(F.col("extra") > 0, F.lit(BUCKETS)).otherwise(F.lit(-1)))
    out = out.select("sk", F.col("size").alias("__m_s"), "base", upto.cast("int").alias("upto"), F.coalesce("rest", F.lit(0)).cast("bigint").alias("rest"))
    return scratch.write(out, "classes", narrow=True), per


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("__m_size"))


def _hash() -> Column:
    return F.xxhash64(F.lit("mix"), F.col("doc_id"))


def _bucket() -> Column:
    return F.pmod(_hash(), F.lit(BUCKETS)).cast("int")


def with_copies(docs: DataFrame, cls: DataFrame) -> DataFrame:
    """docs (with __m_size) and __m_copies; only rows of a class's last bucket are ranked."""
    small = cls.count() <= BROADCAST_CLASSES
    c = cls.withColumnRenamed("sk", "__m_sk2").withColumnRenamed("base", "__m_base").withColumnRenamed("upto", "__m_upto").withColumnRenamed("rest", "__m_rest")
    d = docs.withColumn("__m_sk", _sk(F.col("source")))
    d = d.join(F.broadcast(c) if small else c, (F.col("__m_sk") == F.col("__m_sk2")) & (F.col("__m_size") == F.col("__m_s")), "left")
    d = d.withColumn("__m_bucket", _bucket())
    at = F.coalesce(F.col("__m_bucket") == F.col("__m_upto"), F.lit(False))
    clear = d.filter(~at).withColumn("__m_copies", F.coalesce(F.col("__m_base") + (F.col("__m_bucket") < F.col("__m_upto")).cast("bigint"), F.lit(0).cast("bigint")))
    rank = F.row_number().over(Window.partitionBy("__m_sk", "__m_size").orderBy(_hash(), "doc_id"))
    ranked = d.filter(at).withColumn("__m_copies", F.col("__m_base") + (rank <= F.col("__m_rest")).cast("bigint"))
    return clear.unionByName(ranked)


def mix(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (and copies) of every row of docs.

    Null text or none: size 0, never taken.  Null sources are a source.  Rows of
    one doc_id are taken each by themselves; an empty table gives an empty one;
    further columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    sizes = scratch.write(sized(docs), "sizes")
    cls, per = classes(sizes, scratch)
    per = per.select(F.col("sk").alias("__m_sk3"), "total", "target")
    out = with_copies(sizes, cls).join(per, F.col("__m_sk") == F.col("__m_sk3"), "left")
    return out.select("doc_id", F.col("__m_size").alias("size"), F.col("total").alias("source_size"), "target", (F.col("__m_size") * F.col("__m_copies")).alias("taken"), F.col("__m_copies").alias("copies"))


def mixed(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with docs' columns."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    names = Names(docs)
    cls, _ = classes(sized(docs), scratch)
    out = with_copies(names.docs.withColumn("__m_size", word_count(F.col("text"))), cls).filter("__m_copies > 0")
    return names.back(out.withColumn("__m_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__m_copies")))))
