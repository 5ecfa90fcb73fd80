"""Quality rules by robust multivariate outliers.

Every text gets a few counts; transformed, they are points of four dimensions.
For each language and source a minimum-covariance-determinant estimate is found
by concentration steps over *all* documents of the group: distances from the
present estimate, the exact quantile of their (rounded) values, then mean and
covariance of the nearer part.  A document is rejected if its Mahalanobis
distance from the final estimate is beyond ``CUTOFF``.

Coordinates are integers (a grid of 1/256), so all sums are exact whatever the
order in which tasks end.  Groups of fewer than ``LEAST`` documents are pooled by
language, those of small languages together, and if these are still too few they
are judged by the whole corpus.  An estimate from few documents is less sure, so
its cutoff is that of the F distribution with their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Names, Scratch, filled, mix64, one_array, resting, ship, slices, words_of

#: Documents for an estimate of a group's own: with fewer, the cutoff (74 at 40, 241 at 20) would let junk pass.
LEAST = 40
#: Tables of one row a group are broadcast up to this many groups, and joined by shuffle beyond.
BROADCAST_GROUPS = 20_000
STEPS = 4
SHARE = 0.75
#: chi-square of 4 degrees of freedom: beyond it one of 1e6 (RARE) normal points.
CUTOFF, RARE = 33.4, 1e-6
MEDIAN = 3.3567  # of the same distribution
GRID = 256
#: Least standard deviation of each coordinate: what is the same in most documents is no reason to reject.
FLOOR = (0.08, 0.08, 0.10, 0.10)
D = 4
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
X = [f"__x{i}" for i in range(D)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def text_counts(text: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text; null: all 0."""
    text = filled(text)
    n = len(text)
    bounds, codes, words = words_of(text)
    n_words = np.diff(bounds)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(chars[codes])])
    word_chars = sums[bounds[1:]] - sums[bounds[:-1]]

    raw = text.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    sums = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    n_symbols = sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]

    lines = pc.split_pattern(text, "\n")
    flat = lines.flatten()
    per = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), per)
    full = np.flatnonzero(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False))
    coded = flat.take(pa.array(full)).dictionary_encode()
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.unique(owner[full] * (len(coded.dictionary) + 1) + line)
    n_lines = np.bincount(owner[full], minlength=n)
    n_dup_lines = n_lines - np.bincount(key // (len(coded.dictionary) + 1), minlength=n)

    n_repeat = np.zeros(n, np.int64)
    m = len(codes) - 4
    if m > 0:
        owner = np.repeat(np.arange(n), n_words)
        inside = np.flatnonzero(owner[:m] == owner[4:])
        h = mix64(owner[inside].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k in range(5):
            h = mix64(h ^ (codes[inside + k].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = inside[order[twice]]
        step = np.zeros(len(codes) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + 5, -1)
        n_repeat = np.bincount(owner[np.cumsum(step)[:-1] > 0], minlength=n)
    return dict(zip(COUNTS, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines)))


def _coordinates(c: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Short texts are drawn towards the middle (20 words of 6 characters), so chance alone moves them little."""
    n = c["n_words"].astype(float)
    x = (
        np.log((c["word_chars"] + 120.0) / (n + 20)),
        np.sqrt(c["n_symbols"] / (n + 20)),
        c["n_dup_lines"] / (c["n_lines"] + 5.0),
        c["n_repeat_words"] / (n + 20),
    )
    return [np.rint(v * GRID).astype(np.int64) for v in x]


def with_counts(docs: DataFrame, prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """docs with the counts (named prefix + name) and the coordinates; a map over whole texts."""
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    drop_text = "text" not in keep

    def run(batches):
        for big in batches:
            for b in slices(big):
                c = text_counts(one_array(b.column("text")))
                old = [b.column(k) for k, n in enumerate(b.schema.names) if not (drop_text and n == "text")]
                old_names = [n for n in b.schema.names if not (drop_text and n == "text")]
                new = [pa.array(c[k], pa.int64()) for k in COUNTS] + [pa.array(v, pa.int64()) for v in _coordinates(c)]
                yield pa.RecordBatch.from_arrays(old + new, names=old_names + [prefix + k for k in COUNTS] + X)

    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if not (drop_text and f.name == "text")]
    return src.mapInArrow(resting(run), ", ".join(fields + [f"`{prefix}{k}` bigint" for k in COUNTS] + [f"{x} bigint" for x in X]))


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    return (n < 10) | (100 * r > 20 * n)


def _key(*cols: Column) -> Column:
    """One string for several columns with nulls."""
    return F.concat_ws("|", *[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in cols])


def _sent(few: DataFrame, like: DataFrame) -> DataFrame:
    """few, to be broadcast if like (a written table with at least as many rows) is small."""
    return F.broadcast(few) if like.count() <= BROADCAST_GROUPS else few


def _distance(stats: DataFrame, params: DataFrame, groups: DataFrame) -> DataFrame:
    """stats with the squared distance d2 of each row from its group's estimate; null without one."""
    p = params.withColumnRenamed("gk", "__pk")
    joined = stats.join(_sent(p, groups), stats["gk"] == p["__pk"], "left").drop("__pk")
    z = [F.col(X[i]) / float(GRID) - F.col(f"m{i}") for i in range(D)]
    d2 = sum((z[i] * z[j] * F.col(f"a{i}{j}") * (1.0 if i == j else 2.0) for i, j in PAIRS), F.lit(0.0))
    return joined.withColumn("d2", F.greatest(d2, F.lit(0.0))).drop("n", *[f"m{i}" for i in range(D)], *[f"a{i}{j}" for i, j in PAIRS])


def cutoff(n: int) -> float:
    """The squared distance beyond which one of 1 / RARE points lies if the estimate comes from SHARE of n points.

    (m + 1)(m - 1) D / (m (m - D)) times the quantile of the F distribution of D = 4 and m - D degrees of freedom, whose
    tail is a polynomial; infinite if there are no degrees of freedom.
    """
    m = int(np.ceil(SHARE * n))
    v = m - D
    if v <= 0:
        return float("inf")
    lo, hi = 0.0, 1.0

    def tail(x: float) -> float:
        u = v / (v + D * x)
        return u ** (v / 2) * (1 + v / 2 * (1 - u))

    while tail(hi) > RARE and hi < 1e300:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > RARE else (lo, mid)
    return max(CUTOFF, (m + 1) * (m - 1) * D / (m * (m - D)) * hi)


_PARAMS = "gk string, n bigint, " + ", ".join([f"m{i} double" for i in range(D)] + [f"a{i}{j} double" for i, j in PAIRS])


def _bin(d2: Column) -> Column:
    return F.floor(F.log1p(F.least(d2, F.lit(1e9))) * 128).cast("int")


def _invert(moments: DataFrame) -> DataFrame:
    """Estimates from the sums of each group: one row a group."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n = float(r["n"])
                m = np.array([float(r[f"s{i}"]) / n for i in range(D)])
                cov = np.zeros((D, D))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = float(r[f"s{i}{j}"]) / n - m[i] * m[j]
                cov /= GRID**2
                cov += np.diag(np.square(FLOOR))
                a = np.linalg.inv(cov)
                out.append({"gk": r["gk"], "n": r["n"]} | {f"m{i}": m[i] / GRID for i in range(D)} | {f"a{i}{j}": a[i, j] for i, j in PAIRS})
            yield _rows(out)

    return moments.mapInArrow(resting(run), _PARAMS)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _PARAMS.split(", ")]))


def _strict(params: DataFrame) -> DataFrame:
    """Estimates whose distances are held against CUTOFF, whatever the number of a group's documents."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k = CUTOFF / cutoff(r["n"])
                out.append(r | {f"a{i}{j}": r[f"a{i}{j}"] * k for i, j in PAIRS})
            yield _rows(out)

    return params.mapInArrow(resting(run), _PARAMS)


def _start(members: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Coordinate-wise medians and median absolute deviations."""
    med = members.groupBy("gk").agg(*[F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(X)])
    med = scratch.write(med, "medians", narrow=True)
    away = members.join(_sent(med.withColumnRenamed("gk", "__pk"), groups), F.col("gk") == F.col("__pk"))
    mad = away.groupBy("gk", *[f"m{i}" for i in range(D)]).agg(*[F.percentile(F.abs(F.col(x) - F.col(f"m{i}")), F.lit(0.5)).alias(f"d{i}") for i, x in enumerate(X)])
    cols = [(F.col(f"m{i}") / GRID).alias(f"m{i}") for i in range(D)]
    inv = [(1.0 / (F.pow(F.col(f"d{i}") * 1.4826 / GRID, 2) + FLOOR[i] ** 2) if i == j else F.lit(0.0)).alias(f"a{i}{j}") for i, j in PAIRS]
    return mad.select("gk", F.lit(0).cast("bigint").alias("n"), *cols, *inv)


def grouped(stats: DataFrame, prefix: str = "") -> DataFrame:
    """The group of each (lang, source): own, pooled by language, pooled further, or the whole corpus ('w')."""
    good = stats.filter(~base_failed(prefix))
    c = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") < LEAST, F.col("n")).otherwise(0)
    c = c.withColumn("nl", F.sum(small).over(Window.partitionBy("lang")))
    rest = c.filter((F.col("n") < LEAST) & (F.col("nl") < LEAST)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    gk = (
        F.when(F.col("n") >= LEAST, F.concat(F.lit("s"), _key(F.col("lang"), F.col("source"))))
        .when(F.col("nl") >= LEAST, F.concat(F.lit("l"), _key(F.col("lang"))))
        .otherwise(F.lit("r" if rest >= LEAST else "w"))
    )
    return c.select(_key(F.col("lang"), F.col("source")).alias("__k"), gk.alias("gk"))


def fit(stats: DataFrame, scratch: Scratch, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(groups, params) of a table with lang, source, counts and coordinates."""
    write = lambda df, name: scratch.write(df, name, narrow=True)  # noqa: E731  one row a group each
    groups = write(grouped(stats, prefix), "groups")
    members = with_group(stats.filter(~base_failed(prefix)), groups).select("gk", *X)
    if groups.filter("gk = 'w'").take(1):  # all documents are members of it
        members = members.filter("gk <> 'w'").unionByName(members.withColumn("gk", F.lit("w")))
    params = write(_start(members, groups, scratch), "start")
    for _ in range(STEPS):
        near = _distance(members, params, groups).withColumn("b", _bin(F.col("d2")))
        # the quantile's own bin belongs to the nearer part: at least SHARE of the group
        edge = near.groupBy("gk").agg(F.ceil(F.percentile("b", F.lit(SHARE))).alias("edge"))
        edge = write(edge, "edges")  # one row a group, of known size: the members aren't dealt by group to meet it
        part = near.join(_sent(edge.withColumnRenamed("gk", "__pk"), groups), F.col("gk") == F.col("__pk")).filter(F.col("b") <= F.col("edge"))
        sums = part.groupBy("gk").agg(
            F.count("*").alias("n"),
            *[F.sum(X[i]).alias(f"s{i}") for i in range(D)],
            *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS],
        )
        params = write(_invert(sums), "params")
    # made consistent: the median distance is that of the normal distribution, never less strict than the floor allows
    mid = _distance(members, params, groups).groupBy("gk").agg(F.percentile(_bin(F.col("d2")), F.lit(0.5)).alias("b"), F.count("*").alias("size"))
    scale = F.greatest(F.lit(1.0), F.expm1((F.col("b") + 1) / 128.0) / MEDIAN)
    p = params.join(mid.withColumnRenamed("gk", "__pk"), F.col("gk") == F.col("__pk"))
    p = p.select("gk", F.col("size").alias("n"), *[f"m{i}" for i in range(D)], *[(F.col(f"a{i}{j}") / scale).alias(f"a{i}{j}") for i, j in PAIRS])
    return groups, write(_strict(p), "final")


def with_group(stats: DataFrame, groups: DataFrame) -> DataFrame:
    k = _key(F.col("lang"), F.col("source"))
    return stats.withColumn("__k0", k).join(_sent(groups, groups), F.col("__k0") == F.col("__k"), "left").drop("__k", "__k0")


def judged(stats: DataFrame, groups: DataFrame, params: DataFrame, prefix: str = "", kept: str = "kept") -> DataFrame:
    """stats with base_failed, distance (d2; null: no estimate) and the verdict."""
    out = _distance(with_group(stats, groups), params, groups)
    bad = base_failed(prefix)
    return out.withColumn(f"{prefix}base_failed", bad).withColumn(kept, ~bad & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF))


def verdicts(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept (and distance2) of every row of docs.

    Null text: no words, so base_failed.  Null lang or source: groups of their
    own.  A corpus of fewer than 6 documents rejects none beyond the base rules.
    Repeated rows stay repeated and count each time; an empty table gives
    an empty one; further columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    stats = scratch.write(with_counts(docs, keep=["doc_id", "lang", "source"]), "stats")
    groups, params = fit(stats, scratch)
    out = judged(stats, groups, params)
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", F.col("d2").alias("distance2"))


def accepted(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs that are kept, with docs' columns.

    The estimates are fitted on a narrow table of counts; texts are read again
    for the verdict and never shuffled.  Further columns travel under other
    names, so none can clash with the operator's own.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    names = Names(docs)
    stats = scratch.write(with_counts(names.docs, prefix="__q_", keep=["lang", "source"]), "stats")
    groups, params = fit(stats, scratch, prefix="__q_")
    out = judged(with_counts(names.docs, prefix="__q_"), groups, params, prefix="__q_", kept="__q_kept")
    return names.back(out.filter("__q_kept"))
