"""Registered queries of the field engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import quant
from .operators import extras, fz, hist, huffman, predict, rle, serial, sparse, spline, stats
from .plans import pipeline
from .plans.pipeline import Config
from .sources import fields
from .sources.fields import Shape

R = 512
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ fields


def events(spark, sf):
    return fields.from_table(_t(spark, sf, "events"), "event_id", "value", name="events")


def part(spark, sf):
    return fields.from_table(_t(spark, sf, "part"), "p_partkey", "p_retailprice", name="part")


def orders(spark, sf):
    # the length in z follows from the index, whatever a shape of three dimensions says
    return fields.from_table(_t(spark, sf, "orders"), "o_orderkey", "o_totalprice", Shape(16, 16, 2), name="orders")


def embeddings(spark, sf):
    return fields.from_arrays(_t(spark, sf, "embeddings"), "vec_id", "embedding", 64, name="embeddings")


def by_user(spark, sf):
    return fields.many(_t(spark, sf, "events"), "user_id", "event_id", "value")


F_EVENTS = "SELECT 'events' AS field_id, event_id AS i, event_id AS x, 0 AS y, 0 AS z, value AS v FROM events"
F_PART = "SELECT 'part' AS field_id, p_partkey AS i, p_partkey AS x, 0 AS y, 0 AS z, p_retailprice AS v FROM part"
F_ORDERS = "SELECT 'orders' AS field_id, o_orderkey AS i, o_orderkey % 16 AS x, (o_orderkey // 16) % 16 AS y, o_orderkey // 256 AS z, o_totalprice AS v FROM orders"
F_EMB = "SELECT 'embeddings' AS field_id, vec_id * 64 + k AS i, k AS x, vec_id AS y, 0 AS z, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"
F_USER = "SELECT CAST(user_id AS VARCHAR) AS field_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS x, 0 AS y, 0 AS z, value AS v FROM events"


def _with(field: str, eb: float) -> str:
    """WITH f, r, q: field, ranges, prequantized."""
    return f"""WITH f AS ({field}), r AS (SELECT field_id, {eb!r} * (max(v) - min(v)) AS eb FROM f GROUP BY field_id),
q AS (SELECT f.*, CASE WHEN eb > 0 THEN eb ELSE 1e-12 END AS eb, CAST(round(v * (1 / (2 * (CASE WHEN eb > 0 THEN eb ELSE 1e-12 END)))) AS BIGINT) AS q FROM f JOIN r USING (field_id))"""


def _delta(field: str, eb: float, tile: tuple[int, ...]) -> str:
    """WITH ... p: deltas and codes."""
    tiles = ", ".join(f"{a} // {s}" for a, s in zip("xyz", tile))
    out, prev, col = _with(field, eb), "q", "q"
    for k in range(len(tile)):
        other = "".join(f", {a}" for j, a in enumerate("xyz"[: len(tile)]) if j != k)
        out += f",\nd{k} AS (SELECT *, {col} - coalesce(lag({col}) OVER (PARTITION BY field_id, {tiles}{other} ORDER BY {'xyz'[k]}), 0) AS e{k} FROM {prev})"
        prev, col = f"d{k}", f"e{k}"
    return out + f",\np AS (SELECT *, {col} AS d, CAST(CASE WHEN abs({col}) < {R} THEN {col} + {R} ELSE 0 END AS INTEGER) AS code FROM {prev})"


def _p(field: DataFrame, eb: float, ndim: int, predictor: str = "lorenzo", zigzag: bool = False) -> DataFrame:
    return pipeline.predicted(field, Config(eb, "rel", R, ndim, predictor, zigzag))


CODES = "SELECT field_id, i, d, code FROM p"
ONE, TWO, THREE = predict.PRODUCTION[1], predict.PRODUCTION[2], predict.PRODUCTION[3]

# ------------------------------------------------------------------ element-wise


@query(_with(F_EVENTS, 1e-3) + " SELECT field_id, i, q FROM q")
def prequant(spark, sf):
    f = fields.with_error_bound(events(spark, sf), 1e-3)
    return f.select("field_id", "i", quant.prequantize(F.col("v"), F.col("eb")).alias("q"))


@query(_with(F_EVENTS, 1e-3) + " SELECT field_id, count(*) AS n, round(max(abs(v - q * (2 * eb)) / eb), 6) AS worst, count(*) FILTER (abs(v - q * (2 * eb)) > 1.001 * eb) AS violations FROM q GROUP BY field_id")
def dequant_error(spark, sf):
    f = fields.with_error_bound(events(spark, sf), 1e-3)
    e = F.abs(F.col("v") - quant.dequantize(quant.prequantize(F.col("v"), F.col("eb")), F.col("eb")))
    return f.groupBy("field_id").agg(F.count("*").alias("n"), F.round(F.max(e / F.col("eb")), 6).alias("worst"), F.count_if(e > stats.TOLERANCE * F.col("eb")).alias("violations"))


@query(_delta(F_EVENTS, 1e-3, ONE) + " SELECT field_id, i, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS zz FROM p")
def zigzag(spark, sf):
    return _p(events(spark, sf), 1e-3, 1).select("field_id", "i", quant.zigzag(F.col("d")).alias("zz"))


@query(_delta(F_EVENTS, 1e-3, ONE) + " SELECT field_id, i, d, d AS back FROM p")
def zigzag_roundtrip(spark, sf):
    return _p(events(spark, sf), 1e-3, 1).select("field_id", "i", "d", quant.unzigzag(quant.zigzag(F.col("d"))).alias("back"))


@query("WITH f AS (" + F_PART + ") SELECT field_id, i, round(ln(v), 9) AS log_v, round(ln(v + 1.0), 9) AS shifted, CASE WHEN v < 100.0 AND v > -100.0 THEN true ELSE false END AS near FROM f")
def preprocess_log(spark, sf):
    return part(spark, sf).select("field_id", "i", F.round(quant.log_transform(F.col("v")), 9).alias("log_v"), F.round(quant.shifted_log(F.col("v"), 1.0), 9).alias("shifted"), quant.in_ball(F.col("v"), 100.0).alias("near"))


@query(_with(F_EVENTS, 1e-2) + " SELECT field_id, i, CAST(round_even(v * (1 / (2 * eb)), 0) AS BIGINT) AS q FROM q")
def prequant_half_even(spark, sf):
    f = fields.with_error_bound(events(spark, sf), 1e-2)
    return f.select("field_id", "i", quant.prequantize_half_even(F.col("v"), F.col("eb")).alias("q"))


_BITS = "WITH f AS (" + F_PART + "), e AS (SELECT i, CAST(CAST(v AS FLOAT) AS DOUBLE) AS d, floor(log2(CAST(v AS FLOAT))) AS e FROM f), u AS (SELECT i, CAST((e + 127) * 8388608 + round((d / pow(2, e) - 1) * 8388608) AS BIGINT) AS u FROM e) "


@query(_BITS + "SELECT i, u & 255 AS b0, (u >> 8) & 255 AS b1, (u >> 16) & 255 AS b2, (u >> 24) & 255 AS b3 FROM u")
def byte_planes(spark, sf):
    return extras.bits_of(part(spark, sf)).select("i", *[extras.byte_plane(F.col("u"), k).alias(f"b{k}") for k in range(4)])


# ------------------------------------------------------------------ predictors


@query(_delta(F_EVENTS, 1e-3, ONE) + CODES)
def lorenzo_1d(spark, sf):
    return _p(events(spark, sf), 1e-3, 1).select("field_id", "i", "d", "code")


@query(_delta(F_EMB, 1e-3, TWO) + CODES)
def lorenzo_2d(spark, sf):
    return _p(embeddings(spark, sf), 1e-3, 2).select("field_id", "i", "d", "code")


@query(_delta(F_ORDERS, 1e-3, THREE) + CODES)
def lorenzo_3d(spark, sf):
    return _p(orders(spark, sf), 1e-3, 3).select("field_id", "i", "d", "code")


@query(_delta(F_EVENTS, 1e-3, ONE) + f" SELECT field_id, i, d, CAST(CASE WHEN abs(d) < {R} THEN CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END ELSE 0 END AS INTEGER) AS code FROM p")
def lorenzo_1d_zigzag(spark, sf):
    return _p(events(spark, sf), 1e-3, 1, zigzag=True).select("field_id", "i", "d", "code")


@query(_delta(F_EVENTS, 1e-3, (256,)) + CODES)
def lorenzo_proto_tile256(spark, sf):
    return _p(events(spark, sf), 1e-3, 1, "prototype").select("field_id", "i", "d", "code")


@query(_delta(F_EMB, 1e-3, (16, 16)) + CODES)
def lorenzo_proto_2d(spark, sf):
    return _p(embeddings(spark, sf), 1e-3, 2, "prototype").select("field_id", "i", "d", "code")


@query(_delta(F_EVENTS, 1e-3, (1 << 40,)) + " SELECT field_id, i, d FROM p")
def lorenzo_untiled(spark, sf):
    f = fields.with_error_bound(events(spark, sf), 1e-3)
    return predict.forward_untiled(f.withColumn("q", quant.prequantize(F.col("v"), F.col("eb"))), block=4096).select("field_id", "i", "d")


@query(_with(F_EVENTS, 1e-3) + " SELECT field_id, i, q FROM q")
def lorenzo_inverse_untiled(spark, sf):
    f = fields.with_error_bound(events(spark, sf), 1e-3)
    d = predict.forward_untiled(f.withColumn("q", quant.prequantize(F.col("v"), F.col("eb"))), block=4096).drop("q")
    return predict.inverse_untiled(d, block=4096).select("field_id", "i", F.col("q").cast("bigint").alias("q"))


def _inverse(field, eb, ndim):
    tile = predict.PRODUCTION[ndim]
    return predict.inverse(_p(field, eb, ndim).drop("q"), tile, deal=False).select("field_id", "i", F.col("q").cast("bigint").alias("q"))


@query(_with(F_EVENTS, 1e-3) + " SELECT field_id, i, q FROM q")
def lorenzo_inverse_1d(spark, sf):
    return _inverse(events(spark, sf), 1e-3, 1)


@query(_with(F_EMB, 1e-3) + " SELECT field_id, i, q FROM q")
def lorenzo_inverse_2d(spark, sf):
    return _inverse(embeddings(spark, sf), 1e-3, 2)


@query(_with(F_ORDERS, 1e-3) + " SELECT field_id, i, q FROM q")
def lorenzo_inverse_3d(spark, sf):
    return _inverse(orders(spark, sf), 1e-3, 3)


@query(_with(F_EVENTS, 1e-4) + " SELECT field_id, i, q, q AS back FROM q")
def dualquant_value_outliers(spark, sf):
    f = fields.with_error_bound(events(spark, sf), 1e-4)
    out = serial.prequantized_round_trip(f.withColumn("q", quant.prequantize(F.col("v"), F.col("eb"))))
    return out.select("field_id", "i", "q", F.col("back").cast("bigint").alias("back"))


def _serial(field: str, eb: float, tile: int) -> str:
    """WITH RECURSIVE ... w: codes and values of the loop-carried quantizer, place by place of all tiles at once."""
    step = "floor((floor(abs(v - last) / eb) + 1) / 2) * sign(v - last)"
    one = f"SELECT field_id, i, t, k, v, eb, {step} AS s, last + {step} * 2 * eb AS near FROM"
    done = f"SELECT field_id, i, t, k, v, eb, CASE WHEN abs(s) < {R} AND abs(near - v) <= eb THEN CAST(s AS INTEGER) + {R} ELSE 0 END AS code, CASE WHEN abs(s) < {R} AND abs(near - v) <= eb THEN near ELSE v END AS xv FROM"
    return f"""WITH RECURSIVE f AS ({field}), r AS (SELECT field_id, {eb!r} * (max(v) - min(v)) AS eb FROM f GROUP BY field_id),
t AS (SELECT field_id, i, i // {tile} AS t, i % {tile} AS k, v, eb FROM f JOIN r USING (field_id)),
w AS ({done} ({one} (SELECT *, CAST(0 AS DOUBLE) AS last FROM t WHERE k = 0))
  UNION ALL {done} ({one} (SELECT t.*, w.xv AS last FROM t JOIN w ON w.field_id = t.field_id AND w.t = t.t AND t.k = w.k + 1)))"""


def _serial_tiles(field: str, eb: float, tile: tuple[int, ...]) -> str:
    """The same in tiles of several dimensions: w has what a tile has rebuilt so far as a list, x fastest."""
    places, strides = 1, []
    for size in tile:
        strides.append(places)
        places *= size
    local = " + ".join(f"({a} % {t}) * {k}" for a, t, k in zip("xyz", tile, strides))
    name = " || '/' || ".join(f"CAST({a} // {t} AS VARCHAR)" for a, t in zip("xyz", tile))
    terms = []
    for sign, offsets in serial.neighbours(len(tile)):  # slowest axis first
        back = list(zip(reversed(offsets), tile, strides))
        inside = " AND ".join(f"(g.k // {k}) % {t} >= {o}" for o, t, k in back if o)
        terms.append(f"{sign} * CASE WHEN {inside} THEN w.xs[g.k + 1 - {sum(o * k for o, _, k in back)}] ELSE 0 END")
    guess = " + ".join(terms)
    step = "floor((floor(abs(v - guess) / eb) + 1) / 2) * sign(v - guess)"
    ok = f"abs({step}) < {R} AND abs(guess + {step} * 2 * eb - v) <= eb"
    one = f"CASE WHEN {ok} THEN guess + {step} * 2 * eb ELSE v END AS xv, CASE WHEN {ok} THEN CAST({step} AS INTEGER) + {R} ELSE 0 END AS code"
    return f"""WITH RECURSIVE f AS ({field}), r AS (SELECT field_id, {eb!r} * (max(v) - min(v)) AS eb FROM f GROUP BY field_id),
t AS (SELECT field_id, {name} AS tile, {local} AS k, v FROM f),
g AS (SELECT field_id, tile, k, coalesce(v, 0) AS v, eb FROM (SELECT DISTINCT field_id, tile FROM t) CROSS JOIN range({places}) AS places(k) LEFT JOIN t USING (field_id, tile, k) JOIN r USING (field_id)),
w AS (SELECT field_id, tile, CAST(-1 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS xs, CAST([] AS INTEGER[]) AS codes FROM g WHERE k = 0
  UNION ALL SELECT field_id, tile, k, list_append(xs, xv), list_append(codes, code) FROM (SELECT *, {one} FROM (SELECT g.*, w.xs, w.codes, {guess} AS guess FROM g JOIN w ON w.field_id = g.field_id AND w.tile = g.tile AND g.k = w.k + 1))),
u AS (SELECT field_id, tile, unnest(xs) AS xv, unnest(codes) AS code, unnest(range({places})) AS k FROM w WHERE k = {places - 1}),
done AS (SELECT * FROM u JOIN t USING (field_id, tile, k))
SELECT field_id, count(*) AS n, count(*) FILTER (code = 0) AS n_outliers, round(max(abs(v - xv)), 6) AS max_err, CAST(sum(code) AS BIGINT) AS codes FROM done GROUP BY field_id"""


_ROUND_TRIP = " SELECT field_id, count(*) AS n, count(*) FILTER (code = 0) AS n_outliers, round(max(abs(v - xv)), 6) AS max_err, CAST(sum(code) AS BIGINT) AS codes FROM w GROUP BY field_id"


def _summary(out):
    return out.groupBy("field_id").agg(F.count("*").alias("n"), F.count_if(F.col("code") == 0).alias("n_outliers"), F.round(F.max(F.abs(F.col("v") - F.col("xv"))), 6).alias("max_err"), F.sum("code").cast("bigint").alias("codes"))


@query(_serial(F_EVENTS, 1e-3, 256) + _ROUND_TRIP)
def sz14_blocked(spark, sf):
    return _summary(serial.blocked_round_trip(fields.with_error_bound(events(spark, sf), 1e-3)))


@query(_serial_tiles(F_EMB, 1e-3, (16, 16)))
def sz14_blocked_2d(spark, sf):
    return _summary(serial.blocked_round_trip(fields.with_error_bound(embeddings(spark, sf), 1e-3), 2))


@query(_serial_tiles(F_ORDERS, 1e-3, (8, 8, 8)))
def sz14_blocked_3d(spark, sf):
    return _summary(serial.blocked_round_trip(fields.with_error_bound(orders(spark, sf), 1e-3), 3))


@query(_serial(F_PART, 1e-3, 1 << 40) + _ROUND_TRIP)
def sz14_whole_1d(spark, sf):
    return _summary(serial.whole_round_trip(fields.with_error_bound(part(spark, sf), 1e-3)))


@query()
def sz14_whole_2d(spark, sf):
    return _summary(serial.whole_round_trip(fields.with_error_bound(embeddings(spark, sf), 1e-3), 2, 64))


@query()
def sz14_whole_3d(spark, sf):
    return _summary(serial.whole_round_trip(fields.with_error_bound(orders(spark, sf), 1e-3), 3, 16, 16))


def _tiles_of_values(field, ndim, eb=1e-4):
    f = fields.with_error_bound(field, eb)
    out = serial.prequantized_tiles(f.withColumn("q", quant.prequantize(F.col("v"), F.col("eb"))), ndim)
    return out.select("field_id", "i", F.col("q").cast("bigint").alias("q"), (F.col("out") == 1).alias("out"), F.col("back").cast("bigint").alias("back"))


@query(_delta(F_EMB, 1e-4, (16, 16)) + f" SELECT field_id, i, q, abs(d) >= {R} AS out, q AS back FROM p")
def dualquant_value_outliers_2d(spark, sf):
    return _tiles_of_values(embeddings(spark, sf), 2)


@query(_delta(F_ORDERS, 1e-4, (8, 8, 8)) + f" SELECT field_id, i, q, abs(d) >= {R} AS out, q AS back FROM p")
def dualquant_value_outliers_3d(spark, sf):
    return _tiles_of_values(orders(spark, sf), 3)


_NO_TILE = 1 << 40


def _approx(field: str, eb: float, axes: str) -> str:
    """WITH ... a: steps of the errors against original neighbours."""
    out, prev, col = f"WITH f AS ({field}), r AS (SELECT field_id, {eb!r} * (max(v) - min(v)) AS eb FROM f GROUP BY field_id), g AS (SELECT f.*, eb FROM f JOIN r USING (field_id))", "g", "v"
    for k, a in enumerate(axes):
        other = "".join(f", {b}" for b in axes if b != a)
        out += f", d{k} AS (SELECT *, {col} - coalesce(lag({col}) OVER (PARTITION BY field_id{other} ORDER BY {a}), 0) AS e{k} FROM {prev})"
        prev, col = f"d{k}", f"e{k}"
    return out + f", a AS (SELECT *, CAST(round_even({col} * (1 / (2 * eb)), 0) AS BIGINT) AS step FROM {prev})"


@query(_approx(F_EVENTS, 1e-3, "x") + " SELECT field_id, i, step FROM a")
def sz14_approx_1d(spark, sf):
    return predict.errors_of_values(fields.with_error_bound(events(spark, sf), 1e-3), 1, block=4096).select("field_id", "i", "step")


@query(_approx(F_EMB, 1e-3, "xy") + " SELECT field_id, i, step FROM a")
def sz14_approx_2d(spark, sf):
    return predict.errors_of_values(fields.with_error_bound(embeddings(spark, sf), 1e-3), 2).select("field_id", "i", "step")


@query(_approx(F_ORDERS, 1e-3, "xyz") + " SELECT field_id, i, step FROM a")
def sz14_approx_3d(spark, sf):
    return predict.errors_of_values(fields.with_error_bound(orders(spark, sf), 1e-3), 3).select("field_id", "i", "step")


@query(" UNION ALL ".join("SELECT * FROM (" + _approx(F_EVENTS, eb, "x") + f" SELECT CAST({eb!r} AS DOUBLE) AS user_eb, count(DISTINCT step) AS n_steps, count(*) FILTER (step = 0) AS zeros, max(abs(step)) AS widest FROM a)" for eb in (0.1, 0.01, 0.001, 0.0001)))
def multi_eb_sz14(spark, sf):
    """The steps of the loop-carried kind under several bounds, beside multi_eb_sweep."""
    f = fields.beside(events(spark, sf), fields.value_range(events(spark, sf)).select("field_id", "rng"))
    d = predict.forward_untiled(f, "v", "d", block=4096).withColumn("user_eb", F.explode(F.array(*[F.lit(e) for e in (0.1, 0.01, 0.001, 0.0001)])))
    step = quant.prequantize_half_even(F.col("d"), F.col("user_eb") * F.col("rng"))
    return d.groupBy("user_eb").agg(F.count_distinct(step).alias("n_steps"), F.count_if(step == 0).alias("zeros"), F.max(F.abs(step)).alias("widest"))



@query(_delta(F_EMB, 1e-3, (_NO_TILE, _NO_TILE)) + " SELECT field_id, i, d, q FROM p")
def lorenzo_untiled_2d(spark, sf):
    return _untiled(embeddings(spark, sf), 2)


@query(_delta(F_ORDERS, 1e-3, (_NO_TILE, _NO_TILE, _NO_TILE)) + " SELECT field_id, i, d, q FROM p")
def lorenzo_untiled_3d(spark, sf):
    return _untiled(orders(spark, sf), 3)


def _untiled(field, ndim):
    f = fields.with_error_bound(field, 1e-3)
    d = predict.forward_lines(f.withColumn("q", quant.prequantize(F.col("v"), F.col("eb"))), ndim).drop("q")
    return predict.inverse_lines(d, ndim).select("field_id", "i", "d", F.col("q").cast("bigint").alias("q"))


@query()
def spline3d_roundtrip(spark, sf):
    return _summary(spline.round_trip(orders(spark, sf), 500.0))


@query()
def compress_decompress_spline(spark, sf):
    """Points that come back further from the field than 500: none."""
    f = orders(spark, sf)
    back = pipeline.decompress(pipeline.compress(f, Config(500.0, "abs", ndim=3, predictor="spline")))
    p = stats.paired(f, back)
    return p.groupBy("field_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("o") - F.col("x")) > stats.TOLERANCE * 500.0).alias("beyond"))


# ------------------------------------------------------------------ outliers


@query(_delta(F_PART, 1e-4, ONE) + f" SELECT field_id, i, d + {R} AS val FROM p WHERE abs(d) >= {R}")
def outlier_gather(spark, sf):
    return sparse.gather(_p(part(spark, sf), 1e-4, 1), R)


@query(_delta(F_EVENTS, 1e-4, ONE) + " SELECT field_id, i, d FROM p")
def outlier_scatter(spark, sf):
    p = _p(events(spark, sf), 1e-4, 1)
    back = sparse.scatter(p.select("field_id", "i", "code"), sparse.gather(p, R))
    return back.select("field_id", "i", quant.fuse(F.col("code").cast("bigint"), F.col("val"), R).alias("d"))


_STATUS = f" SELECT field_id, count(*) AS n, count(*) FILTER (abs(d) >= {R}) AS n_outliers, CASE WHEN count(*) FILTER (abs(d) >= {R}) >= count(*) * 0.1 THEN 'TOO_MANY_OUTLIERS' ELSE 'SUCCESS' END AS status FROM p GROUP BY field_id"


@query(_delta(F_EVENTS, 1e-4, ONE) + _STATUS)
def outlier_status(spark, sf):
    return sparse.status(_p(events(spark, sf), 1e-4, 1), R)


@query(_delta(F_EVENTS, 1e-4, ONE) + f" SELECT field_id, count(*) FILTER (code >= {2 * R} OR code < 0) AS n_wide, count(*) FILTER (code >= {2 * R} OR code <= 0) AS n_split, count(*) FILTER (code <> {R}) AS n_binary, count(*) FILTER (d <> 0) AS n_nonzero, min(i) FILTER (code >= 1000) AS first_invalid FROM p GROUP BY field_id")
def outlier_splits(spark, sf):
    p = _p(events(spark, sf), 1e-4, 1)
    c = F.col("code")
    return p.groupBy("field_id").agg(
        F.count_if(~quant.in_shifted_ball(c, R)).alias("n_wide"), F.count_if((c >= 2 * R) | (c <= 0)).alias("n_split"), F.count_if(~quant.equals(c, R)).alias("n_binary"), F.count_if(F.col("d") != 0).alias("n_nonzero"), F.min(F.when(c >= 1000, F.col("i"))).alias("first_invalid")
    )


@query("WITH f AS (" + F_ORDERS + ") SELECT field_id, x // 8 AS ax, y // 8 AS ay, z // 8 AS az, v FROM f WHERE x % 8 = 0 AND y % 8 = 0 AND z % 8 = 0")
def anchor_gather(spark, sf):
    return sparse.anchors(orders(spark, sf))


# ------------------------------------------------------------------ histograms


@query(_delta(F_EVENTS, 1e-3, ONE) + f" SELECT 'events' AS field_id, CAST(b.code AS INTEGER) AS code, count(p.code) AS freq FROM range({2 * R}) AS b(code) LEFT JOIN p ON p.code = b.code GROUP BY b.code")
def histogram_dense(spark, sf):
    return pipeline.analyze(events(spark, sf), Config(1e-3))


@query(_delta(F_EVENTS, 1e-3, ONE) + " SELECT field_id, code, count(*) AS freq FROM p GROUP BY field_id, code")
def histogram_sparse(spark, sf):
    return hist.histogram_centered(_p(events(spark, sf), 1e-3, 1), R)


_ENT = """, h AS (SELECT field_id, code, count(*) AS freq FROM p GROUP BY field_id, code), s AS (SELECT field_id, sum(freq) AS n FROM h GROUP BY field_id),
e AS (SELECT field_id, CAST(n AS BIGINT) AS n, max(freq / n) AS p1, sum(-(freq / n) * log2(freq / n)) AS ent FROM h JOIN s USING (field_id) GROUP BY field_id, n) """


@query(_delta(F_EVENTS, 1e-2, ONE) + _ENT + "SELECT field_id, n, round(ent, 6) AS entropy FROM e")
def entropy(spark, sf):
    e = hist.entropy(hist.histogram(_p(events(spark, sf), 1e-2, 1)))
    return e.select("field_id", "n", F.round("entropy", 6).alias("entropy"))


@query(_delta(F_EVENTS, 1e-2, ONE) + _ENT + "SELECT field_id, round(p1, 6) AS top_share, round(ent + CASE WHEN p1 > 0.4 THEN 1 - CASE WHEN p1 < 1 THEN -p1 * log2(p1) - (1 - p1) * log2(1 - p1) ELSE 0 END ELSE 0 END, 6) AS low_bits, round(ent + p1 + 0.086, 6) AS high_bits FROM e")
def huffman_bounds(spark, sf):
    e = hist.entropy(hist.histogram(_p(events(spark, sf), 1e-2, 1)))
    return e.select("field_id", *[F.round(c, 6).alias(c) for c in ("top_share", "low_bits", "high_bits")])


@query(_delta(F_PART, 1e-2, ONE) + " SELECT field_id, count(*) AS n, count(*) FILTER (d = 0) AS zeros FROM p GROUP BY field_id")
def top1_zero_delta(spark, sf):
    return _p(part(spark, sf), 1e-2, 1).groupBy("field_id").agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("zeros"))


@query("WITH f AS (" + F_EVENTS + "), r AS (SELECT min(v) AS lo, max(v) AS hi FROM f) SELECT field_id, CAST(least(15, floor((v - lo) * 16 / (hi - lo))) AS INTEGER) AS bin, count(*) AS freq FROM f, r GROUP BY ALL")
def value_histogram16(spark, sf):
    return stats.value_histogram(events(spark, sf))


# ------------------------------------------------------------------ statistics and quality


@query("WITH f AS (" + F_EVENTS + ") SELECT field_id, count(*) AS n, min(v) AS min_v, max(v) AS max_v, round(avg(v), 6) AS avg_v, max(v) - min(v) AS range_v FROM f GROUP BY field_id")
def extrema(spark, sf):
    return stats.extrema(events(spark, sf)).withColumn("avg_v", F.round("avg_v", 6))


def _pairs(spark, sf, eb=1e-3):
    f = fields.with_error_bound(events(spark, sf), eb)
    return f.select("field_id", "i", F.col("v").alias("o"), quant.dequantize(quant.prequantize(F.col("v"), F.col("eb")), F.col("eb")).alias("x"), "eb")


_PAIRS = _with(F_EVENTS, 1e-3) + ", w AS (SELECT field_id, i, v AS o, q * (2 * eb) AS x, eb FROM q) "


@query(_PAIRS + "SELECT field_id, count(*) AS n, round(20 * log10(max(o) - min(o)) - 10 * log10(avg((o - x) * (o - x))), 5) AS psnr, round(sqrt(avg((o - x) * (o - x))) / (max(o) - min(o)), 9) AS nrmse, round(corr(o, x), 7) AS coeff FROM w GROUP BY field_id")
def assess_quality(spark, sf):
    p = _pairs(spark, sf)
    a = stats.assess(stats.paired(p.select("field_id", "i", F.col("o").alias("v")), p.select("field_id", "i", F.col("x").alias("v"))))
    return a.select("field_id", "n", F.round("psnr", 5).alias("psnr"), F.round("nrmse", 9).alias("nrmse"), F.round("coeff", 7).alias("coeff"))


@query(_PAIRS + "SELECT field_id, round(covar_pop(o, x) * count(*) / (var_pop(o) * count(*)), 6) AS slope, round(sum((o - x) * (o - x)) / (var_pop(x) * count(*)), 9) AS rest FROM w GROUP BY field_id")
def error_sums(spark, sf):
    e = stats.error_sums(_pairs(spark, sf))
    return e.select("field_id", F.round(F.col("sum_corr") / F.col("sum_var_o"), 6).alias("slope"), F.round(F.col("sum_err_sq") / F.col("sum_var_x"), 9).alias("rest"))


@query(_PAIRS + "SELECT field_id, round(max(abs(o - x)), 9) AS max_err, min(i) FILTER (abs(o - x) = m) AS i FROM (SELECT *, max(abs(o - x)) OVER (PARTITION BY field_id) AS m FROM w) GROUP BY field_id")
def max_error_argmax(spark, sf):
    return stats.max_error(_pairs(spark, sf)).withColumn("max_err", F.round("max_err", 9))


@query(_PAIRS + "SELECT field_id, min(i) FILTER (abs(o - x) > 1.001 * (eb / 2)) AS first_violation, min(i) FILTER (abs(o - x) > 1.001 * (eb / 2)) IS NULL AS bounded FROM w GROUP BY field_id")
def error_bounded(spark, sf):
    return stats.error_bounded(_pairs(spark, sf), F.col("eb") / 2)


@query(_PAIRS + "SELECT field_id, bool_and(o = x) AS identical FROM w GROUP BY field_id")
def identical(spark, sf):
    return stats.identical(_pairs(spark, sf))


@query(_PAIRS + "SELECT field_id, round(max(abs(o - x) / nullif(abs(o), 0)), 6) AS max_pwrrel_err FROM w GROUP BY field_id")
def point_rel_error(spark, sf):
    p = _pairs(spark, sf)
    return stats.assess(p).select("field_id", F.round("max_pwrrel_err", 6).alias("max_pwrrel_err"))


@query("WITH f AS (" + F_EVENTS + ") " + " UNION ALL ".join(f"SELECT a.field_id, {k} AS lag, round(corr(a.v, b.v), 6) AS coeff FROM f a JOIN f b ON b.i = a.i + {k} GROUP BY a.field_id" for k in (1, 2)))
def autocorr_lag1_lag2(spark, sf):
    return stats.autocorrelation(events(spark, sf)).withColumn("coeff", F.round("coeff", 6))


@query("WITH f AS (" + F_EVENTS + ") SELECT field_id, quantile_disc(v, 0.01) AS p1, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.99) AS p99, max(v) AS p100 FROM f GROUP BY field_id")
def percentiles(spark, sf):
    return stats.percentiles(events(spark, sf), (0.01, 0.5, 0.99, 1.0))


# ------------------------------------------------------------------ space


@query("WITH f AS (" + F_EMB + ") SELECT field_id, x // 4 AS bx, y // 3 AS by, round(avg(v), 6) AS v, count(*) AS n FROM f GROUP BY ALL")
def binning2d(spark, sf):
    return extras.binning2d(embeddings(spark, sf), 4, 3).withColumn("v", F.round("v", 6))


_VARIO = "WITH f AS (" + F_EVENTS + "), l AS (SELECT unnest([1, 2, 4, 8, 16]) AS lag), m AS (SELECT a.field_id, lag, count(*) AS n, avg(abs(b.v - a.v)) AS madogram, avg((b.v - a.v) * (b.v - a.v)) AS squared, avg(CASE WHEN b.v <> a.v THEN 1.0 ELSE 0.0 END) AS differing FROM f a CROSS JOIN l JOIN f b ON b.i = a.i + lag GROUP BY ALL) "


@query(_VARIO + "SELECT field_id, lag, n, round(madogram, 5) AS madogram, round(squared, 3) AS squared, round(differing, 6) AS differing FROM m")
def variogram_1d(spark, sf):
    v = extras.variogram(events(spark, sf), (1, 2, 4, 8, 16))
    return v.select("field_id", "lag", "n", F.round("madogram", 5).alias("madogram"), F.round("squared", 3).alias("squared"), F.round("binary", 6).alias("differing"))


@query(_VARIO + "SELECT field_id, round(regr_slope(madogram, lag), 5) AS slope, round(regr_intercept(madogram, lag), 4) AS intercept FROM m GROUP BY field_id")
def variogram_fit(spark, sf):
    v = extras.variogram_fit(extras.variogram(events(spark, sf), (1, 2, 4, 8, 16)))
    return v.select("field_id", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


_TO = ((1, 0), (0, 1), (1, 1), (2, 3))


@query("WITH f AS (" + F_EMB + "), t AS (SELECT * FROM (VALUES " + ", ".join(map(str, _TO)) + ") AS t(dx, dy)) SELECT a.field_id, dx, dy, count(*) AS n, round(avg(abs(b.v - a.v)), 6) AS madogram, round(avg((b.v - a.v) * (b.v - a.v)), 6) AS squared FROM f a, t, f b WHERE b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL")
def variogram_2d(spark, sf):
    v = extras.variogram_2d(embeddings(spark, sf), _TO)
    return v.select("field_id", "dx", "dy", "n", F.round("madogram", 6).alias("madogram"), F.round("squared", 6).alias("squared"))


@query("WITH f AS (" + F_EMB + "), t AS (SELECT * FROM (VALUES " + ", ".join(map(str, _TO)) + ") AS t(dx, dy)) SELECT a.field_id, dx, dy, count(*) AS n, round(avg((b.v - a.v) * (b.v - a.v)), 6) AS variance FROM f a, t, f b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.x // 8 = a.x // 8 AND b.y // 8 = a.y // 8 GROUP BY ALL")
def tile_variance_2d(spark, sf):
    v = extras.variogram_2d(embeddings(spark, sf), _TO, tile=8)
    return v.select("field_id", "dx", "dy", "n", F.round("squared", 6).alias("variance"))


@query("WITH f AS (" + F_EVENTS + "), l AS (SELECT unnest([1, 2, 3]) AS lag) SELECT a.field_id, lag, round(avg(pow(a.v - b.v, 2)), 3) AS variance FROM f a CROSS JOIN l JOIN f b ON b.i = a.i - lag AND a.i // 64 = b.i // 64 GROUP BY ALL")
def tile_variance(spark, sf):
    return extras.tile_variance(events(spark, sf), 64, (1, 2, 3)).withColumn("variance", F.round("variance", 3))


@query("WITH f AS (" + F_EVENTS + """), t AS (SELECT *, i // 32 AS t, CAST('0x' || substr(md5('7:' || CAST(i // 32 AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < 500000 AS chosen FROM f),
o AS (SELECT field_id, i, v, t, row_number() OVER (PARTITION BY field_id, t ORDER BY x) AS r, row_number() OVER (PARTITION BY field_id, t ORDER BY CASE WHEN chosen THEN md5('7:' || CAST(i AS VARCHAR)) END NULLS FIRST, x) AS s FROM t)
SELECT a.field_id, a.i, b.v FROM o a JOIN o b ON a.field_id = b.field_id AND a.t = b.t AND a.r = b.s""")
def shuffled_blocks(spark, sf):
    return extras.shuffled_blocks(events(spark, sf), 32, 0.5, 7).select("field_id", "i", "v")


@query(" UNION ALL ".join("SELECT * FROM (" + _delta(F_EVENTS, eb, ONE) + f" SELECT CAST({eb!r} AS DOUBLE) AS user_eb, count(*) FILTER (code = 0) AS n_outliers, count(DISTINCT code) AS n_codes, count(*) FILTER (d = 0) AS zeros FROM p)" for eb in (0.1, 0.01, 0.001, 0.0001)))
def multi_eb_sweep(spark, sf):
    # bounds are part of the field's name, so one plan does all of them
    f, bounds = events(spark, sf), (0.1, 0.01, 0.001, 0.0001)
    r = fields.value_range(f).select(F.col("field_id").alias("__f"), "rng")
    g = f.join(r, F.col("field_id") == F.col("__f")).withColumn("user_eb", F.explode(F.array(*[F.lit(e) for e in bounds])))
    g = g.withColumn("field_id", F.concat_ws("@", "field_id", "user_eb")).withColumn("eb", F.col("user_eb") * F.col("rng"))
    p = predict.forward(g.withColumn("q", quant.prequantize(F.col("v"), F.col("eb"))), ONE)
    c = quant.postquantize(F.col("d"), R)
    return p.groupBy("user_eb").agg(F.count_if(c == 0).alias("n_outliers"), F.count_distinct(c).alias("n_codes"), F.count_if(F.col("d") == 0).alias("zeros"))


@query(_delta(F_USER, 1e-2, ONE) + " SELECT field_id, count(*) AS n, CAST(sum(code) AS BIGINT) AS codes, count(*) FILTER (code = 0) AS n_outliers FROM p GROUP BY field_id")
def batch_fields_by_user(spark, sf):
    p = _p(by_user(spark, sf), 1e-2, 1)
    return p.groupBy("field_id").agg(F.count("*").alias("n"), F.sum("code").alias("codes"), F.count_if(F.col("code") == 0).alias("n_outliers"))


# ------------------------------------------------------------------ codecs

_RUNS = _delta(F_PART, 1e-2, ONE) + ", c AS (SELECT *, CASE WHEN code = lag(code) OVER (PARTITION BY field_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM p), g AS (SELECT *, sum(new) OVER (PARTITION BY field_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c) "


@query(_RUNS + "SELECT field_id, min(i) AS start, count(*) AS len, any_value(code) AS value FROM g GROUP BY field_id, run")
def rle_encode(spark, sf):
    return rle.encode(_p(part(spark, sf), 1e-2, 1), block=512)


@query(_delta(F_PART, 1e-2, ONE) + " SELECT field_id, i, code FROM p")
def rle_decode(spark, sf):
    return rle.decode(rle.encode(_p(part(spark, sf), 1e-2, 1), block=512))


_FZ = _delta(F_EVENTS, 1e-2, ONE) + """, w AS (SELECT field_id, i // 2 AS w, CAST(sum(CASE WHEN i % 2 = 0 THEN code ELSE code::BIGINT * 65536 END) AS BIGINT) AS word FROM p GROUP BY ALL),
b AS (SELECT field_id, w // 32 AS r, w % 32 AS lane, bit, (word >> bit) & 1 AS x FROM w, range(32) AS k(bit)),
t AS (SELECT field_id, r * 32 + bit AS w, CAST(sum(x * (1::BIGINT << CAST(lane AS INTEGER))) AS BIGINT) AS word FROM b GROUP BY ALL) """


@query(_FZ + "SELECT field_id, CAST(w AS BIGINT) AS w, word FROM t WHERE word <> 0")
def fz_bitshuffle(spark, sf):
    return fz.transpose(fz.words(_p(events(spark, sf), 1e-2, 1))).select("field_id", F.col("w").cast("bigint").alias("w"), "word")


@query(_FZ + ", g AS (SELECT field_id, w // 1024 AS chunk, w // 4 AS g, max(word) AS m FROM t GROUP BY ALL) SELECT field_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS kept, count(*) * 16 + 32 AS bytes FROM g WHERE m > 0 GROUP BY ALL")
def fz_nonzero_groups(spark, sf):
    return fz.sizes(fz.encode(_p(events(spark, sf), 1e-2, 1)))


@query(_FZ + ", g AS (SELECT field_id, w // 1024 AS chunk, w // 4 AS g, max(word) AS m FROM t GROUP BY ALL), c AS (SELECT field_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS kept FROM g WHERE m > 0 GROUP BY ALL) SELECT field_id, chunk, CAST(kept * 16 AS INTEGER) AS bytes, CAST(coalesce(sum(kept * 16) OVER (PARTITION BY field_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def fz_archive(spark, sf):
    c = fz.starts(fz.encode(_p(events(spark, sf), 1e-2, 1)))
    return c.select("field_id", "chunk", F.length("payload").alias("bytes"), "start").filter("bytes > 0")


@query(_delta(F_EVENTS, 1e-2, ONE) + " SELECT field_id, i, code FROM p")
def fz_roundtrip(spark, sf):
    p = _p(events(spark, sf), 1e-2, 1)
    return fz.decode(fz.encode(p))


@query("WITH l AS (SELECT CAST(c AS INTEGER) AS code, CAST(least(c + 1, 14) AS INTEGER) AS len FROM range(15) AS r(c)), f AS (SELECT a.len, coalesce(sum(pow(2.0, a.len - b.len)), 0) AS first FROM (SELECT DISTINCT len FROM l) a LEFT JOIN l b ON b.len > a.len GROUP BY a.len) SELECT 'lengths' AS field_id, code, len, CAST(first AS BIGINT) + row_number() OVER (PARTITION BY len ORDER BY code) - 1 AS word FROM l JOIN f USING (len)")
def canonical_book_from_lengths(spark, sf):
    c = F.col("id").cast("int")
    return huffman.canonical_book(spark.range(15).select(F.lit("lengths").alias("field_id"), c.alias("code"), F.least(c + 1, F.lit(14)).alias("len"))).withColumn("word", F.col("word").cast("bigint"))


# The two least items (count, number, symbols) are merged again and again; a symbol's length is the number of merges that it is in.
_BOOK = _delta(F_EVENTS, 1e-2, ONE).replace("WITH f AS", "WITH RECURSIVE f AS", 1) + """, h AS (SELECT field_id, code, count(*) AS freq FROM p GROUP BY field_id, code),
k AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY freq, code) - 1 AS k FROM h),
m AS (SELECT field_id, list({'n': freq, 'k': k, 's': [code]} ORDER BY freq, k) AS l, count(*) AS next, CAST([] AS INTEGER[]) AS merged, CAST(0 AS BIGINT) AS pair FROM k GROUP BY field_id
  UNION ALL SELECT field_id, list_sort(list_append(l[3:], {'n': l[1].n + l[2].n, 'k': next, 's': list_concat(l[1].s, l[2].s)})), next + 1, list_concat(l[1].s, l[2].s), l[1].n + l[2].n FROM m WHERE len(l) > 1),
b AS (SELECT field_id, code, count(*) AS len FROM (SELECT field_id, unnest(merged) AS code FROM m) GROUP BY field_id, code),
l AS (SELECT h.*, CAST(coalesce(b.len, 1) AS INTEGER) AS len FROM h LEFT JOIN b USING (field_id, code)),
o AS (SELECT a.field_id, a.len, coalesce(sum(pow(2.0, a.len - b.len)), 0) AS first FROM (SELECT DISTINCT field_id, len FROM l) a LEFT JOIN l b ON b.field_id = a.field_id AND b.len > a.len GROUP BY a.field_id, a.len),
book AS (SELECT field_id, code, freq, len, CAST(first AS BIGINT) + row_number() OVER (PARTITION BY field_id, len ORDER BY code) - 1 AS word FROM l JOIN o USING (field_id, len)),
coded AS (SELECT field_id, i, i // 4096 AS chunk, len, word, coalesce(sum(len) OVER (PARTITION BY field_id, i // 4096 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM p JOIN book USING (field_id, code)),
chunks AS (SELECT field_id, chunk, CAST(count(*) AS INTEGER) AS n, CAST(sum(len) AS BIGINT) AS nbit FROM coded GROUP BY field_id, chunk)"""


@query(_BOOK + " SELECT * FROM book")
def huffman_book(spark, sf):
    return huffman.books(hist.histogram(_p(events(spark, sf), 1e-2, 1)))


# the sums of merged counts add up to the bits of any Huffman code
_MERGES = _BOOK + """, t AS (SELECT field_id, CAST(any_value(n) AS BIGINT) AS n, CAST(CASE WHEN max(pair) = 0 THEN any_value(n) ELSE sum(pair) END AS BIGINT) AS bits FROM m JOIN (SELECT field_id, sum(freq) AS n FROM h GROUP BY field_id) USING (field_id) GROUP BY field_id)
SELECT field_id, n, bits, bits / n AS avg_bits, 32.0 * n / bits AS ratio FROM t"""


@query(_MERGES)
def huffman_total_bits(spark, sf):
    return huffman.total_bits(huffman.books(hist.histogram(_p(events(spark, sf), 1e-2, 1))))


@query(_BOOK + """, bits AS (SELECT field_id, chunk, begins + j AS spot, (word >> (len - 1 - j)) & 1 AS x FROM (SELECT *, unnest(range(len)) AS j FROM coded)),
cells AS (SELECT field_id, chunk, CAST(sum(x * (CAST(1 AS BIGINT) << CAST(31 - spot % 32 AS INTEGER))) AS BIGINT) AS cell_sum FROM bits GROUP BY field_id, chunk)
SELECT field_id, chunk, n, nbit, CAST((nbit + 31) // 32 AS BIGINT) AS ncell, CAST(coalesce(sum((nbit + 31) // 32) OVER (PARTITION BY field_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS entry, cell_sum FROM chunks JOIN cells USING (field_id, chunk)""")
def huffman_encode_chunks(spark, sf):
    """Chunks with their entries; cell_sum: the sum of the payload's 32-bit cells."""
    p = _p(events(spark, sf), 1e-2, 1)
    c = huffman.entries(huffman.encode(p, huffman.books(hist.histogram(p))))
    cell = lambda k: F.conv(F.rpad(F.hex(F.substring(F.col("payload"), (4 * k + 1).cast("int"), F.lit(4))), 8, "0"), 16, 10).cast("bigint")
    cells = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("ncell") - 1), F.lit(0).cast("bigint"), lambda a, k: a + cell(k))
    return c.select("field_id", "chunk", "n", "nbit", "ncell", "entry", cells.alias("cell_sum"))


@query(_BOOK + " SELECT field_id, chunk, n * 32.0 / nbit AS ratio FROM chunks")
def huffman_chunk_ratios(spark, sf):
    p = _p(events(spark, sf), 1e-2, 1)
    return huffman.ratios(huffman.encode(p, huffman.books(hist.histogram(p))))


@query(_delta(F_EVENTS, 1e-2, ONE) + " SELECT field_id, i, code FROM p")
def huffman_dense_roundtrip(spark, sf):
    """Through the concatenated stream with its entries."""
    p = _p(events(spark, sf), 1e-2, 1)
    book = huffman.books(hist.histogram(p))
    return huffman.decode(huffman.undense(huffman.dense(huffman.encode(p, book), 4), 4), book)


@query(_delta(F_EVENTS, 1e-2, ONE) + " SELECT field_id, i, code FROM p")
def huffman_roundtrip(spark, sf):
    p = _p(events(spark, sf), 1e-2, 1)
    book = huffman.books(hist.histogram(p))
    return huffman.decode(huffman.encode(p, book), book)


# ------------------------------------------------------------------ pipelines


def _back(field: str, eb: float) -> str:
    return _with(field, eb) + " SELECT field_id, i, round(q * (2 * eb), 6) AS v FROM q"


def _whole(field, cfg):
    return pipeline.decompress(pipeline.compress(field, cfg)).select("field_id", "i", F.round("v", 6).alias("v"))


@query(_back(F_EVENTS, 1e-3))
def compress_decompress_1d(spark, sf):
    return _whole(events(spark, sf), Config(1e-3))


@query(_back(F_EMB, 1e-3))
def compress_decompress_2d(spark, sf):
    return _whole(embeddings(spark, sf), Config(1e-3, ndim=2))


@query(_back(F_ORDERS, 1e-3))
def compress_decompress_3d(spark, sf):
    return _whole(orders(spark, sf), Config(1e-3, ndim=3))


@query(_back(F_EVENTS, 1e-4))
def compress_decompress_zigzag(spark, sf):
    return _whole(events(spark, sf), Config(1e-4, zigzag=True))


@query(_back(F_EVENTS, 1e-2))
def compress_decompress_fz(spark, sf):
    return _whole(events(spark, sf), Config(1e-2, codec="fz"))


@query(_BOOK + f""", a AS (SELECT field_id, CAST(count(*) * 8 AS BIGINT) AS raw_bytes, CAST(count(*) FILTER (abs(d) >= {R}) * 12 AS BIGINT) AS outlier_bytes FROM p GROUP BY field_id),
c AS (SELECT field_id, CAST(sum((nbit + 7) // 8) AS BIGINT) AS code_bytes FROM chunks GROUP BY field_id), k2 AS (SELECT field_id, CAST(count(*) * 8 AS BIGINT) AS book_bytes FROM book GROUP BY field_id)
SELECT *, outlier_bytes + code_bytes + book_bytes AS total_bytes, raw_bytes / (outlier_bytes + code_bytes + book_bytes) AS ratio FROM a JOIN c USING (field_id) JOIN k2 USING (field_id)""")
def archive_sizes(spark, sf):
    return pipeline.sizes(pipeline.compress(events(spark, sf), Config(1e-2)))


@query(_with(F_EVENTS, 1e-3) + " SELECT field_id, count(*) AS n, count(*) FILTER (abs(v - q * (2 * eb)) > 1.001 * eb) = 0 AS bounded, round(max(abs(v - q * (2 * eb)) / eb), 6) AS worst, round(avg(abs(v - q * (2 * eb))), 9) AS mean_err FROM q GROUP BY field_id")
def flagship(spark, sf):
    """events.value under a bound of 1e-3 of its range: predict, find outliers, rebuild, assess."""
    cfg = Config(1e-3)
    p = pipeline.predicted(events(spark, sf), cfg)
    fused = sparse.scatter(p.drop("q", "d"), sparse.gather(p, R))
    back = predict.inverse(fused.withColumn("d", quant.fuse(F.col("code").cast("bigint"), F.col("val"), R)), cfg.tiles)
    pairs = back.select("field_id", "i", F.col("v").alias("o"), quant.dequantize(F.col("q"), F.col("eb")).alias("x"), "eb")
    e = F.abs(F.col("o") - F.col("x"))
    return pairs.groupBy("field_id").agg(F.count("*").alias("n"), (F.count_if(e > stats.TOLERANCE * F.col("eb")) == 0).alias("bounded"), F.round(F.max(e / F.col("eb")), 6).alias("worst"), F.round(F.avg(e), 9).alias("mean_err"))
