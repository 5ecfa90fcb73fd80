import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldquant.functions import quant
from fieldquant.operators import extras, fz, hist, huffman, predict, rle, serial, sparse, spline, stats
from fieldquant.plans import pipeline
from fieldquant.plans.pipeline import Config, PipelineError, Status
from fieldquant.sources import fields
from fieldquant.sources.fields import Shape


def make(spark, values, shape=None, name="t"):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i bigint, v double")
    return fields.from_table(df, "i", "v", shape, name)


@pytest.mark.parametrize("shape,tile", [(Shape(256), (256,)), (Shape(16, 16), (16, 16)), (Shape(8, 8, 8), (8, 8, 8))])
def test_golden_vectors(spark, shape, tile):
    ones = make(spark, [1.0] * shape.length, shape).withColumn("q", F.lit(1).cast("bigint"))
    d = {r.i: r.d for r in predict.forward(ones, tile).collect()}
    assert d.pop(0) == 1 and set(d.values()) == {0}
    back = predict.inverse(ones.withColumn("d", F.lit(1)).drop("q"), tile).collect()
    for r in back:
        assert r.q == (r.x + 1) * (r.y + 1 if len(tile) > 1 else 1) * (r.z + 1 if len(tile) > 2 else 1)


def test_zigzag(spark):
    x = [0, 1, -1, 2, -2, 127, -128, 2**31 - 1, -(2**31), 2**40]
    r = spark.createDataFrame([(v,) for v in x], "x bigint").select("x", quant.zigzag(F.col("x")).alias("z")).withColumn("b", quant.unzigzag(F.col("z"))).collect()
    assert all(v.z == (2 * v.x if v.x >= 0 else 2 * abs(v.x) - 1) and v.b == v.x for v in r)


def test_sql_functions(spark):
    quant.register_sql(spark)
    assert spark.sql("SELECT unzigzag(zigzag(-7)) AS a, prequantize(2.5D, 0.5D) AS b, dequantize(3, 0.5D) AS c").first().asDict() == {"a": -7, "b": 3, "c": 3.0}


def test_shapes():
    assert Shape.parse("36x18").ndim == 2 and Shape.parse("2-3-4", slowest_first=True) == Shape(4, 3, 2)
    with pytest.raises(ValueError):
        Shape(1)
    assert fields.frame_names("f.", ".dat", 1, 2) == ["f.00001.dat", "f.00002.dat"]


def test_max_error_and_identical(spark):
    a, b = [1.0] * 3000, [1.0] * 3000
    b[1500] = 2.0
    p = stats.paired(make(spark, a), make(spark, b))
    r = stats.max_error(p).first()
    assert (r.max_err, r.i) == (1.0, 1500)
    assert not stats.identical(p).first().identical
    assert stats.identical(stats.paired(make(spark, a), make(spark, a))).first().identical
    assert stats.error_bounded(p, 0.5).first().first_violation == 1500


def test_histograms_agree(spark):
    rnd = random.Random(1)
    codes = [rnd.choice([64] * 90 + [62, 63, 65, 66]) for _ in range(5000)]
    df = make(spark, codes).withColumn("code", F.col("v").cast("int"))
    plain = {r.code: r.freq for r in hist.histogram(df).collect()}
    assert plain == {r.code: r.freq for r in hist.histogram_centered(df, 64).collect()} == {c: codes.count(c) for c in set(codes)}
    dense = hist.densify(hist.histogram(df), 128).collect()
    assert len(dense) == 128 and sum(r.freq for r in dense) == 5000


def test_sparse_round_trip(spark):
    rnd = random.Random(2)
    v = [rnd.choice([0.0, 0.0, rnd.random() + 1]) for _ in range(1000)]
    f = make(spark, v)
    cells = sparse.nonzero(f)
    assert cells.count() == sum(x != 0 for x in v)
    back = sparse.scatter(f.select("field_id", "i"), cells).collect()
    assert all((r.val or 0.0) == v[r.i] for r in back)


def test_huffman_round_trip_and_degenerate(spark):
    rnd = random.Random(3)
    codes = [min(1023, int(abs(rnd.gauss(512, 9)))) for _ in range(9000)]
    df = make(spark, codes).withColumn("code", F.col("v").cast("int"))
    book = huffman.books(hist.histogram(df)).collect()
    assert sum(2.0**-r.len for r in book) == 1.0
    words = sorted(format(r.word, f"0{r.len}b") for r in book)
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
    b = huffman.books(hist.histogram(df))
    got = {r.i: r.code for r in huffman.decode(huffman.encode(df, b), b).collect()}
    assert [got[i] for i in range(9000)] == codes
    assert huffman.code_lengths({7: 5}) == {7: 1} and huffman.code_lengths({}) == {}
    one = make(spark, [3.0] * 50).withColumn("code", F.lit(3))
    b1 = huffman.books(hist.histogram(one))
    assert huffman.decode(huffman.encode(one, b1), b1).filter("code = 3").count() == 50


def test_rle_and_fz_round_trips(spark):
    rnd = random.Random(4)
    codes = [k for k in (rnd.randrange(1024) for _ in range(300)) for _ in range(rnd.randrange(1, 9))]
    df = make(spark, codes).withColumn("code", F.col("v").cast("int"))
    for block in (7, 65_536):
        runs = rle.encode(df, block=block)
        assert runs.count() == 1 + sum(a != b for a, b in zip(codes, codes[1:]))
        got = {r.i: r.code for r in rle.decode(runs).collect()}
        assert [got[i] for i in range(len(codes))] == codes
    got = {r.i: r.code for r in fz.decode(fz.encode(df)).collect()}
    assert [got[i] for i in range(len(codes))] == codes


@pytest.mark.parametrize("cfg,shape", [(Config(1e-3), None), (Config(1e-2, ndim=2), Shape(30, 34)), (Config(0.5, "abs", ndim=3), Shape(10, 10, 10)), (Config(1e-5, zigzag=True), None), (Config(1e-2, codec="fz"), None), (Config(1e-2, codec="none", predictor="prototype"), None)])
def test_pipeline_keeps_the_bound(spark, cfg, shape, tmp_path):
    n = shape.length if shape else 1500
    v = [math.sin(k / 40) * 50 + (k % 7) for k in range(n)]
    f = make(spark, v, shape)
    a = pipeline.compress(f, cfg)
    a.write(f"file://{tmp_path}/a")
    back = pipeline.decompress(pipeline.read_archive(spark, f"file://{tmp_path}/a"))
    eb = cfg.eb if cfg.mode == "abs" else cfg.eb * (max(v) - min(v))
    got = {r.i: r.v for r in back.collect()}
    assert len(got) == n and all(abs(got[i] - v[i]) <= stats.TOLERANCE * eb for i in range(n))
    assert pipeline.sizes(a).first().ratio > 0


def test_config_and_types(spark):
    assert Config(radius=4096).radius == 512 and Config(radius=4096).warnings == (Status.RADIUS_CUT,)
    with pytest.raises(PipelineError):
        Config(ndim=4)
    with pytest.raises(TypeError):
        fields.from_table(spark.range(3).withColumn("v", F.lit(1)), "id", "v")


def test_constant_field_and_status(spark):
    f = make(spark, [4.0] * 64)
    back = [r.v for r in pipeline.decompress(pipeline.compress(f, Config(1e-3))).collect()]
    assert back == [pytest.approx(4.0)] * 64
    d = make(spark, range(100)).withColumn("d", F.when(F.col("i") < 10, F.lit(600)).otherwise(0))
    assert sparse.status(d, 512).first().status == "TOO_MANY_OUTLIERS"


def test_serial_and_spline(spark):
    rnd = random.Random(5)
    v = [math.sin(k / 9) * 10 + rnd.random() for k in range(700)]
    out = serial.blocked_round_trip(make(spark, v).withColumn("eb", F.lit(0.05))).collect()
    assert len(out) == 700 and all(abs(r.v - r.xv) <= 0.05 * 1.001 for r in out)
    s = Shape(35, 10, 11)
    w = [math.sin(k % 35 / 5) + math.cos(k // 35 % 10 / 3) + (k // 350) * 0.1 for k in range(s.length)]
    out = spline.round_trip(make(spark, w, s), 0.01).collect()
    assert sorted(r.i for r in out) == list(range(s.length))
    assert all(abs(r.v - r.xv) <= 0.01 * 1.001 for r in out)
    q = make(spark, v).withColumn("q", F.round(F.col("v") * 1000).cast("bigint"))
    assert all(r.q == r.back for r in serial.prequantized_round_trip(q).collect())


def serial_brute(v, shape, tile, eb, radius=512):
    """The loop-carried quantizer point by point: {i: (code, value)}; tile None: the whole field."""
    back, out = {}, {}
    for z in range(shape.z):
        for y in range(shape.y):
            for x in range(shape.x):
                here = (x, y, z)[: shape.ndim]
                start = tuple(c // t * t for c, t in zip(here, tile)) if tile else (0,) * shape.ndim
                guess = 0.0
                for sign, o in serial.neighbours(shape.ndim):
                    at = tuple(c - b for c, b in zip(here, o))
                    if all(c >= s for c, s in zip(at, start)):
                        guess += sign * back[at]
                i = x + y * shape.x + z * shape.x * shape.y
                e = v[i] - guess
                step = (math.floor(abs(e) / eb) + 1) // 2
                near = guess + math.copysign(step, e) * 2 * eb
                ok = step < radius and abs(near - v[i]) <= eb
                back[here] = near if ok else v[i]
                out[i] = (int(math.copysign(step, e)) + radius if ok else 0, back[here])
    return out


@pytest.mark.parametrize("shape,tile", [(Shape(300), (64,)), (Shape(21, 18), (8, 8)), (Shape(9, 7, 6), (4, 4, 4)), (Shape(300), None), (Shape(13, 12), None), (Shape(7, 6, 5), None)])
def test_loop_carried_predictors(spark, shape, tile):
    """Tiles with ragged ends and whole fields, two fields at a time, against the definition."""
    rnd = random.Random(shape.length)
    v = {n: [math.sin(k / 7) * 20 + rnd.random() + (500 if k == 40 else 0) for k in range(shape.length)] for n in ("a", "b")}
    f = make(spark, v["a"], shape, "a").unionByName(make(spark, v["b"], shape, "b")).withColumn("eb", F.lit(0.05)).repartition(5)
    if tile:
        out = serial.blocked_round_trip(f, shape.ndim, tile).collect()
    else:
        out = serial.whole_round_trip(f, shape.ndim, shape.x, shape.y).collect()
    assert len(out) == 2 * shape.length
    want = {n: serial_brute(v[n], shape, tile, 0.05) for n in v}
    for r in out:
        code, value = want[r.field_id][r.i]
        assert r.code == code and math.isclose(r.xv, value, abs_tol=1e-9) and abs(r.xv - r.v) <= 0.05 * 1.001


def test_whole_fields_in_segments(spark, monkeypatch):
    """Lines that travel in many rows, the last one ragged, give what the definition gives; values that aren't finite are kept,
    and behind a gap or a repeat no row is lost."""
    monkeypatch.setattr(serial, "SEGMENT", 60)  # four lines
    rnd, shape = random.Random(8), Shape(13, 41)
    v = [math.sin(k / 7) * 20 + rnd.random() + (500 if k == 140 else 0) for k in range(shape.length)]
    f = make(spark, v, shape).withColumn("eb", F.lit(0.05)).filter(F.col("i") < shape.length - 5)
    out, want = serial.whole_round_trip(f.repartition(5), 2, 13).collect(), serial_brute(v, shape, None, 0.05)
    assert sorted(r.i for r in out) == list(range(shape.length - 5))
    assert all(r.code == want[r.i][0] and math.isclose(r.xv, want[r.i][1], abs_tol=1e-9) for r in out)
    odd = f.withColumn("v", F.when(F.col("i") == 70, math.nan).when(F.col("i") == 200, math.inf).otherwise(F.col("v")))
    got = {r.i: r for r in serial.whole_round_trip(odd, 2, 13).collect()}
    assert got[70].code == got[200].code == 0 and math.isnan(got[70].xv) and got[200].xv == math.inf
    assert all(abs(r.xv - r.v) <= 0.05 * 1.001 for i, r in got.items() if i not in (70, 200))
    holes = f.filter(~F.col("i").isin(33, 300)).unionByName(f.filter("i = 90"))
    for ndim in (1, 2):
        out = serial.whole_round_trip(holes, ndim, 13).collect()
        assert sorted(r.i for r in out) == sorted([*(set(range(shape.length - 5)) - {33, 300}), 90])
        assert all(abs(r.xv - r.v) <= 0.05 * 1.001 for r in out)


def coded_whole(monkeypatch, shape, lines):
    """(calls of the quantizer, elements and codes) of a random field that is coded so many lines or planes at a time."""
    calls, numbers, one = [], [], serial.quantized
    monkeypatch.setattr(serial, "quantized", lambda v, *more: calls.append(len(v)) or one(v, *more))
    v = np.random.default_rng(3).normal(size=shape.length) * 3
    trip, step = serial._RoundTrip(shape.ndim, shape.x, shape.y, 0.05, 512), lines * shape.length // (shape.z if shape.ndim > 2 else shape.y)
    for k in range(0, shape.length, step):
        codes, back = trip.run(np.arange(k, k + step), v[k : k + step])
        numbers += zip(codes.tolist(), back.tolist())
    want = serial_brute(v.tolist(), shape, None, 0.05)
    assert all(c == want[i][0] and math.isclose(x, want[i][1], abs_tol=1e-9) for i, (c, x) in enumerate(numbers))
    return calls, len(numbers)


def test_whole_fields_of_two_dimensions_by_diagonals(monkeypatch):
    """One step for a diagonal, none for a point: two blocks of 100 lines of 64."""
    calls, n = coded_whole(monkeypatch, Shape(64, 200), 100)
    assert n == sum(calls) == 64 * 200 and len(calls) == 2 * (100 + 63)


def test_whole_fields_of_three_dimensions_by_diagonals(spark, monkeypatch):
    """One step for a diagonal: three blocks of 20 planes of 16 x 16; and planes in several rows with a ragged end, of two fields."""
    with monkeypatch.context() as m:
        calls, n = coded_whole(m, Shape(16, 16, 60), 20)
    assert n == sum(calls) == 256 * 60 and len(calls) == 3 * (20 + 15 + 15)
    monkeypatch.setattr(serial, "SEGMENT", 100)  # two planes
    rnd, shape = random.Random(4), Shape(7, 6, 9)
    v = {n: [math.sin(k / 7) * 20 + rnd.random() + (500 if k == 130 else 0) for k in range(shape.length)] for n in ("a", "b")}
    f = make(spark, v["a"], shape, "a").unionByName(make(spark, v["b"], shape, "b")).withColumn("eb", F.lit(0.05))
    out = serial.whole_round_trip(f.filter(F.col("i") < shape.length - 10).repartition(5), 3, 7, 6).collect()
    assert sorted((r.field_id, r.i) for r in out) == [(n, k) for n in "ab" for k in range(shape.length - 10)]
    want = {n: serial_brute(v[n], shape, None, 0.05) for n in v}
    assert all(r.code == want[r.field_id][r.i][0] and math.isclose(r.xv, want[r.field_id][r.i][1], abs_tol=1e-9) for r in out)


@pytest.mark.parametrize("shape", [Shape(37, 20), Shape(11, 9, 10)])
def test_values_of_outliers_in_several_dimensions(spark, shape):
    rnd = random.Random(1)
    q = [rnd.randrange(-900, 900) for _ in range(shape.length)]
    out = serial.prequantized_tiles(make(spark, q, shape).withColumn("q", F.col("v").cast("bigint")), shape.ndim).collect()
    assert sorted(r.i for r in out) == list(range(shape.length)) and all(r.q == r.back == q[r.i] for r in out) and 0 < sum(r.out for r in out) < len(out)
    f = make(spark, q, shape).withColumn("q", F.col("v").cast("bigint"))
    back = predict.inverse_lines(predict.forward_lines(f, shape.ndim).drop("q"), shape.ndim).collect()
    assert all(r.q == q[r.i] for r in back)


def test_spline_archive(spark, tmp_path):
    s = Shape(43, 21, 10)
    v = [math.sin(k % 43 / 5) + math.cos(k // 43 % 21 / 3) + (k // 903) * 0.1 + (40 if k == 777 else 0) for k in range(s.length)]
    for cfg in (Config(1e-3, ndim=3, predictor="spline"), Config(0.02, "abs", ndim=3, predictor="spline", codec="fz", alpha=1.5, beta=3.0)):
        a = pipeline.compress(make(spark, v, s), cfg)
        path = f"file://{tmp_path}/{cfg.codec}"
        a.write(path)
        assert not a.source.is_cached
        b = pipeline.read_archive(spark, path)
        assert replace(b.cfg, tile=None) == cfg and (cfg.mode == "rel" or b.outliers.count() >= 1)
        eb = cfg.eb if cfg.mode == "abs" else cfg.eb * (max(v) - min(v))
        got = {r.i: r.v for r in pipeline.decompress(b).collect()}
        assert len(got) == s.length and all(abs(got[i] - v[i]) <= eb * stats.TOLERANCE for i in got)
        assert pipeline.sizes(b).first().anchor_bytes > 0
        pipeline.dump(b, f"{path}-dump")
        assert spark.read.parquet(f"{path}-dump/codes").count() == s.length and spark.read.parquet(f"{path}-dump/histogram").count() == 1024
    with pytest.raises(PipelineError):
        Config(ndim=2, predictor="spline")
    with pytest.raises(PipelineError):
        Config(eb=0.0)


def test_dense_streams_and_chunk_ratios(spark):
    rnd = random.Random(3)
    codes = [min(1023, int(abs(rnd.gauss(512, 9)))) for _ in range(9000)]
    df = make(spark, codes).withColumn("code", F.col("v").cast("int"))
    book = huffman.books(hist.histogram(df))
    chunks = huffman.encode(df, book, chunk=500)
    d = huffman.dense(chunks, segment=7)
    assert d.count() == 3 and all(len(r.stream) == 4 * sum(r.ncell) for r in d.collect())
    back = {r.chunk: (r.n, r.nbit, bytes(r.payload)) for r in huffman.undense(d, segment=7).collect()}
    assert back == {r.chunk: (r.n, r.nbit, bytes(r.payload)) for r in chunks.collect()}
    assert all(4 < r.ratio < 8 for r in huffman.ratios(chunks).collect()) and huffman.ratios(chunks).count() == 18


def test_report_and_lengths(spark):
    v = [math.sin(k / 40) * 50 for k in range(1500)]
    a = pipeline.compress(make(spark, v), Config(1e-3))
    r, h = pipeline.report(make(spark, v), a).first(), pipeline.lengths(a).first()
    assert r.n == 1500 and r.psnr > 50 and 0 < r.bits_per_value < 32 and r.max_abs_err <= 0.1 * stats.TOLERANCE
    assert (h.n, h.lx, h.ly, h.lz, h.raw_bytes, h.status) == (1500, 1500, 1, 1, 12_000, "OK")
    assert [huffman.tuned_chunk(n, 8) for n in (10, 10**6, 10**9)] == [1024, 15_872, 65_536]


def test_percentiles_of_skewed_fields(spark):
    rnd = random.Random(6)
    v = {"ties": [1.0] * 700 + [2.0] * 300, "heavy": [math.exp(rnd.gauss(0, 5)) for _ in range(5000)], "two": [3.0, 4.0], "line": [float(k) for k in range(4000)]}
    df = None
    for n, x in v.items():
        df = make(spark, x, name=n) if df is None else df.unionByName(make(spark, x, name=n))
    shares = (0.0, 0.01, 0.5, 0.7, 1.0)
    got = {r.field_id: r for r in stats.percentiles(df, shares).collect()}
    for n, x in v.items():
        x = sorted(x)
        assert [got[n][f"p{round(100 * s)}"] for s in shares[:4]] == [x[max(0, math.ceil(len(x) * s) - 1)] for s in shares[:4]]
        assert got[n]["p100"] == x[-1]


def test_many_fields_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(fields, "MOST_SENT", 3)
    f = spark.range(60).selectExpr("concat('f', id % 6) as k", "id", "cast(id as double) as v")
    f = fields.many(f, "k", "id", "v")
    back = pipeline.decompress(pipeline.compress(f, Config(1e-3)))
    want = {(f"f{k % 6}", k // 6): float(k) for k in range(60)}
    assert {(r.field_id, r.i): round(r.v) for r in back.collect()} == want


def test_value_histograms(spark):
    f = make(spark, [0.0, 1.0, 10.0, -100.0, 1000.0, 5.0])
    assert {r.bin: r.freq for r in stats.value_histogram(f, 3, log=True).collect()} == {0: 2, 1: 1, 2: 2}
    assert sum(r.freq for r in stats.value_histogram(f, 4, zoom=(0.0, 10.0)).collect()) == 4


def test_untiled(spark):
    f = make(spark, [k * k % 97 for k in range(1000)]).withColumn("q", F.col("v").cast("bigint"))
    d = predict.forward_untiled(f, block=64)
    assert all(r.q == r.p for r in predict.inverse_untiled(d, out="p", block=100).collect())


def test_extras(spark):
    f = make(spark, range(64))
    assert {r.bx: r.v for r in extras.binning2d(f, 4, 1).collect()}[0] == 1.5
    planes = extras.plane_ratios(extras.bits_of(f)).collect()
    assert len(planes) == 4 and all(r.ratio > 0 for r in planes)
    assert {r.lag: r.madogram for r in extras.variogram(f, (1, 3)).collect()} == {1: 1.0, 3: 3.0}
    s = extras.shuffled_blocks(f, 16, 1.0, 3).collect()
    assert sorted(r.v for r in s) == [float(k) for k in range(64)] and any(r.v != r.i for r in s)


def test_raw_binary(spark, tmp_path):
    import numpy as np

    from fieldquant.sources.rawbinary import register

    register(spark)
    v = np.arange(1000, dtype="<f4") / 3
    v.tofile(tmp_path / "raw.bin")
    df = spark.read.format("rawbinary").option("dtype", "f4").option("rangebytes", "900").load(str(tmp_path / "raw.bin"))
    assert df.rdd.getNumPartitions() > 1
    df.write.format("rawbinary").option("dtype", "f4").mode("append").save(str(tmp_path / "out"))
    back = {r.i: r.v for r in spark.read.format("rawbinary").option("dtype", "f4").load(str(tmp_path / "out")).collect()}
    assert [back[i] for i in range(1000)] == v.tolist()


def test_raw_binary_through_hadoop(spark, tmp_path):
    import numpy as np

    from fieldquant.sources import rawbinary

    v = np.arange(3000, dtype="<f8") / 7
    v.tofile(tmp_path / "raw.bin")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.raw.link./in", f"file://{tmp_path}")
    for path in (f"file://{tmp_path}/raw.bin", "viewfs://raw/in/raw.bin"):
        got = {r.i: r.v for r in rawbinary.read(spark, path, "f8").collect()}
        assert [got[i] for i in range(3000)] == v.tolist()
    rawbinary.register(spark)
    df = spark.range(2003).selectExpr("id as i", "cast(id / 3 as float) as v")
    df.repartition(3).sortWithinPartitions("i").write.format("rawbinary").option("dtype", "f4").mode("append").save(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*.new"))
    got = {r.i: r.v for r in rawbinary.read(spark, f"file://{tmp_path}/out", "f4").collect()}
    assert len(got) == 2003 and all(got[i] == np.float32(i / 3) for i in got)
    (tmp_path / "odd.bin").write_bytes(b"12345")
    with pytest.raises(ValueError):
        rawbinary.read(spark, f"file://{tmp_path}/odd.bin", "f4")


def test_stream_of_frames(spark, tmp_path):
    from fieldquant.streaming.frames import compress_stream

    for k in range(2):
        spark.range(200).selectExpr("id as i", f"cast(sin(id / 10.0) * {k + 1} as double) as v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("i bigint, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = compress_stream(s, Config(1e-3), f"file://{tmp_path}/out", f"file://{tmp_path}/state", lambda b, n: fields.from_table(b, "i", "v", name=f"frame{n}"))
    q.awaitTermination(120)
    for n in range(2):
        assert pipeline.decompress(pipeline.read_archive(spark, f"file://{tmp_path}/out/batch={n}")).count() == 200


def test_command_line(spark, tmp_path, capsys):
    import numpy as np

    from fieldquant.__main__ import main

    v = (np.sin(np.arange(1200) / 30) * 10).astype("<f4")
    v.tofile(tmp_path / "f.bin")
    main(["compress", str(tmp_path / "f.bin"), f"file://{tmp_path}/a", "--dtype", "f4", "--shape", "30x40", "--eb", "1e-3"], spark)
    main(["decompress", f"file://{tmp_path}/a", str(tmp_path / "back"), "--dtype", "f4", "--compare", str(tmp_path / "f.bin")], spark)
    main(["analyze", str(tmp_path / "f.bin"), "--dtype", "f4", "--eb", "1e-2"], spark)
    said = capsys.readouterr().out
    assert "ratio" in said and "psnr" in said and "freq" in said
    parts = sorted((tmp_path / "back").glob("part-*"), key=lambda p: p.name)
    got = np.concatenate([np.fromfile(p, "<f4") for p in parts])
    assert len(got) == 1200 and np.abs(got - v).max() <= 1.001 * 1e-3 * float(v.max() - v.min())
    with pytest.raises(SystemExit):
        main(["expand", "x"], spark)
