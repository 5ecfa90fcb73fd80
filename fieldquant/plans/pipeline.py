"""compress, decompress, analyze and assess as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quant
from ..operators import fz, hist, huffman, predict, sparse, spline, stats
from ..sources import fields

MOST_RADIUS = 512


class Status(Enum):
    OK = 0
    RADIUS_CUT = 1
    MANY_OUTLIERS = 2
    BAD_TYPE = 3
    BAD_DIMENSION = 4
    NO_PREDICTOR = 5
    NO_CODEC = 6
    BAD_LENGTH = 7
    BAD_BOUND = 8
    NOT_AN_ARCHIVE = 9


class PipelineError(ValueError):
    def __init__(self, status: Status, text: str):
        super().__init__(f"{status.name}: {text}")
        self.status = status


@dataclass(frozen=True)
class Config:
    """eb and mode ('abs' or 'rel', a share of the field's range), radius, prediction tile by dimension, codec; for splines how
    much tighter the bound is on coarse levels."""

    eb: float = 0.1
    mode: str = "rel"
    radius: int = 512
    ndim: int = 1
    predictor: str = "lorenzo"
    zigzag: bool = False
    codec: str = "huffman"
    tile: tuple[int, ...] | None = None
    alpha: float = spline.ALPHA
    beta: float = spline.BETA
    warnings: tuple[Status, ...] = dc_field(default=(), compare=False)

    def __post_init__(self):
        if self.radius > MOST_RADIUS:
            object.__setattr__(self, "radius", MOST_RADIUS)
            object.__setattr__(self, "warnings", (*self.warnings, Status.RADIUS_CUT))
        if self.ndim not in (1, 2, 3):
            raise PipelineError(Status.BAD_DIMENSION, str(self.ndim))
        if self.predictor not in ("lorenzo", "prototype", "spline"):
            raise PipelineError(Status.NO_PREDICTOR, self.predictor)
        if self.predictor == "spline" and (self.ndim != 3 or self.zigzag):
            raise PipelineError(Status.BAD_DIMENSION, "splines are for three dimensions and plain codes")
        if not self.eb > 0 or self.mode not in ("abs", "rel", "r2r"):
            raise PipelineError(Status.BAD_BOUND, f"{self.eb} {self.mode}")
        if self.codec not in ("huffman", "fz", "none"):
            raise PipelineError(Status.NO_CODEC, self.codec)

    @property
    def tiles(self) -> tuple[int, ...]:
        if self.predictor == "spline":
            return spline.BLOCK
        return self.tile or (predict.PRODUCTION if self.predictor == "lorenzo" else predict.PROTOTYPE)[self.ndim]

    @property
    def levels(self) -> spline.Levels:
        return spline.Levels(self.alpha, self.beta)


def predicted(field: DataFrame, cfg: Config) -> DataFrame:
    """The field with eb, q, d and code; with splines: eb, code, the values of outliers and a block's anchors."""
    fields.check_dtype(field, "v")
    f = fields.with_error_bound(field, cfg.eb, cfg.mode)
    # a constant field has no range: any bound will do
    f = f.withColumn("eb", F.when(F.col("eb") > 0, F.col("eb")).otherwise(F.lit(1e-12)))
    if cfg.predictor == "spline":
        e = spline.encode(f, cfg.radius, cfg.levels)
        return fields.beside(e, f.groupBy("field_id").agg(F.max("eb").alias("eb")))
    f = predict.forward(f.withColumn("q", quant.prequantize(F.col("v"), F.col("eb"))), cfg.tiles)
    code = quant.postquantize_zigzag if cfg.zigzag else quant.postquantize
    return f.withColumn("code", code(F.col("d"), cfg.radius))


def analyze(field: DataFrame, cfg: Config) -> DataFrame:
    """The dense histogram of codes, without encoding."""
    return hist.densify(hist.histogram(predicted(field, cfg)), 2 * cfg.radius)


@dataclass
class Archive:
    """Tables of compressed fields; write() and read_archive() keep them as Parquet."""

    header: DataFrame
    chunks: DataFrame
    book: DataFrame | None
    outliers: DataFrame
    cfg: Config
    anchors: DataFrame | None = None
    #: The predicted codes that all tables are made of.
    source: DataFrame | None = None

    def write(self, path: str) -> None:
        """Codes are kept (with spill) while the tables are written, and let go then."""
        if self.source is not None:
            self.source.persist()
        try:
            self.header.write.parquet(f"{path}/header")
            self.chunks.write.partitionBy("field_id").parquet(f"{path}/chunks")
            self.outliers.write.parquet(f"{path}/outliers")
            for name, table in (("book", self.book), ("anchors", self.anchors)):
                if table is not None:
                    table.write.parquet(f"{path}/{name}")
        finally:
            if self.source is not None:
                self.source.unpersist()


def read_archive(spark, path: str) -> Archive:
    header = spark.read.parquet(f"{path}/header")
    h = header.select("mode", "radius", "ndim", "predictor", "zigzag", "codec", "tile", "user_eb", "alpha", "beta").first()  # all fields of an archive share these
    if h is None:
        raise PipelineError(Status.NOT_AN_ARCHIVE, path)
    cfg = Config(h["user_eb"], h["mode"], h["radius"], h["ndim"], h["predictor"], h["zigzag"], h["codec"], tuple(h["tile"]), h["alpha"], h["beta"])
    chunks = spark.read.parquet(f"{path}/chunks").withColumn("field_id", F.col("field_id").cast("string"))
    book = spark.read.parquet(f"{path}/book") if cfg.codec == "huffman" else None
    anchors = spark.read.parquet(f"{path}/anchors") if cfg.predictor == "spline" else None
    return Archive(header, chunks, book, spark.read.parquet(f"{path}/outliers"), cfg, anchors)


def compress(field: DataFrame, cfg: Config) -> Archive:
    """The tables of an archive, all made of the same predicted codes.  Header and books (some rows a field) are computed
    here, the rest as it is used."""
    p = predicted(field, cfg)
    splines = cfg.predictor == "spline"
    if splines:
        outliers, anchors = p.filter("val is not null").select("field_id", "i", "val"), p.filter("anchors is not null").select("field_id", "bx", "by", "bz", "anchors")
        out = F.col("val").isNotNull()
    else:
        outliers, anchors = sparse.gather(p, cfg.radius), None
        out = F.abs(F.col("d")) >= cfg.radius
    if cfg.zigzag:
        outliers = outliers.withColumn("val", F.col("val") - cfg.radius)
    lo_hi = p.groupBy("field_id").agg(F.count("*").alias("n"), F.max("x").alias("mx"), F.max("y").alias("my"), F.max("z").alias("mz"), F.max("eb").alias("eb"), F.count_if(out).alias("n_outliers"))
    lo_hi = fields.beside(lo_hi, fields.value_range(field).select("field_id", F.col("lo").alias("min_v"), F.col("hi").alias("max_v")))
    header = lo_hi.select(
        "field_id", "n", (F.col("mx") + 1).alias("lx"), (F.col("my") + 1).alias("ly"), (F.col("mz") + 1).alias("lz"), "min_v", "max_v", "eb", "n_outliers",
        F.when(F.col("n_outliers") >= F.col("n") * sparse.MOST_OUTLIERS, Status.MANY_OUTLIERS.name).otherwise(Status.OK.name).alias("status"),
        F.lit(cfg.eb).alias("user_eb"), F.lit(cfg.mode).alias("mode"), F.lit(cfg.radius).alias("radius"), F.lit(cfg.ndim).alias("ndim"), F.lit(cfg.predictor).alias("predictor"),
        F.lit(cfg.zigzag).alias("zigzag"), F.lit(cfg.codec).alias("codec"), F.array(*[F.lit(t) for t in cfg.tiles]).alias("tile"), F.lit(field.schema["v"].dataType.simpleString()).alias("dtype"),
        F.lit(cfg.alpha).alias("alpha"), F.lit(cfg.beta).alias("beta"),
    )
    header = fields.counted(header)[0]
    codes = p.select("field_id", "i", "code")
    if cfg.codec == "huffman":
        book = fields.counted(huffman.books(hist.histogram(codes)))[0]
        return Archive(header, huffman.encode(codes, book), book, outliers, cfg, anchors, p)
    return Archive(header, fz.encode(codes) if cfg.codec == "fz" else codes, None, outliers, cfg, anchors, p)


def decoded_codes(a: Archive) -> DataFrame:
    if a.cfg.codec == "huffman":
        return huffman.decode(a.chunks, a.book)
    return fz.decode(a.chunks) if a.cfg.codec == "fz" else a.chunks


def decompress(a: Archive) -> DataFrame:
    """field_id, i, x, y, z, v."""
    cfg = a.cfg
    c = fields.beside(decoded_codes(a), a.header.select("field_id", "lx", "ly", "eb"))
    c = c.withColumn("x", F.col("i") % F.col("lx")).withColumn("y", F.floor(F.col("i") / F.col("lx")) % F.col("ly")).withColumn("z", F.floor(F.col("i") / (F.col("lx") * F.col("ly"))))
    if cfg.predictor == "spline":
        return spline.decode(c, a.outliers, a.anchors, cfg.radius, cfg.levels)
    c = sparse.scatter(c, a.outliers)
    d = F.when(F.col("val").isNotNull(), F.col("val")).otherwise(quant.unzigzag(F.col("code").cast("bigint"))) if cfg.zigzag else quant.fuse(F.col("code").cast("bigint"), F.col("val"), cfg.radius)
    c = c.withColumn("d", d)
    q = predict.inverse(c, cfg.tiles)
    return q.select("field_id", "i", "x", "y", "z", quant.dequantize(F.col("q"), F.col("eb")).alias("v"))


def assess(field: DataFrame, back: DataFrame) -> DataFrame:
    return stats.assess(stats.paired(field, back))


def sizes(a: Archive) -> DataFrame:
    """Bytes by part of the archive, and the ratio to the raw field."""
    width = F.when(F.col("dtype") == "float", 4).otherwise(8)
    payload = F.sum(F.length("payload")) if a.cfg.codec == "huffman" else F.sum(F.length("payload") + F.length("flags")) if a.cfg.codec == "fz" else F.count("*") * 2
    c = a.chunks.groupBy("field_id").agg(payload.alias("code_bytes"))
    h = a.header.select("field_id", (F.col("n") * width).alias("raw_bytes"), (F.col("n_outliers") * 12).alias("outlier_bytes")).join(c, "field_id")
    if a.book is not None:
        h = h.join(a.book.groupBy("field_id").agg((F.count("*") * 8).alias("book_bytes")), "field_id")
    if a.anchors is not None:
        h = h.join(a.anchors.groupBy("field_id").agg(F.sum(F.size("anchors") * 8).alias("anchor_bytes")), "field_id")
    return stats.report(h)


def lengths(a: Archive) -> DataFrame:
    """What a header says of its fields: elements, lengths of the axes, bytes before compression, outliers, status."""
    width = F.when(F.col("dtype") == "float", 4).otherwise(8)
    return a.header.select("field_id", "n", "lx", "ly", "lz", (F.col("n") * width).alias("raw_bytes"), "eb", "n_outliers", "status")


def report(field: DataFrame, a: Archive) -> DataFrame:
    """Quality of what an archive gives back beside the bytes that it takes: a row a field."""
    q = assess(field, decompress(a))
    return fields.beside(q, sizes(a)).withColumn("bits_per_value", 8.0 * F.col("total_bytes") / F.col("n"))


def dump(a: Archive, path: str) -> None:
    """The codes and their dense histogram as tables, for a look at what was predicted."""
    codes = decoded_codes(a)
    codes.write.parquet(f"{path}/codes")
    hist.densify(hist.histogram(codes), 2 * a.cfg.radius).write.parquet(f"{path}/histogram")
