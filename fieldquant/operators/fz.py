"""Bit-plane shuffling with removal of zero groups.

Two 16-bit codes make a word; 32 words are a 32 x 32 bit matrix whose transpose
holds one word a bit plane.  1024 words are a chunk; of its transposed words,
groups of four that are all zero are dropped and remembered by a flag.  words()
and transpose() are expressions on long rows; encode() and decode() do the same for
chunks as arrays, with one shuffle by chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship

WORDS, LANES, GROUP = 1024, 32, 4


def words(df: DataFrame, code: str = "code") -> DataFrame:
    """field_id, w, word: codes 2w and 2w + 1 (the latter in the upper half)."""
    half = F.when(F.col("i") % 2 == 0, F.col(code).cast("bigint")).otherwise(F.shiftleft(F.col(code).cast("bigint"), 16))
    return df.groupBy("field_id", F.floor(F.col("i") / 2).alias("w")).agg(F.sum(half).alias("word"))


def transpose(w: DataFrame, word: str = "word") -> DataFrame:
    """field_id, chunk, pos, word: the words of the bit planes.  Its own inverse: 32 planes of 32 lanes swap places."""
    lane, row = F.col("w") % LANES, F.floor(F.col("w") / LANES)
    bits = w.select("field_id", row.alias("row"), lane.alias("lane"), F.col(word).alias("word"), F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("bit"))
    one = bits.select("field_id", "row", "lane", "bit", F.expr("(word >> bit) & 1").alias("x")).filter("x = 1")
    t = one.groupBy("field_id", "row", "bit").agg(F.sum(F.expr("1L << cast(lane as int)")).alias("word"))
    return t.select("field_id", (F.col("row") * LANES + F.col("bit")).alias("w"), "word")


def _swapped(w: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 32 words, and back."""
    bits = np.unpackbits(w.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, LANES, LANES)
    return np.packbits(bits.transpose(0, 2, 1), axis=None, bitorder="little").view("<u4")


def encode_chunk(codes: np.ndarray) -> tuple[bytes, bytes]:
    """(flags, one bit a group; the groups with a bit set) of up to 2 * WORDS codes."""
    full = np.zeros(2 * WORDS, "<u2")
    full[: len(codes)] = codes
    groups = _swapped(full.view("<u4")).reshape(-1, GROUP)
    live = groups.any(axis=1)
    return np.packbits(live, bitorder="little").tobytes(), groups[live].tobytes()


def decode_chunk(flags: bytes, payload: bytes, n: int) -> np.ndarray:
    groups = np.zeros((WORDS // GROUP, GROUP), "<u4")
    groups[np.unpackbits(np.frombuffer(flags, np.uint8), bitorder="little").astype(bool)] = np.frombuffer(payload, "<u4").reshape(-1, GROUP)
    return _swapped(groups.reshape(-1)).view("<u2")[:n]


def encode(df: DataFrame, code: str = "code") -> DataFrame:
    """field_id, chunk, n (codes), flags, payload; indices of a field are dense from 0."""
    ship(df.sparkSession)
    d = df.select("field_id", "i", F.col(code).cast("int").alias("code"), F.floor(F.col("i") / (2 * WORDS)).alias("chunk"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        flags, payload = encode_chunk(t.column("code").to_numpy())
        return pa.table({"field_id": t.column("field_id").slice(0, 1), "chunk": t.column("chunk").slice(0, 1), "n": pa.array([len(t)], pa.int32()), "flags": pa.array([flags], pa.binary()), "payload": pa.array([payload], pa.binary())})

    return d.groupBy("field_id", "chunk").applyInArrow(run, "field_id string, chunk bigint, n int, flags binary, payload binary")


def starts(chunks: DataFrame) -> DataFrame:
    """Adds start: bytes of the field's payloads before each chunk (one row a chunk in a window)."""
    w = Window.partitionBy("field_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum(F.length("payload").cast("bigint")).over(w), F.lit(0)))


def sizes(chunks: DataFrame) -> DataFrame:
    """field_id, chunk, kept groups, bytes with the flags: what the encoded chunk takes."""
    kept = (F.length("payload") / (4 * GROUP)).cast("bigint")
    return chunks.select("field_id", "chunk", kept.alias("kept"), (F.length("payload") + F.length("flags")).cast("bigint").alias("bytes")).filter("kept > 0")


def decode(chunks: DataFrame) -> DataFrame:
    """field_id, i, code."""
    ship(chunks.sparkSession)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                codes = decode_chunk(*(b.column(c)[r].as_py() for c in ("flags", "payload", "n")))
                first = b.column("chunk")[r].as_py() * 2 * WORDS
                yield pa.RecordBatch.from_arrays([pa.array([b.column("field_id")[r].as_py()] * len(codes), pa.string()), pa.array(np.arange(first, first + len(codes))), pa.array(codes.astype(np.int32))], names=["field_id", "i", "code"])

    return chunks.select("field_id", "chunk", "n", "flags", "payload").mapInArrow(run, "field_id string, i bigint, code int")
