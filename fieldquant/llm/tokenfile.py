"""A binary file of token ids: Stream-VByte blocks over frequency-ranked ids.

Layout: a folder that Spark's file systems can write, so writes are atomic and any
storage will do, with three tables, ``header`` (a row: format, end id, number of
documents, ids and ranks), ``ranks`` and ``blocks``.  ``write(..., to=path)`` makes it and
``open_file(spark, path)`` reads it.  Of a block, ``part``, ``block`` and ``start`` (ids of
the part before the block) place a block; ``doc_ids`` and ``lens`` name its
documents; ``ctrl`` holds two bits per value (its bytes minus one, four values a
byte), ``data`` the values' bytes.  A value is the *rank* of an id by frequency,
so the 256 most frequent ids take one byte each.

Rows are put in ascending order of doc_id by one range partitioning of the
encoded ids; a part's first offset is the sum of the parts before it (one number
a part reaches the driver).
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import broadcast_spec, codec_of
from .common import Scratch, one_array, resting, slices

#: Bytes of text that are encoded at a time, and words that a worker remembers.
SLICE, KNOWN = 6 << 20, 400_000
#: What the header says.
FORMAT = "ranked stream-vbyte 1"
#: Ids in a block, but that a document is never split between blocks.
BLOCK_IDS = 1 << 18

_LEN = 1 + ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3)  # bytes of each of the four values
_TOTAL = _LEN.sum(axis=1)
_AT = np.cumsum(_LEN, axis=1) - _LEN
_TAKE = np.where(np.arange(4) < _LEN[:, :, None], _AT[:, :, None] + np.arange(4), 16).reshape(256, 16)  # 16: a zero byte


def vbyte_encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    quad = code.reshape(-1, 4)
    ctrl = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return ctrl.tobytes(), data.tobytes()


def vbyte_decode(ctrl: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values: one table row for each control byte says which bytes to take."""
    c = np.frombuffer(ctrl, np.uint8)
    if not len(c):
        return np.zeros(0, np.uint32)
    total = _TOTAL[c]
    begin = np.cumsum(total) - total
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(17, np.uint8)])
    take = _TAKE[c]
    got = d[begin[:, None] + np.minimum(take, 15)]
    got[take == 16] = 0
    return got.reshape(-1, 4).view("<u4").reshape(-1)[:n]


def vocabulary_size(spec: str, end_id: int) -> int:
    j = json.loads(spec)
    return max([end_id, *j["model"]["vocab"].values(), *(t["id"] for t in j["added_tokens"])]) + 1


def width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids binary, counts binary): a row a document; a row a task that has the counts of its ids."""
    spec = broadcast_spec(docs.sparkSession, path)

    def run(batches):
        codec = codec_of(spec)
        codec.KNOWN = KNOWN
        size = max(codec.size, end_id + 1)
        wide = width(size)
        counts = np.zeros(size, np.int64)
        for big in batches:
            for b in slices(big, most=SLICE):
                ids, bounds = codec.encode_batch(one_array(b.column("text")))
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                counts += np.bincount(ids, minlength=size)
                flat = ids.astype(wide)
                at = pa.py_buffer((bounds * flat.itemsize).astype(np.int32))
                column = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, at, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), column, pa.nulls(b.num_rows, pa.binary())], names=["doc_id", "ids", "counts"])
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["doc_id", "ids", "counts"])

    sql = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(resting(run, "bpe"), f"doc_id {sql}, ids binary, counts binary")


def _frequencies(encoded: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for x in b.column("counts").to_pylist():
                n = np.frombuffer(x, "<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["id", "n"])

    return encoded.filter(F.col("counts").isNotNull()).select("counts").mapInArrow(resting(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


class TokenFile:
    """A written file; ``blocks`` and ``ranks`` are its tables."""

    def __init__(self, blocks: DataFrame, ranks: DataFrame):
        self.blocks, self.ranks = blocks, ranks

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document."""
        return self._decoded(True)

    def digest(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the file."""
        return self._decoded(False)

    def _decoded(self, whole: bool) -> DataFrame:
        spark = self.blocks.sparkSession
        ids = [r.id for r in self.ranks.orderBy("rank").collect()]  # as many as the vocabulary has at most
        table = spark.sparkContext.broadcast(np.array(ids, dtype="<u4"))
        before, at = {}, 0
        for r in self.blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a part
            before[r.part] = at
            at += r.n
        offsets = spark.sparkContext.broadcast(before)

        def run(batches):
            id_of = table.value
            for big in batches:
                for k in range(big.num_rows):
                    r = {c: big.column(c)[k].as_py() for c in ("part", "start", "n", "ctrl", "data")}
                    got = id_of[vbyte_decode(r["ctrl"], r["data"], r["n"])].astype("<u4")
                    docs = big.column("doc_ids")[k].values
                    lens = np.asarray(big.column("lens")[k].values, dtype=np.int64)
                    end = np.cumsum(lens)
                    start = end - lens + (r["start"] + offsets.value[r["part"]])
                    raw = memoryview(got.tobytes())
                    parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(end.tolist(), lens.tolist())]
                    last = pa.array([bytes(p) for p in parts], pa.binary()) if whole else pa.array([zlib.crc32(p) for p in parts], pa.int64())
                    yield pa.RecordBatch.from_arrays([docs, pa.array(start), pa.array(lens), last], names=names)

        names = ["doc_id", "start", "n_tokens", "ids" if whole else "ids_crc32"]
        sql = self.blocks.schema["doc_ids"].dataType.elementType.simpleString()
        return self.blocks.mapInArrow(resting(run), f"doc_id {sql}, start bigint, n_tokens bigint, {names[3]} {'binary' if whole else 'bigint'}")


def open_file(spark: SparkSession, path: str) -> TokenFile:
    """A file that write(..., to=path) has written; ValueError if it is of another format."""
    path = path.rstrip("/")
    header = spark.read.parquet(f"{path}/header").first()
    if header is None or header["format"] != FORMAT:
        raise ValueError(f"no token file of format {FORMAT}: {path}")
    out = TokenFile(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/ranks"))
    out.header = header.asDict()
    return out


def write(docs: DataFrame, path: str, scratch: Scratch, end_id: int = 0, to: str | None = None) -> TokenFile:
    """Encodes every text, appends end_id and writes the file in ascending doc_id order.

    path: the tokenizer; to: a folder that doesn't exist yet (else the shared
    folder, until the session ends).  Null text: only the end id.  Null doc_ids
    come first; rows of one doc_id follow each other in the order of their ids'
    bytes, repeated rows stay repeated.  An empty table gives an empty file.
    Further columns are ignored.
    """
    spark = docs.sparkSession
    encoded = scratch.write(_encoded(docs, path, end_id), "encoded")
    counted = [(r.id, r.n) for r in _frequencies(encoded).collect()]  # as many as the vocabulary has at most
    by_rank = [i for i, _ in sorted(counted, key=lambda x: (-x[1], x[0]))]
    ranks = spark.createDataFrame([(k, i) for k, i in enumerate(by_rank)], "rank bigint, id bigint").coalesce(1)
    rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    table = spark.sparkContext.broadcast(rank_of)
    with open(path, encoding="utf-8") as f:
        wide = width(vocabulary_size(f.read(), end_id))

    def run(batches):
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        held, lens, docs_held, size = [], [], [], 0

        def flush():
            nonlocal block, start, held, lens, docs_held
            v = table.value[np.concatenate(held)] if held else np.zeros(0, np.uint32)
            ctrl, data = vbyte_encode(v)
            out = pa.RecordBatch.from_pylist([{"part": part, "block": block, "start": start, "n": len(v), "doc_ids": docs_held, "lens": lens, "ctrl": ctrl, "data": data}], schema=schema)
            block, start = block + 1, start + len(v)
            held, lens, docs_held = [], [], []
            return out

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                ids = np.frombuffer(x.as_buffer(), wide)
                held.append(ids)
                lens.append(len(ids))
                docs_held.append(d)
                size += len(ids)
                if len(lens) >= 1 << 14 or size >= BLOCK_IDS:
                    yield flush()
                    size = 0
        if lens:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    sql = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(docs.schema["doc_id"].dataType))), ("lens", pa.list_(pa.int32())), ("ctrl", pa.binary()), ("data", pa.binary())])
    ordered = encoded.filter(F.col("counts").isNull()).select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = ordered.mapInArrow(resting(run), f"part int, block int, start bigint, n bigint, doc_ids array<{sql}>, lens array<int>, ctrl binary, data binary")
    root = (to or f"{scratch.root}/tokens-{uuid.uuid4().hex}").rstrip("/")
    blocks.write.option("compression", "snappy").parquet(f"{root}/blocks")
    ranks.write.parquet(f"{root}/ranks")
    sums = spark.read.parquet(f"{root}/blocks").agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    row = (FORMAT, end_id, sums["d"], sums["n"], len(by_rank))
    # the header comes last: a folder without one is no whole file
    spark.createDataFrame([row], "format string, end_id int, n_docs bigint, n_ids bigint, n_ranks int").coalesce(1).write.parquet(f"{root}/header")
    scratch.drop(encoded)
    return open_file(spark, root)
