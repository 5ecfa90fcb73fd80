"""Headerless binary files of numbers.

    read(spark, path, "f4")                                                  # (i, v), any file system that Spark reads
    register(spark)
    spark.read.format("rawbinary").option("dtype", "f4").load(path)          # the same for paths that executors can open
    df.sortWithinPartitions("i").write.format("rawbinary").option("dtype", "f4").mode("append").save(folder)

A written folder holds parts named by the index of their first element; reading
the folder gives the field back.  Parts appear when the whole write is committed.
Python workers have no Hadoop file system, so writing needs a path that executors
and the driver can open (a shared mount on a cluster).
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..shipping import ship

WIDTH = {"f4": 4, "f8": 8}
RANGE_BYTES = 64 << 20


def _local(path: str) -> str:
    return path[len("file://") :] if path.startswith("file://") else path


class _Range(InputPartition):
    def __init__(self, path: str, first: int, skip: int, n: int):
        self.path, self.first, self.skip, self.n = path, first, skip, n


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = _local(options["path"]), options.get("dtype", "f4")
        if self.kind not in WIDTH:
            raise TypeError(f"unsupported type of a field: {self.kind}")
        self.most = max(1, int(options.get("rangebytes", RANGE_BYTES)) // WIDTH[self.kind])

    def partitions(self):
        names = sorted(f for f in os.listdir(self.path) if f.startswith("part-") and f.endswith(".bin")) if os.path.isdir(self.path) else [""]
        out = []
        for name in names:
            full = os.path.join(self.path, name) if name else self.path
            size = os.path.getsize(full)
            if size % WIDTH[self.kind]:
                raise ValueError(f"{full}: {size} bytes are no whole number of elements")
            n, first = size // WIDTH[self.kind], int(name[5:].split(".")[0]) if name else 0
            out += [_Range(full, first + k, k, min(self.most, n - k)) for k in range(0, n, self.most)]
        return out

    def read(self, part):
        width = WIDTH[self.kind]
        step = 1 << 18
        with open(part.path, "rb") as f:
            f.seek(part.skip * width)
            for k in range(0, part.n, step):
                n = min(step, part.n - k)
                v = np.frombuffer(f.read(n * width), f"<{self.kind}")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + k, part.first + k + n)), pa.array(v)], names=["i", "v"])


class _Message(WriterCommitMessage):
    def __init__(self, parts: list[tuple[str, str]]):
        self.parts = parts


class _Writer(DataSourceArrowWriter):
    """Each run of consecutive indices in a task's rows is one part; rows in order make few parts."""

    def __init__(self, options: dict):
        self.path, self.kind = _local(options["path"]), options.get("dtype", "f4")

    def write(self, batches):
        os.makedirs(self.path, exist_ok=True)
        parts, out, after = [], None, None
        for b in batches:
            i, v = b.column("i").to_numpy(), b.column("v").to_numpy().astype(f"<{self.kind}")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(i) != 1) + 1, [len(i)]]) if len(i) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if out is None or i[lo] != after:
                    if out:
                        out.close()
                    to = os.path.join(self.path, f"part-{i[lo]:020d}.bin")
                    parts.append((f"{to}.{uuid.uuid4().hex}.new", to))
                    out = open(parts[-1][0], "wb")  # noqa: SIM115
                out.write(v[lo:hi].tobytes())
                after = i[hi - 1] + 1
        if out:
            out.close()
        return _Message(parts)

    def commit(self, messages):
        for m in messages:
            for new, to in m.parts if m else []:
                os.replace(new, to)

    def abort(self, messages):
        for m in messages:
            for new, _ in m.parts if m else []:
                if os.path.exists(new):
                    os.remove(new)


class RawBinarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawbinary"

    def schema(self) -> str:
        return f"i bigint, v {'float' if self.options.get('dtype', 'f4') == 'f4' else 'double'}"

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and its code to the executors."""
    ship(spark)
    spark.dataSource.register(RawBinarySource)


#: Elements of a record while files are read through Hadoop.
RECORD = 1 << 16


def read(spark: SparkSession, path: str, dtype: str = "f4") -> DataFrame:
    """(i, v) of a file, or of a folder of parts, on any file system that Spark reads; splits are those of the file system.

    Records are the largest divisor of a file's length up to RECORD elements, since a format of fixed records has no rest.
    """
    if dtype not in WIDTH:
        raise TypeError(f"unsupported type of a field: {dtype}")
    ship(spark)
    width, sc = WIDTH[dtype], spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    folder = fs.getFileStatus(at).isDirectory()
    found = [(s.getPath(), s.getLen()) for s in fs.listStatus(at) if not folder or (s.getPath().getName().startswith("part-") and s.getPath().getName().endswith(".bin"))]
    kind = "float" if dtype == "f4" else "double"
    out = None
    by_size: dict[int, list] = {}
    for p, size in found:
        if size % width:
            raise ValueError(f"{p}: {size} bytes are no whole number of elements")
        if size:
            by_size.setdefault(_record(size // width), []).append((p.toString(), int(p.getName()[5:].split(".")[0]) if folder else 0))

    for n, files in sorted(by_size.items()):
        for name, first in files:
            rdd = sc.newAPIHadoopFile(name, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(n * width)})
            rows = spark.createDataFrame(rdd.map(lambda kv: (kv[0], bytes(kv[1]))), "k bigint, raw binary").select((F.col("k") * n + first).alias("first"), "raw")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], f"i bigint, v {kind}")

    def run(batches):
        for b in batches:
            for first, raw in zip(b.column("first").to_pylist(), b.column("raw")):
                v = np.frombuffer(raw.as_buffer(), f"<{dtype}")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(v))), pa.array(v)], names=["i", "v"])

    return out.mapInArrow(run, f"i bigint, v {kind}")


def _record(n: int) -> int:
    """The largest divisor of n that is no more than RECORD."""
    return max(max(d, n // d if n // d <= RECORD else 1) for d in range(1, min(RECORD, math.isqrt(n)) + 1) if n % d == 0)
