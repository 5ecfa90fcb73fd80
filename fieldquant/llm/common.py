"""Helpers shared by the corpus operators.

* ``Scratch`` keeps intermediate tables in the folder that the cluster names in
  ``spark.checkpoint.dir`` (every executor sees it), so a lost executor costs a
  re-read, never a recomputation of the whole lineage.
* ``ship`` sends the package to the executors, once for a Spark context, and
  bounds the rows of an Arrow batch.
* ``resting`` wraps a function for ``mapInArrow`` so that an idle Python worker
  holds little: workers live on and are reused by later stages.
* ``words_of`` / ``slices`` are the Arrow kernels used inside ``mapInArrow``.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as ship_package

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch at most: whole texts travel in them, and JVM and Python hold a batch each.
BATCH_ROWS = 1000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """The package to the executors; batches of the session are made smaller if they may hold more than BATCH_ROWS rows."""
    ship_package(spark)
    rows = int(spark.conf.get(_ROWS_CONF, "10000"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(_ROWS_CONF, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(text, _UPPER, _LOWER)


def word_count(text: Column) -> Column:
    """Words of a text as bigint; null: 0.  JVM only.

    White space is made one character first, so that the regular expression has
    one simple class to run over and no capture to keep.
    """
    blanks = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(blanks, F.lit("[^ ]+")).cast("bigint")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and driver and executors are one machine."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a shared folder for intermediate tables")
        d = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="fieldquant-shared-"))
        spark.sparkContext.setCheckpointDir(d)
    return d


class Scratch:
    """Tables of one run in the shared folder; removed when the JVM ends."""

    def __init__(self, spark: SparkSession, what: str = "run"):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def _path(self, p: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)

    def write(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None, narrow: bool = False, dealt: bool = False) -> DataFrame:
        """df as a table.  narrow: of ids and numbers only, so an eighth of the partitions that texts need are enough files;
        dealt: it is narrow, but what makes it is not, so its rows are dealt anew instead of making it in fewer tasks."""
        few = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        df = df.repartition(few) if dealt else df.coalesce(few) if narrow else df
        self._n += 1
        at = f"{self.root}/{self._n:03d}-{name}"
        w = df.write.option("compression", codec)
        if self._fs.getUri().getScheme() == "file":  # a mounted folder: no checksum beside each file, each of which is a process started
            w = w.option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true")
        (w.partitionBy(by) if by else w).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop_part(self, df: DataFrame, part: str) -> None:
        """One folder of a table that was written by a column."""
        self._fs.delete(self._path(f"{df._scratch_path}/{part}"), True)
        self.tidy()

    def tidy(self) -> None:
        """Shuffle files of finished queries go as soon as Python and then the driver's JVM have collected their plans."""
        for _ in range(2):  # the first round may come before the query's last event has been heard
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            at = getattr(df, "_scratch_path", None)
            if at:
                self._fs.delete(self._path(at), True)


class Names:
    """Column names of an operator's own: further columns travel as u0, u1, ... and come back under their names."""

    def __init__(self, docs: DataFrame, needed: tuple[str, ...] = ("doc_id", "text", "lang", "source")):
        self.old = docs.columns
        self.new = [c if c in needed else f"u{k}" for k, c in enumerate(self.old)]
        self.docs = docs.toDF(*self.new)

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.new).toDF(*self.old)


# ---------------------------------------------------------------- Arrow kernels

#: Tables that a worker keeps between tasks, by operator.
HELD: dict[str, dict] = {}


def release() -> None:
    """Gives the freed memory of this Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def drop_held(but: str) -> None:
    """Forgets the tables of all operators but one (a function of the module: the worker's own HELD is meant)."""
    for name, held in HELD.items():
        if name != but:
            held.clear()


def resting(run, holds: str = ""):
    """run for mapInArrow; tables that other operators hold go first, and freed memory is given back at the end."""

    @functools.wraps(run)
    def go(batches):
        drop_held(holds)
        yield from run(batches)
        release()

    return go


def one_array(col) -> pa.Array:
    """A chunked or plain column as one contiguous array."""
    if isinstance(col, pa.ChunkedArray):
        return col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20):
    """Row ranges of a batch with at most ``most`` bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text))
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def filled(text: pa.Array) -> pa.Array:
    """Null texts as empty ones, offsets starting anywhere."""
    return pc.fill_null(text, "")


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(bounds, codes, words): document k has codes[bounds[k]:bounds[k + 1]], numbers in words."""
    lists = pc.ascii_split_whitespace(filled(text))
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end gives an empty piece
        sums = np.concatenate([[0], np.cumsum(full)])
        bounds, flat = sums[bounds], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return bounds, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(words))
