"""Canonical Huffman coding of codes, one book a field, one bit stream a chunk.

Books come from at most 2 * radius rows a field.  Ties are broken by symbol, so
books are reproducible.  A field with one symbol gets a code of one bit, and words
have up to 58 bits, so no histogram is out of reach.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from ..sources.fields import beside

CHUNK = 4096
MOST_BITS = 58


def code_lengths(freq: dict[int, int]) -> dict[int, int]:
    """Bits of each symbol with a count."""
    live = sorted((n, s) for s, n in freq.items() if n > 0)
    if len(live) == 1:
        return {live[0][1]: 1}
    heap = [(n, k, (s,)) for k, (n, s) in enumerate(live)]
    out = dict.fromkeys((s for _, s in live), 0)
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        n1, _, a = heapq.heappop(heap)
        n2, _, b = heapq.heappop(heap)
        for s in (*a, *b):
            out[s] += 1
        heapq.heappush(heap, (n1 + n2, k, a + b))
        k += 1
    if out and max(out.values()) > MOST_BITS:
        raise ValueError("a code of more than 58 bits")
    return out


def canonical_words(lengths: dict[int, int]) -> dict[int, int]:
    """Words by (length, symbol): the first word of a length is half of what the longer ones have taken."""
    if not lengths:
        return {}
    most = max(lengths.values())
    count = [0] * (most + 2)
    for n in lengths.values():
        count[n] += 1
    first = [0] * (most + 2)
    for n in range(most - 1, 0, -1):
        first[n] = -(-(first[n + 1] + count[n + 1]) // 2)
    out = {}
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        out[s] = first[n]
        first[n] += 1
    return out


def books(hist: DataFrame) -> DataFrame:
    """field_id, code, freq, len, word."""
    ship(hist.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        freq = dict(zip(t.column("code").to_pylist(), t.column("freq").to_pylist()))
        n = code_lengths(freq)
        w = canonical_words(n)
        s = sorted(n)
        return pa.table({"field_id": pa.array([t.column("field_id")[0].as_py()] * len(s)), "code": pa.array(s, pa.int32()), "freq": pa.array([freq[x] for x in s], pa.int64()), "len": pa.array([n[x] for x in s], pa.int32()), "word": pa.array([w[x] for x in s], pa.int64())})

    return hist.filter("freq > 0").groupBy("field_id").applyInArrow(run, "field_id string, code int, freq bigint, len int, word bigint")


def canonical_book(lengths: DataFrame) -> DataFrame:
    """field_id, code, len, word from complete lengths, in expressions: the first word of a length is
    the sum over longer ones of their number / 2^(difference)."""
    per = lengths.groupBy("field_id", "len").agg(F.count("*").alias("m"))
    longer = per.select(F.col("field_id").alias("__f"), F.col("len").alias("__l"), F.col("m").alias("__m"))
    first = per.join(longer, (F.col("field_id") == F.col("__f")) & (F.col("__l") > F.col("len")), "left").groupBy("field_id", "len").agg(F.coalesce(F.sum(F.col("__m") * F.pow(F.lit(2.0), F.col("len") - F.col("__l"))), F.lit(0.0)).cast("bigint").alias("first"))
    rank = F.row_number().over(Window.partitionBy("field_id", "len").orderBy("code")) - 1
    return lengths.withColumn("r", rank).join(first, ["field_id", "len"]).select("field_id", "code", "len", (F.col("first") + F.col("r")).alias("word"))


def total_bits(book: DataFrame) -> DataFrame:
    """field_id, n, bits, bits a symbol, and the ratio to elements of 32 bits."""
    g = book.groupBy("field_id").agg(F.sum("freq").alias("n"), F.sum(F.col("freq") * F.col("len")).alias("bits"))
    return g.withColumn("avg_bits", F.col("bits") / F.col("n")).withColumn("ratio", 32.0 * F.col("n") / F.col("bits"))


def pack(words: np.ndarray, lens: np.ndarray) -> bytes:
    """Words, most significant bit first, one after the other."""
    end = np.cumsum(lens)
    if not len(end):
        return b""
    at = np.repeat(end, lens) - 1 - np.arange(end[-1])
    return np.packbits((np.repeat(words, lens) >> at) & 1).tobytes()


def unpack(payload: bytes, n: int, words: np.ndarray, lens: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """n symbols: what each bit position would start is looked up for all at once, then all chains of positions are doubled."""
    most = int(lens.max())
    order = np.argsort(words << (most - lens))
    left = (words << (most - lens))[order]
    bits = np.unpackbits(np.frombuffer(payload, np.uint8)).astype(np.int64)
    padded = np.concatenate([bits, np.zeros(most, np.int64)])
    value = np.zeros(len(bits), np.int64)
    for k in range(most):
        value = value << 1 | padded[k : k + len(bits)]
    entry = np.searchsorted(left, value, side="right") - 1
    # jump[p]: where the symbol after 2^k others begins; the last place leads to itself
    jump = np.append(np.minimum(np.arange(len(bits)) + lens[order][entry], len(bits)), len(bits))
    at = np.zeros(1, np.int64)
    while len(at) < n:
        at = np.concatenate([at, jump[at]])
        jump = jump[jump]
    return symbols[order][entry[at[:n]]]


def encode(df: DataFrame, book: DataFrame, code: str = "code", chunk: int = CHUNK) -> DataFrame:
    """field_id, chunk, n, nbit, payload.  A few fields' books are sent to every executor."""
    ship(df.sparkSession)
    d = beside(df.select("field_id", "i", F.col(code).alias("code")), book.select("field_id", "code", "len", "word"), ("field_id", "code"))
    d = d.select("field_id", "i", "len", "word", F.floor(F.col("i") / chunk).alias("chunk"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        lens = t.column("len").to_numpy()
        payload = pack(t.column("word").to_numpy(), lens)
        return pa.table({"field_id": [t.column("field_id")[0].as_py()], "chunk": [t.column("chunk")[0].as_py()], "n": pa.array([len(lens)], pa.int32()), "nbit": pa.array([int(lens.sum())], pa.int64()), "payload": pa.array([payload], pa.binary())})

    return d.groupBy("field_id", "chunk").applyInArrow(run, "field_id string, chunk bigint, n int, nbit bigint, payload binary")


def tuned_chunk(n: int, tasks: int, least: int = 1024, most: int = 65_536) -> int:
    """Codes in a chunk so that a field of n has some eight chunks a task: a multiple of 256 between the bounds."""
    return min(most, max(least, -(-n // (8 * max(1, tasks) * 256)) * 256))


def entries(chunks: DataFrame) -> DataFrame:
    """Adds ncell (32-bit cells) and entry: the cells of a field's chunks before this one."""
    w = Window.partitionBy("field_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("ncell", F.ceil(F.col("nbit") / 32)).withColumn("entry", F.coalesce(F.sum("ncell").over(w), F.lit(0)))


def ratios(chunks: DataFrame, width: int = 4) -> DataFrame:
    """field_id, chunk, ratio: how much each chunk's bits save of elements of so many bytes."""
    return chunks.select("field_id", "chunk", (F.col("n") * (8.0 * width) / F.col("nbit")).alias("ratio"))


def dense(chunks: DataFrame, segment: int = 1024) -> DataFrame:
    """field_id, segment, nbit, ncell, entry (lists over its chunks; entry counts from the field's begin), stream: chunks end
    to end, each filled up to whole 32-bit cells.  A segment is a bounded number of chunks."""
    ship(chunks.sparkSession)
    e = entries(chunks).withColumn("segment", F.floor(F.col("chunk") / segment))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        stream = b"".join(p.ljust(4 * n, b"\0") for p, n in zip(t.column("payload").to_pylist(), t.column("ncell").to_pylist()))
        lists = [pa.array([t.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("n", "nbit", "ncell", "entry")]
        return pa.Table.from_arrays([t.column("field_id").slice(0, 1), t.column("segment").slice(0, 1), *lists, pa.array([stream], pa.binary())], names=["field_id", "segment", "n", "nbit", "ncell", "entry", "stream"])

    kinds = "field_id string, segment bigint, n array<bigint>, nbit array<bigint>, ncell array<bigint>, entry array<bigint>, stream binary"
    return e.select("field_id", "segment", "chunk", "n", "nbit", "ncell", "entry", "payload").groupBy("field_id", "segment").applyInArrow(run, kinds)


def undense(segments: DataFrame, segment: int = 1024) -> DataFrame:
    """The chunks of dense(): field_id, chunk, n, nbit, payload."""
    s = segments.select("field_id", "segment", "stream", F.element_at("entry", 1).alias("first"), F.posexplode(F.arrays_zip("n", "nbit", "ncell", "entry")).alias("k", "c"))
    at = ((F.col("c.entry") - F.col("first")) * 4 + 1).cast("int")
    payload = F.substring("stream", at, F.ceil(F.col("c.nbit") / 8).cast("int"))
    return s.select("field_id", (F.col("segment") * segment + F.col("k")).alias("chunk"), F.col("c.n").cast("int").alias("n"), F.col("c.nbit").alias("nbit"), payload.alias("payload"))


def decode(chunks: DataFrame, book: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """field_id, i, code; indices of a field are dense from 0.  A chunk meets its field's book as one row."""
    ship(chunks.sparkSession)
    rows = book.groupBy("field_id").agg(F.sort_array(F.collect_list(F.struct("code", "len", "word"))).alias("book"))
    both = beside(chunks.select("field_id", "chunk", "n", "payload"), rows)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                book = b.column("book")[r].values
                s, n, w = (book.field(k).to_numpy().astype(np.int64) for k in range(3))
                got = unpack(b.column("payload")[r].as_py(), b.column("n")[r].as_py(), w, n, s)
                first = b.column("chunk")[r].as_py() * chunk
                yield pa.RecordBatch.from_arrays([pa.array([b.column("field_id")[r].as_py()] * len(got), pa.string()), pa.array(np.arange(first, first + len(got))), pa.array(got, pa.int32())], names=["field_id", "i", "code"])

    return both.mapInArrow(run, "field_id string, i bigint, code int")
