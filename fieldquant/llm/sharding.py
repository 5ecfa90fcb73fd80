"""Fixed-capacity shards by best-fit-decreasing bin packing.

Groups (documents of equal text) are indivisible.  Items are sorted by size and
each goes into the bin with the tightest remaining capacity, found in a balanced
tree of capacities.  Groups of a fixed share of a bin or more are items of their
own; there are few of them by arithmetic.  Smaller ones are put together first:

* ``balance`` (a given number of shards, by bisection the least capacity for which
  they are enough): by hash, over as many units as a shard may have items.  The
  number of items follows the number of shards, and the driver packs them.
* ``capacity``: into grains of 1/256 of a bin at most, so an item never exceeds a bin
  that its groups would fit.  Groups are dealt by hash over cells of some 64 bins,
  each packed in a task of its own; the bins that a cell leaves half empty (one at
  most) are packed together afterwards.  Nothing reaches the driver.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ship

#: A group of more than 1/LARGE of a bin is packed by itself.
LARGE = 512
#: Items of a balanced packing (large groups, and as many units): LARGE becomes less with more shards.
ITEMS, MOST_SHARDS = 1 << 15, 1 << 12
#: Bins of a cell.
CELL = 64
#: Hash buckets in which the rows of a shard are numbered.
ROWS = 1024


class Capacities:
    """A treap of (remaining capacity, bin): insert, and take the least that is at least x, in O(log n)."""

    def __init__(self, seed: int = 0):
        self._root = None
        self._rng = random.Random(seed)

    @staticmethod
    def _split(t, key):
        """Nodes below key, nodes from key on; a node is [key, priority, left, right]."""
        low, high = [None], [None]
        at_low, at_high = (low, 0), (high, 0)
        while t is not None:
            if t[0] < key:
                at_low[0][at_low[1]] = t
                at_low, t = (t, 3), t[3]
            else:
                at_high[0][at_high[1]] = t
                at_high, t = (t, 2), t[2]
        at_low[0][at_low[1]] = None
        at_high[0][at_high[1]] = None
        return low[0], high[0]

    @staticmethod
    def _merge(a, b):
        out = [None]
        at = (out, 0)
        while a is not None and b is not None:
            if a[1] < b[1]:
                at[0][at[1]] = a
                at, a = (a, 3), a[3]
            else:
                at[0][at[1]] = b
                at, b = (b, 2), b[2]
        at[0][at[1]] = a if b is None else b
        return out[0]

    def insert(self, capacity: int, bin_: int) -> None:
        a, b = self._split(self._root, (capacity, bin_))
        self._root = self._merge(self._merge(a, [(capacity, bin_), self._rng.random(), None, None]), b)

    def take(self, x: int) -> tuple[int, int] | None:
        a, b = self._split(self._root, (x, -1))
        if b is None:
            self._root = a
            return None
        parent, t = None, b
        while t[2] is not None:
            parent, t = t, t[2]
        if parent is None:
            b = t[3]
        else:
            parent[2] = t[3]
        self._root = self._merge(a, b)
        return t[0]


def pack(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """(bin of each item, number of bins); an item above the capacity gets a bin of its own."""
    free, bins, out = Capacities(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = free.take(sizes[i])
        if got is None:
            got = (max(capacity, sizes[i]), bins)
            bins += 1
        out[i] = got[1]
        free.insert(got[0] - sizes[i], got[1])
    return out, bins


def balance(sizes: list[int], shards: int) -> list[int]:
    """Bins 0..shards-1 of near equal sizes: the least capacity with which best fit needs no more bins.

    An item above the mean of what is left has a bin to itself, and the rest is
    balanced over the other bins.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, rest, alone = [0] * len(sizes), sum(sizes), 0
    while alone < min(len(order), shards - 1) and sizes[order[alone]] * (shards - alone) > rest:
        out[order[alone]] = alone
        rest -= sizes[order[alone]]
        alone += 1
    order = order[alone:]
    left, bins = [sizes[i] for i in order], shards - alone
    if not left:
        return out
    low = max(left[0], -(-rest // bins))
    high = left[0] + -(-rest // bins)  # best fit opens a bin only if all others hold more than high - left[0]
    best = pack(left, high)[0]
    while low < high:
        mid = (low + high) // 2
        got, used = pack(left, mid)
        if used <= bins:
            best, high = got, mid
        else:
            low = mid + 1
    for i, b in zip(order, best):
        out[i] = alone + b
    return out


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("bigint")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", _key(F.col("text")).alias("__s_key"), _size(F.col("text")).alias("__s_size"), F.crc32(text.cast("binary")).alias("__s_crc"))


def assign(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, __s_key, __s_size, __s_crc, shard of every row: either `shards` balanced shards, or as few as `capacity` bytes allow."""
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    return by_capacity(docs, capacity, scratch) if capacity else balanced(docs, shards, scratch)


def balanced(docs: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"1 to {MOST_SHARDS} balanced shards; use a capacity for more")
    large_share = max(8, min(LARGE, ITEMS // shards))
    n_units = large_share * shards
    unit = lambda key: F.pmod(F.xxhash64(key), F.lit(n_units)).cast("int")
    rows = scratch.write(_rows(docs), "rows")  # texts are hashed once
    groups = rows.groupBy("__s_key").agg(F.sum("__s_size").alias("bytes"))
    total = rows.agg(F.sum("__s_size").alias("n")).first()["n"] or 0
    room = -(-total // shards) or 1
    large = {r["__s_key"]: r["bytes"] for r in groups.filter(F.col("bytes") * large_share > room).collect()}  # fewer than n_units
    spark = docs.sparkSession
    names = spark.createDataFrame([(k,) for k in large], "__s_large string")
    small = groups.join(F.broadcast(names), F.col("__s_key") == F.col("__s_large"), "left_anti")
    units = {r["u"]: r["bytes"] for r in small.groupBy(unit(F.col("__s_key")).alias("u")).agg(F.sum("bytes").alias("bytes")).collect()}  # at most n_units
    items = [*sorted(large), *sorted(units)]
    of = dict(zip(items, balance([large[i] if isinstance(i, str) else units[i] for i in items], shards)))
    table_large = spark.createDataFrame([(k, of[k]) for k in sorted(large)], "__s_large string, __s_bin int")
    table_units = spark.createDataFrame([(u, of[u]) for u in sorted(units)], "__s_u int, __s_ubin int")
    placed = rows.join(F.broadcast(table_large), F.col("__s_key") == F.col("__s_large"), "left")
    placed = placed.withColumn("__s_unit", unit(F.col("__s_key"))).join(F.broadcast(table_units), F.col("__s_unit") == F.col("__s_u"), "left")
    return placed.select("doc_id", "__s_key", "__s_size", "__s_crc", F.coalesce("__s_bin", "__s_ubin").alias("shard"))


def by_capacity(docs: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """Shards of at most `capacity` bytes (one group above it: a shard of its own), numbered from 0 without gaps."""
    if capacity < 1:
        raise ValueError("a capacity of at least one byte")
    ship(docs.sparkSession)
    rows = scratch.write(_rows(docs), "rows")
    total = rows.agg(F.sum("__s_size").alias("n")).first()["n"] or 0
    cells = max(1, -(-total // (capacity * CELL)))
    h = F.xxhash64("__s_key")
    groups = rows.groupBy("__s_key").agg(F.sum("__s_size").alias("bytes")).withColumn("cell", F.pmod(h, F.lit(cells)))
    groups = groups.withColumn("u", F.when(F.col("bytes") * LARGE <= capacity, F.pmod(F.xxhash64(F.lit("u"), "__s_key"), F.lit(LARGE * CELL))))
    # small groups in a row, cut where a grain is full; a unit holds some capacity / LARGE bytes
    line = Window.partitionBy("cell", "u").orderBy("__s_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(line), F.lit(0))
    item = F.when(F.col("u").isNull(), F.col("__s_key")).otherwise(F.concat_ws(":", "u", F.floor(before * LARGE / capacity).cast("bigint")))
    groups = scratch.write(groups.withColumn("item", item).select("__s_key", "cell", "item", "bytes"), "groups")

    def best_fit(t: pa.Table) -> pa.Table:
        sizes = t.column("bytes").to_pylist()
        order = sorted(range(len(sizes)), key=lambda i: t.column("item")[i].as_py())  # reruns agree
        bins = pack([sizes[i] for i in order], capacity)[0]
        fill: dict[int, int] = {}
        for i, b in zip(order, bins):
            fill[b] = fill.get(b, 0) + sizes[i]
        out = dict(zip(order, bins))
        return t.drop_columns(["bytes"]).append_column("bin", pa.array([out[i] for i in range(len(sizes))], pa.int64())).append_column("fill", pa.array([fill[out[i]] for i in range(len(sizes))], pa.int64()))

    items = groups.groupBy("cell", "item").agg(F.sum("bytes").alias("bytes"))
    packed = scratch.write(items.groupBy("cell").applyInArrow(best_fit, "cell bigint, item string, bin bigint, fill bigint"), "packed")
    bins = packed.select("cell", "bin", "fill").distinct()

    def together(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("cell").to_pylist(), t.column("bin").to_pylist(), t.column("fill").to_pylist()))
        host: dict[int, tuple] = {}
        out = []
        for (c, b, _), k in zip(rows, pack([f for *_, f in rows], capacity)[0]):
            out.append((c, b, *host.setdefault(k, (c, b))))
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("cell", "bin", "to_cell", "to_bin"))})

    many = max(1, cells // ITEMS)
    light = bins.filter(F.col("fill") * 2 <= capacity).groupBy(F.pmod("cell", F.lit(many))).applyInArrow(together, "cell bigint, bin bigint, to_cell bigint, to_bin bigint")
    light = scratch.write(light, "light", narrow=True)
    final = packed.join(light, ["cell", "bin"], "left").select("cell", "item", F.coalesce("to_cell", "cell").alias("c"), F.coalesce("to_bin", "bin").alias("b"))
    final = scratch.write(final, "final")
    # numbers: the bins of the cells before, then those of the cell
    hosts = final.select("c", "b").distinct()
    sums = hosts.groupBy("c").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a cell
    numbers = hosts.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("b"))).join(sums.select("c", "before"), "c").select("c", "b", (F.col("before") + F.col("k") - 1).cast("int").alias("shard"))
    of = groups.join(final.join(numbers, ["c", "b"]), ["cell", "item"]).select(F.col("__s_key").alias("__s_k"), "shard")
    return rows.join(of, F.col("__s_key") == F.col("__s_k")).drop("__s_k")


def shards(docs: DataFrame, n: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row of docs.

    Equal texts share a shard; null counts as the empty text.  Slots are gapless
    from 0 within a shard: by hash bucket of the doc_id, then doc_id.  Repeated
    rows get slots of their own; an empty table gives an empty one; further
    columns are ignored.  A group larger than a shard's share has a shard that
    is larger by as much.
    """
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    placed = assign(docs, n, scratch=scratch).withColumn("__s_row", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("__s_key")), F.lit(ROWS)).cast("int"))
    placed = scratch.write(placed.select("doc_id", "__s_size", "__s_crc", "shard", "__s_row"), "placed")
    cells = placed.groupBy("shard", "__s_row").agg(F.count("*").alias("n"))  # at most n * ROWS rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__s_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col("shard").alias("__s_s"), F.col("__s_row").alias("__s_r"), before.cast("bigint").alias("__s_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "__s_row").orderBy("doc_id", "__s_size", "__s_crc"))
    out = placed.withColumn("__s_rank", rank).join(F.broadcast(cells), (F.col("shard") == F.col("__s_s")) & (F.col("__s_row") == F.col("__s_r")))
    return out.select("doc_id", F.col("__s_size").alias("size"), F.col("__s_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("__s_before") + F.col("__s_rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
