"""Near duplicates by MinHash.

1. One map over whole texts gives each document its set of word shingles (as
   hashes), the minima of many universal hash functions over it, and the keys of
   bands of these minima.
2. Equal sets are one vertex from here on, so copies never meet in pairs.
3. In each band bucket everybody is compared with the smallest member: first by
   signatures, then on full sets.  The links' components come from alternating
   large-star and small-star.
4. Buckets that still hold several components are compared blockwise across
   components, whatever their size: signatures first, then the full sets, inside
   the task that holds the two blocks, which gives back only links that join
   components.  Nothing is capped or dropped: after this step any two members of
   a bucket are either compared or known to be in one component.

With 24 bands of 6 a pair at a similarity of 0.85 fails to share a bucket with a
probability of 1.2e-5, with 32 bands of 5 (the defaults) one at 0.8 with a
probability of 3e-6; closer pairs far less often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Names, Scratch, filled, hash_words, mix64, one_array, resting, ship, slices, words_of
from .components import connected

#: Members of a block in step 4.
BLOCK = 512
#: A pair whose signatures agree in a share this much below the threshold is not read in full (5 standard deviations at 144 minima).
MARGIN = 0.16


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct k-word shingles of each text, ascending; fewer words: all of them as one; none: empty."""
    bounds, codes, words = words_of(pc.ascii_lower(filled(text)))
    h = hash_words(words)[codes]
    n = np.diff(bounds)
    out: list[np.ndarray] = []
    count = np.zeros(len(n), np.int64)
    windows = None
    if len(h) >= k:
        windows = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            windows = mix64(windows * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    for d, (lo, m) in enumerate(zip(bounds[:-1].tolist(), n.tolist())):
        if m >= k:
            s = np.unique(windows[lo : lo + m - k + 1])
        elif m:
            x = np.full(1, m, np.uint64)
            for i in range(m):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[lo + i])
            s = x
        else:
            continue
        out.append(s)
        count[d] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(count)])


def minima(sets: np.ndarray, bounds: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n minima (upper halves of 64-bit multiply-add hashes) of each set that isn't empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), n), np.uint32)
    if len(full):
        at = bounds[:-1][full]
        for j in range(n):
            out[:, j] = np.minimum.reduceat(sets * a[j] + b[j], at) >> np.uint64(32)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for i in range(bands):
        x = np.full(len(sig), i + 1, np.uint64)
        for r in range(rows):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, i * rows + r])
        keys[:, i] = x
    return keys


def _lists(values: np.ndarray, full: np.ndarray) -> pa.Array:
    """Rows of values as lists, empty where full is false."""
    at = np.concatenate([[0], np.cumsum(full * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.reshape(-1).view(np.int64)))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), h1, h2 (the set's identity), bands of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for big in batches:
            for b in slices(big):
                sets, bounds = shingle_sets(one_array(b.column("text")), k)
                size = np.diff(bounds)
                full = size > 0
                keys = band_keys(minima(sets, bounds, bands * rows), bands, rows)
                h = np.zeros((2, len(size)), np.uint64)
                if full.any():
                    at = bounds[:-1][full]
                    h[0, full] = np.add.reduceat(mix64(sets), at)
                    h[1, full] = np.add.reduceat(mix64(sets ^ np.uint64(0xD6E8FEB86659FD93)), at)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), _lists(keys, full)], names=["doc_id", "n", "h1", "h2", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(resting(run), f"doc_id {kind}, n bigint, h1 bigint, h2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(node, sig, bands, shingles) of documents with words: minima, band keys and the full set."""

    def run(batches):
        for big in batches:
            for b in slices(big):
                sets, bounds = shingle_sets(one_array(b.column("text")), k)
                full = np.diff(bounds) > 0
                sig = minima(sets, bounds, bands * rows)
                at = pa.array(np.append(bounds[:-1][full], bounds[-1]).astype(np.int32))
                shingles = pa.ListArray.from_arrays(at, pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(full)), pa.array([x.tobytes() for x in sig], pa.binary()), _lists(band_keys(sig, bands, rows), np.ones(len(sig), bool)), shingles], names=["node", "sig", "bands", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(resting(run), f"node {kind}, sig binary, bands array<bigint>, shingles array<bigint>")


def _alike(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least that share."""
    sa = sigs.select(F.col("node").alias("na"), F.col("sig").alias("sa"))
    sb = sigs.select(F.col("node").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(sb, F.col("b") == F.col("nb")).join(sa, F.col("a") == F.col("na")).select("a", "b", "sa", "sb")

    def run(batches):
        for x in batches:
            if not x.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint32).reshape(x.num_rows, -1) for c in ("sa", "sb"))
            ok = pa.array((a == b).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([x.column("a").filter(ok), x.column("b").filter(ok)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(resting(run), f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("na"), F.col("shingles").alias("xa"))
    b = sets.select(F.col("node").alias("nb"), F.col("shingles").alias("xb"))
    both = pairs.join(b, F.col("b") == F.col("nb")).join(a, F.col("a") == F.col("na"))
    common = F.size(F.array_intersect("xa", "xb")).cast("bigint")
    both = both.select("a", "b", common.alias("i"), (F.size("xa") + F.size("xb")).cast("bigint").alias("s"))
    return both.filter(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b").distinct()


def _blocks(rest: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) that join components of one bucket; rest: band, node, comp, size, sig, bands, shingles.

    A pair is compared in the first of the buckets that it shares.
    """
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rest = rest.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    payload = ["band", "node", "comp", "sig", "bands", "shingles"]
    rest = rest.select(*payload, "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rest = rest.select(*payload, (F.col("mine") <= F.col("other")).alias("first"), F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    node = rest.schema["node"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        nodes, comp, first = (t.column(c).to_numpy() for c in ("node", "comp", "first"))
        n = len(nodes)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(n, -1)
        keys = np.array(one_array(t.column("bands")).flatten()).reshape(n, -1)
        lists = one_array(t.column("shingles"))
        flat, count = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        at = np.concatenate([[0], np.cumsum(count)])
        band = int(np.argwhere(keys == t.column("band")[0].as_py())[0, 1])  # rows of one doc_id may differ
        same = t.column("p")[0].as_py() == t.column("q")[0].as_py()
        comp = np.unique(comp, return_inverse=True)[1]
        out = []
        for i in range(n) if same else np.flatnonzero(first).tolist():
            j = np.arange(i + 1, n) if same else np.flatnonzero(~first)
            j = j[comp[j] != comp[i]]
            j = j[100 * np.minimum(count[j], count[i]) >= percent * np.maximum(count[j], count[i])]
            j = j[(sig[j] == sig[i]).mean(axis=1) >= least] if len(j) else j
            if len(j) and band:
                j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
            mine = flat[at[i] : at[i + 1]]
            for k in j.tolist():
                if comp[k] != comp[i]:
                    both = np.intersect1d(mine, flat[at[k] : at[k + 1]], assume_unique=True).size
                    if 100 * both >= percent * (count[i] + count[k] - both):
                        out.append((i, k))
                        comp[comp == comp[k]] = comp[i]
        kind = t.schema.field("node").type
        pairs = [sorted((nodes[i], nodes[k])) for i, k in out]
        return pa.table({"a": pa.array([x for x, _ in pairs], kind), "b": pa.array([y for _, y in pairs], kind)})

    return rest.groupBy("band", "p", "q").applyInArrow(run, f"a {node}, b {node}")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Documents with 100 * intersection >= percent * union of their shingle sets
    are linked; component_id is the smallest doc_id reachable, kept is
    doc_id = component_id.  No words or null text: an empty set, linked with
    nothing.  Rows of one doc_id are one document (linked if any of their texts
    is).  A null doc_id takes part through its text; a set that only null
    doc_ids have has a null component and is kept.  An empty table gives an empty
    one; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    least = max(percent / 100 - MARGIN, 0.0)
    m = scratch.write(signatures(docs, k, bands, rows), "signatures")
    full = m.filter("n > 0 and doc_id is not null")
    # one vertex for equal sets: its smallest doc_id; copies meet in a partial aggregate
    by_band = full.select("n", "h1", "h2", "doc_id", F.explode("bands").alias("band")).groupBy("band", "n", "h1", "h2").agg(F.min("doc_id").alias("node")).select("band", "node")
    buckets = by_band.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("least")).filter("size > 1").withColumnRenamed("band", "key")
    members = scratch.write(by_band.join(buckets, F.col("band") == F.col("key")).select("band", "node", "size", "least"), "members", dealt=True)
    # signatures and full sets of all members of such buckets; by shuffle at any size, the list of members grows with the corpus
    nodes = members.select("node").distinct()
    texts = docs.select("doc_id", "text").join(nodes.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left_semi")
    sets = scratch.write(_sets(texts, k, bands, rows), "sets")

    pairs = members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = _confirmed(_alike(pairs, sets, least).distinct(), sets, percent)
    comps = connected(links, scratch, "a", "b")

    placed = members.join(comps.withColumnRenamed("node", "w"), F.col("node") == F.col("w"), "left").select("band", "node", "size", F.coalesce("component", "node").alias("comp"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select(F.col("band").alias("key"))
    # pairs with a bucket's smallest member have been compared: a bucket of two has no other
    rest = placed.filter("size > 2").join(mixed, F.col("band") == F.col("key"), "left_semi")
    rest = rest.join(sets.withColumnRenamed("node", "w"), F.col("node") == F.col("w")).drop("w")
    more = scratch.write(_blocks(rest, least, percent), "more", dealt=True)
    if more.take(1):
        stars = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comps = connected(more.unionByName(stars), scratch, "a", "b")
    scratch.drop(members, sets)

    home = full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"))
    home = home.join(comps.withColumnRenamed("node", "w"), F.col("node") == F.col("w"), "left").select(F.col("n").alias("n_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), F.coalesce("component", "node").alias("component"))
    every = m.select("doc_id", "n", "h1", "h2").join(home, (F.col("n") == F.col("n_")) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, **more) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with docs' columns; of repeated rows of one doc_id, each stays."""
    found = near_duplicates(docs, k, percent, bands, rows, **more)
    kept = found.filter("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    names = Names(docs)
    return names.back(names.docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi"))
