"""Predictors that read what they have reconstructed: loop-carried, so no window.

In tiles, all tiles of a batch advance together: a loop over the places of a tile,
vectorised over tiles.  Over a whole field the recursion runs through every
element, and a field is one task; memory doesn't grow with it.  That task gets
segments that others have packed and hands on segments that others unpack.  In two
and three dimensions it goes from diagonal to diagonal (places whose coordinates have
the same sum don't predict each other), vectorised over the places of one.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.fields import tile_keys, with_tiles

#: Tiles of one, two and three dimensions.
TILES = {1: (256,), 2: (16, 16), 3: (8, 8, 8)}
#: Elements of a whole field that travel as one row: as many lines or planes as fit, one at least.
SEGMENT = 1 << 17
#: Rows of a batch of elements that have been unpacked.
UNPACKED = 10_000


def neighbours(ndim: int) -> list[tuple[int, tuple[int, ...]]]:
    """(sign, offsets back along each axis) of the points that predict one: inclusion and exclusion of a corner."""
    return [((-1) ** (sum(o) + 1), o) for o in itertools.product((0, 1), repeat=ndim) if any(o)]


def quantized(v, guess, eb, radius: int):
    """(codes, reconstruction): the error in steps of twice the bound, code 0 and the value itself if it has too many."""
    e = v - guess
    step = np.floor((np.floor(np.abs(e) / eb) + 1) / 2) * np.sign(e)
    near = guess + step * 2 * eb
    ok = (np.abs(step) < radius) & (np.abs(near - v) <= eb)
    return np.where(ok, step + radius, 0).astype(np.int64), np.where(ok, near, v)


def walk(shape: tuple[int, ...], n: int, visit) -> np.ndarray:
    """n tiles of a shape filled place by place: visit(place, guess) -> values; outside of a tile all is 0."""
    x = np.zeros((n, *(s + 1 for s in shape)))
    signs = neighbours(len(shape))
    for place in itertools.product(*map(range, shape)):
        guess = sum(sign * x[(slice(None), *(p + 1 - o for p, o in zip(place, back)))] for sign, back in signs)
        x[(slice(None), *(p + 1 for p in place))] = visit(place, guess)
    return x[(slice(None), *(slice(1, None),) * len(shape))]


def quantize_tiles(v: np.ndarray, eb: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, reconstruction) of tiles v (tiles x places along each axis, slowest first)."""
    codes = np.zeros(v.shape, np.int64)

    def visit(place, guess):
        at = (slice(None), *place)
        codes[at], near = quantized(v[at], guess, eb, radius)
        return near

    return codes, walk(v.shape[1:], len(v), visit)


def rebuild_tiles(codes: np.ndarray, kept: np.ndarray, eb: np.ndarray, radius: int) -> np.ndarray:
    def visit(place, guess):
        c = codes[(slice(None), *place)]
        return np.where(c == 0, kept[(slice(None), *place)], guess + (c - radius) * 2 * eb)

    return walk(codes.shape[1:], len(codes), visit)


def _in_tiles(df: DataFrame, tile: tuple[int, ...], value: str, work, kinds: list[tuple[str, str]], *more: str) -> DataFrame:
    """field_id, i and the columns that work(values of tiles, more columns of tiles) makes of each place.

    Places of a tile beyond the field count as 0; nothing inside is predicted from them.
    """
    ship(df.sparkSession)
    places = math.prod(tile)
    at = F.lit(0)
    for axis, size in reversed(list(zip("xyz", tile))):
        at = at * size + F.col(axis) % size
    cell = F.struct(at.cast("int").alias("at"), "i", F.col(value).cast("double").alias("v"))
    t = with_tiles(df, tile).groupBy(*tile_keys(tile), *more).agg(F.collect_list(cell).alias("a"))
    types = {"int": pa.int32(), "double": pa.float64()}

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                lists = part.column("a")
                n = np.array([len(x) for x in lists])
                flat = lists.flatten()
                place, i, v = (flat.field(c).to_numpy() for c in range(3))
                row = np.repeat(np.arange(len(n)), n)
                full = np.zeros((len(n), places))
                full[row, place] = v
                out = work(full.reshape(len(n), *reversed(tile)), *(part.column(c).to_numpy() for c in more))
                names = np.repeat(np.array(part.column("field_id").to_pylist(), object), n)
                columns = [pa.array(x.reshape(len(n), -1)[row, place], types[kind]) for x, (_, kind) in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(i), *columns], names=["field_id", "i", *(c for c, _ in kinds)])

    return t.mapInArrow(run, "field_id string, i bigint, " + ", ".join(f"{c} {k}" for c, k in kinds))


def blocked_round_trip(df: DataFrame, ndim: int = 1, tile: tuple[int, ...] | None = None, radius: int = 512) -> DataFrame:
    """field_id, i, code, v, xv of a field with eb: quantized and rebuilt tile by tile."""

    def work(v, eb):
        eb = np.maximum(eb, 1e-300)
        codes, _ = quantize_tiles(v, eb, radius)
        return codes, v, rebuild_tiles(codes, np.where(codes == 0, v, 0), eb, radius)

    return _in_tiles(df, tile or TILES[ndim], "v", work, [("code", "int"), ("v", "double"), ("xv", "double")], "eb")


def prequantized_round_trip(df: DataFrame, q: str = "q", tile: int = 256, radius: int = 512) -> DataFrame:
    """The convention that stores the prequantized value of an outlier, not its delta: field_id, i, q, back.

    Decoding restarts at each outlier, so it is a running sum in segments that
    outliers begin: still a window.
    """
    from pyspark.sql.window import Window

    t = with_tiles(df, (tile,))
    w = Window.partitionBy(*tile_keys((tile,))).orderBy("x")
    t = t.withColumn("d", F.col(q) - F.coalesce(F.lag(q).over(w), F.lit(0)))
    t = t.withColumn("out", F.abs(F.col("d")) >= radius)
    t = t.withColumn("segment", F.sum(F.col("out").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(*tile_keys((tile,)), "segment").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("back", F.sum(F.when(F.col("out"), F.col(q)).otherwise(F.col("d"))).over(s)).select("field_id", "i", q, "back")


def prequantized_tiles(df: DataFrame, ndim: int, q: str = "q", tile: tuple[int, ...] | None = None, radius: int = 512) -> DataFrame:
    """The same in two and three dimensions, where an outlier's value enters several sums: field_id, i, q, out (1: stored as
    is), back."""

    def work(v):
        out = np.zeros(v.shape, np.int64)
        kept = np.zeros(v.shape)

        def forward(place, guess):
            at = (slice(None), *place)
            out[at] = np.abs(v[at] - guess) >= radius
            kept[at] = np.where(out[at], v[at], v[at] - guess)
            return v[at]

        walk(v.shape[1:], len(v), forward)
        back = walk(v.shape[1:], len(v), lambda place, guess: kept[(slice(None), *place)] + np.where(out[(slice(None), *place)], 0, guess))
        return v, out, back

    return _in_tiles(df, tile or TILES[ndim], q, work, [(q, "double"), ("out", "int"), ("back", "double")])


@functools.lru_cache(maxsize=2)
def diagonals(shape: tuple[int, ...]) -> list[np.ndarray]:
    """Places of a block in the order of the sum of their coordinates, one array a sum: where the farthest neighbour of
    each is in the flat block with one more place before each axis."""
    axes = np.ogrid[tuple(slice(s) for s in shape)]
    strides = [math.prod(s + 1 for s in shape[k + 1 :]) for k in range(len(shape))]
    far = sum(axes).ravel()
    at = sum(a * s for a, s in zip(axes, strides)).ravel()[np.argsort(far, kind="stable")]
    return np.split(at, np.cumsum(np.bincount(far))[:-1])


def compensated(terms):
    """The sum of numbers or arrays with the rounding errors of its additions added at its end, as sum() has it for floats
    since Python 3.12: diagonals and single points round alike."""
    s, lost = next(terms, 0.0), 0.0
    for a in terms:
        t = s + a
        b = t - s
        lost = lost + ((s - (t - b)) + (a - b))
        s = t
    return s + lost


def quantized_one(v: float, guess: float, eb: float, radius: int) -> tuple[int, float]:
    """quantized() of one number."""
    e = v - guess
    far = abs(e) / eb
    if far < 2 * radius:  # NaN is not
        step = (int(far) + 1) // 2
        if e < 0:
            step = -step
        near = guess + step * 2 * eb
        if -radius < step < radius and abs(near - v) <= eb:
            return step + radius, near
    return 0, v


class _Whole:
    """One way (coder or decoder) over one field in the order of i.  It remembers what it made last, as far back as a
    neighbour can be."""

    def __init__(self, ndim: int, lx: int, ly: int):
        self.inner = ((), (lx,), (ly, lx))[ndim - 1]  # lengths of the axes but the slowest, slowest first
        self.plane = math.prod(self.inner)
        self.strides = [math.prod(self.inner[k:]) for k in range(ndim)]
        self.signs = neighbours(ndim)
        self.last = np.zeros(sum(self.strides) + 1)
        self.ring: list[float] = []

    def remember(self, x: np.ndarray) -> None:
        n = len(self.last)
        self.last = x[-n:].copy() if len(x) >= n else np.concatenate([self.last[len(x) :], x])

    def line(self, n: int, visit) -> np.ndarray:
        """The next n elements of a field of one dimension: visit(number, guess) -> value."""
        x, guess = [0.0] * n, float(self.last[-1])
        for k in range(n):
            x[k] = guess = visit(k, guess)
        x = np.array(x)
        self.remember(x)
        return x

    def lay(self, a: np.ndarray) -> np.ndarray:
        """Elements of whole lines or planes as a flat block with one more place before each axis."""
        shape = (-(-len(a) // self.plane), *self.inner)
        full = np.zeros(math.prod(shape), a.dtype)
        full[: len(a)] = a
        return np.pad(full.reshape(shape), [(1, 0)] * len(shape)).ravel()

    def lift(self, flat: np.ndarray, n: int) -> np.ndarray:
        """The n elements that lay() laid."""
        whole = flat.reshape(-1, *(s + 1 for s in self.inner))
        return whole[(slice(1, None),) * whole.ndim].ravel()[:n]

    def block(self, n: int, visit) -> np.ndarray:
        """The next n elements, which begin a line or plane: visit(places as lay() has them, guesses) -> values."""
        shape = (-(-n // self.plane), *self.inner)
        x = np.zeros([s + 1 for s in shape])
        x[(0, *(slice(1, None),) * len(self.inner))] = self.last[-self.plane :].reshape(self.inner)
        flat = x.ravel()
        strides = [math.prod(s + 1 for s in shape[k + 1 :]) for k in range(len(shape))]
        reach = sum(strides)
        back = [(sign, flat[reach - sum(o * s for o, s in zip(reversed(offsets), strides)) :]) for sign, offsets in self.signs]
        for at in diagonals(shape):
            guess = compensated(part[at] if sign > 0 else -part[at] for sign, part in back)
            here = at + reach
            flat[here] = visit(here, guess)
        out = self.lift(flat, n)
        self.remember(out)
        return out

    def points(self, i: list[int], at: int, visit) -> np.ndarray:
        """Elements of indices i with gaps or repeats, one after another, once all up to `at` had none: visit(number, guess) ->
        value.  For a missing neighbour counts what was in its place of a ring before."""
        n = len(self.last)
        if not self.ring:
            self.ring = [0.0] * n
            for k, value in enumerate(self.last.tolist()):
                self.ring[(at - n + k) % n] = value
        x = np.empty(len(i))
        for k, j in enumerate(i):
            place = [j // s for s in self.strides]
            place[1:] = [p % size for p, size in zip(place[1:], self.inner)]
            near = ((sign, [(o, s) for o, s in zip(reversed(offsets), self.strides)]) for sign, offsets in self.signs)
            terms = (sign * self.ring[(j - sum(o * s for o, s in far)) % n] for sign, far in near if all(p >= o for p, (o, _) in zip(place, far)))
            x[k] = self.ring[j % n] = visit(k, compensated(terms))
        return x


class _RoundTrip:
    """Coder and decoder of one field."""

    def __init__(self, ndim: int, lx: int, ly: int, eb: float, radius: int):
        self.there, self.back = _Whole(ndim, lx, ly), _Whole(ndim, lx, ly)
        self.ndim, self.eb, self.radius = ndim, max(float(eb), 1e-300), radius
        self.at: int | None = 0  # the next index; None after a gap or repeat

    def run(self, i: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, rebuilt) of the field's next segment."""
        at, eb, radius, n = self.at, self.eb, self.radius, len(v)
        dense = i[0] == at and bool((np.diff(i) == 1).all())
        self.at = at + n if dense else None
        if dense and self.ndim > 1:
            laid = self.there.lay(v)
            codes = np.zeros(len(laid), np.int64)

            def coded(here, guess):
                codes[here], near = quantized(laid[here], guess, eb, radius)
                return near

            def decoded(here, guess):
                c = codes[here]
                return np.where(c == 0, laid[here], guess + (c - radius) * 2 * eb)

            with np.errstate(all="ignore"):  # NaN and values without a near multiple of the bound are kept as they are
                self.there.block(n, coded)
                return self.there.lift(codes, n), self.back.block(n, decoded)
        values, found = v.tolist(), [0] * n

        def code(k, guess):
            found[k], near = quantized_one(values[k], guess, eb, radius)
            return near

        def decode(k, guess):
            return guess + (found[k] - radius) * 2 * eb if found[k] else values[k]

        made = [w.line(n, visit) if dense else w.points(i.tolist(), at, visit) for w, visit in ((self.there, code), (self.back, decode))]
        return np.array(found), made[1]


def _packed(batches):
    """Rows in the order of field_id, part, i -> one row a part: its first index and bound, its values as bytes, and its indices
    too if they have gaps or repeats."""

    def row():
        i, v, eb = (np.concatenate(c) for c in zip(*pieces))
        odd = None if (np.diff(i) == 1).all() else i.tobytes()
        columns = [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array(eb[:1]), pa.array(i[:1]), pa.array([odd], pa.binary()), pa.array([v.tobytes()])]
        return pa.RecordBatch.from_arrays(columns, names=["field_id", "part", "eb", "first", "i", "v"])

    now, pieces = None, []
    for b in batches:
        columns = [b.column(c) for c in ("part", "i", "v", "eb")]
        if any(c.null_count for c in columns):
            raise ValueError("indices, values and bounds of a field are not null")
        part, i, v, eb = (c.to_numpy() for c in columns)
        names = b.column("field_id")
        name = names.dictionary_encode().indices.fill_null(-1).to_numpy()
        cuts = (np.flatnonzero((np.diff(part) != 0) | (np.diff(name) != 0)) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, len(i)]):
            if start == end:
                continue
            here = (names[start].as_py(), int(part[start]))
            if pieces and here != now:
                yield row()
                pieces = []
            now = here
            pieces.append((i[start:end], v[start:end], eb[start:end]))
    if pieces:
        yield row()


def _numbers(b: pa.RecordBatch, k: int, name: str, kind) -> np.ndarray:
    return np.frombuffer(b.column(name)[k].as_buffer(), kind)


def _indices(b: pa.RecordBatch, k: int, n: int) -> np.ndarray:
    return _numbers(b, k, "i", np.int64) if b.column("i")[k].is_valid else b.column("first")[k].as_py() + np.arange(n)


def _unpacked(batches, kind):
    """One row a part -> one row an element; kind: how codes travel."""
    for b in batches:
        for k in range(b.num_rows):
            code, v, xv = (_numbers(b, k, c, t) for c, t in (("code", kind), ("v", np.float64), ("xv", np.float64)))
            i, code = _indices(b, k, len(v)), code.astype(np.int32)
            for s in range(0, len(i), UNPACKED):
                few = slice(s, s + UNPACKED)
                names = pa.repeat(b.column("field_id")[k], len(i[few]))
                yield pa.RecordBatch.from_arrays([names, *(pa.array(c[few]) for c in (i, code, v, xv))], names=["field_id", "i", "code", "v", "xv"])


def whole_round_trip(df: DataFrame, ndim: int = 1, lx: int = 0, ly: int = 0, radius: int = 512) -> DataFrame:
    """field_id, i, code, v, xv: quantized and rebuilt over whole fields (indices dense from 0), each in one task.

    lx and ly: lengths of x and y where ndim has them to count.  A field with gaps or repeats is gone through point by
    point from there on.
    """
    ship(df.sparkSession)
    if ndim > 1 and not lx or ndim > 2 and not ly:
        raise ValueError("lengths of the faster axes are needed")
    plane = (1, lx, lx * ly)[ndim - 1]
    size = max(1, SEGMENT // plane) * plane
    t = df.select("field_id", F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("v"), F.col("eb").cast("double").alias("eb"))
    t = t.withColumn("part", F.floor(F.col("i") / size).cast("bigint")).repartition("field_id", "part").sortWithinPartitions("field_id", "part", "i")
    t = t.mapInArrow(_packed, "field_id string, part bigint, eb double, first bigint, i binary, v binary")
    kind = np.min_scalar_type(2 * radius)

    def run(batches):
        now, trip = None, None
        for b in batches:
            for k in range(b.num_rows):
                name, eb = b.column("field_id")[k].as_py(), b.column("eb")[k].as_py()
                if trip is None or name != now:
                    now, trip = name, _RoundTrip(ndim, lx, ly, eb, radius)
                v = _numbers(b, k, "v", np.float64)
                codes, xv = trip.run(_indices(b, k, len(v)), v)
                made = [pa.array([x.tobytes()]) for x in (codes.astype(kind), xv)]
                kept = ["field_id", "part", "first", "i", "v"]
                yield pa.RecordBatch.from_arrays([*(b.slice(k, 1).column(c) for c in kept), *made], names=[*kept, "code", "xv"])

    t = t.repartition("field_id").sortWithinPartitions("field_id", "part").mapInArrow(run, "field_id string, part bigint, first bigint, i binary, v binary, code binary, xv binary")
    return t.repartition("field_id", "part").mapInArrow(lambda batches: _unpacked(batches, kind), "field_id string, i bigint, code int, v double, xv double")
