"""Byte-level BPE by speculation and verification.

A text is cut into pretoken words; every *distinct* word of a batch is encoded
once.  Greedy longest match over a trie proposes tokens for all words at once;
a proposal is right if and only if every adjacent pair of tokens is one that
the merges themselves could leave side by side, which is checked for all pairs
at once.  Words with an impossible pair, and only these, are merged exactly.

``Codec`` is plain numpy/Arrow; ``encode``/``decode`` below apply it to
DataFrames in a map over whole texts, without any shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import HELD, filled, mix64, one_array, resting, ship, slices

_NONE = np.int64(1) << np.int64(60)
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[_BLANKS] = _SPACE
    return out


class _Map:
    """A fixed map of whole numbers >= 0: one in four slots at most is full, so most questions take one look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        live, at = np.arange(len(keys)), self._home(keys)
        while len(live):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[live[free]]  # one of those that meet in a slot stays
            here = self.keys[at] == keys[live]
            self.values[at[here]] = values[live[here]]
            live, at = live[~here], (at[~here] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, ask: np.ndarray, missing: int) -> np.ndarray:
        """The values, in the shape of ask; missing where there is none, and for what is below 0."""
        shape, ask = ask.shape, ask.ravel()
        at = self._home(ask)
        held = self.keys[at]
        same = (held == ask) & (ask >= 0)
        out = np.where(same, self.values[at], missing)
        live = np.flatnonzero(~same & (held >= 0) & (ask >= 0))  # an empty slot ends the search
        at = at[live]
        while len(live):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            same = held == ask[live]
            out[live[same]] = self.values[at[same]]
            on = ~same & (held >= 0)
            live, at = live[on], at[on]
        return out.reshape(shape)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """a with room for n rows, twice as many as before at least."""
    if n <= len(a):
        return a
    out = np.zeros((max(n, 2 * len(a)), *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


class _Known:
    """Words with their tokens: a hash table in arrays.

    A key is the word itself (at most LONGEST bytes, padded with zeros) and its
    length, so words are compared whole.
    """

    LONGEST = 23

    def __init__(self):
        self.n, self.used = 0, 0
        self.keys = np.zeros((1 << 10, 3), np.uint64)
        self.first, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.tokens = np.zeros(1 << 12, np.int32)
        self.slots = np.full(1 << 11, -1, np.int32)

    @classmethod
    def keys_of(cls, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row a word; of words that are too long the row means nothing."""
        size = np.minimum(np.diff(offsets), cls.LONGEST)
        pad = np.concatenate([data, np.zeros(24, np.uint8)])
        eight = np.ndarray(len(pad) - 7, "<u8", pad, strides=(1,))  # the eight bytes from each byte on
        upto = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        out = np.empty((len(size), 3), np.uint64)
        for k in range(3):
            out[:, k] = eight[offsets[:-1] + 8 * np.minimum(k, size >> 3)] & upto[np.clip(size - 8 * k, 0, 8)]
        out[:, 2] |= size.astype(np.uint64) << np.uint64(56)
        return out

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = mix64(mix64(mix64(keys[:, 0]) ^ keys[:, 1]) ^ keys[:, 2])
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out, at, live, most = np.full(len(keys), -1, np.int64), self._home(keys), np.arange(len(keys)), len(self.slots) - 1
        while len(live):
            k = self.slots[at]
            held = k >= 0  # an empty slot ends the search
            live, at, k = live[held], at[held], k[held]
            same = (self.keys[k] == keys[live]).all(axis=1)
            out[live[same]] = k[same]
            live, at = live[~same], (at[~same] + 1) & most
        return out

    def _place(self, live: np.ndarray) -> None:
        at, most = self._home(self.keys[live]), len(self.slots) - 1
        while len(live):
            free = self.slots[at] < 0
            self.slots[at[free]] = live[free]  # one of those that meet in a slot stays
            out = self.slots[at] != live
            live, at = live[out], (at[out] + 1) & most

    def add(self, keys: np.ndarray, count: np.ndarray, tokens: np.ndarray) -> None:
        """Distinct words that are not held."""
        n, used = self.n + len(keys), self.used + len(tokens)
        self.keys, self.first, self.count, self.tokens = _grown(self.keys, n), _grown(self.first, n), _grown(self.count, n), _grown(self.tokens, used)
        self.keys[self.n : n], self.count[self.n : n], self.tokens[self.used : used] = keys, count, tokens
        self.first[self.n : n] = self.used + np.cumsum(count) - count
        new = np.arange(self.n, n)
        self.n, self.used = n, used
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (2 * n).bit_length(), -1, np.int32)
            new = np.arange(n)
        self._place(new)


class Codec:
    """Tables of one tokenizer file (the JSON of a byte-level BPE)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        kind = j["model"]["type"], (j["pre_tokenizer"] or {}).get("type"), j["normalizer"]
        if kind != ("BPE", "ByteLevel", None) or j["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level BPE: {kind}")
        vocab, alphabet = j["model"]["vocab"], byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        # Own numbers: a byte is 0..255, the product of merge k is 256 + k; lower means merged earlier.
        own = {raw(c): b for c, b in alphabet.items()}
        names = [bytes([b]) for b in range(256)]
        left, right = list(range(256)), list(range(256))
        for m in j["model"]["merges"]:
            a, b = (m.split(" ") if isinstance(m, str) else m)
            a, b = raw(a), raw(b)
            if a + b in own:
                raise ValueError("two merges with one product")
            left.append(own[a])
            right.append(own[b])
            own[a + b] = len(names)
            names.append(a + b)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.merged = np.arange(len(names)) >= 256
        to_text = {b: c for c, b in alphabet.items()}
        self.ids = np.array([vocab["".join(to_text[x] for x in n)] for n in names], np.int64)
        pairs = (self.left[256:] << 32) | self.right[256:]
        order = np.argsort(pairs)
        self.pair_keys, self.pair_to = pairs[order], order.astype(np.int64) + 256
        self.pairs = _Map(self.pair_keys, self.pair_to)
        self._trie(names)
        self.classes = _classes()
        self.known = _Known()
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        by_id: list[bytes] = [b""] * size
        for n, i in zip(names, self.ids):
            by_id[i] = n
        for s, i in self.special.items():
            by_id[i] = s.encode()
        self.size = size
        self.token_bytes = pa.array(by_id, pa.binary())
        self.token_digits = pa.array([f"{i},".encode() for i in range(size)], pa.binary())

    def _trie(self, names: list[bytes]) -> None:
        child: dict[int, int] = {}
        end = [-1]
        for t, n in enumerate(names):
            node = 0
            for b in n:
                key = node << 8 | b
                to = child.get(key)
                if to is None:
                    to = child[key] = len(end)
                    end.append(-1)
                node = to
            end[node] = t
        self.trie = _Map(np.array(list(child), np.int64), np.array(list(child.values()), np.int64))
        self.trie_end = np.array(end, np.int64)

    # ------------------------------------------------------------- words

    def word_starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte offsets at which words begin; bounds: offsets of the pieces that share no word."""
        if not len(data):
            return np.zeros(0, np.int64)
        head = (data & 0xC0) != 0x80
        lead = None if head.all() else np.flatnonzero(head)
        code = data if lead is None else data[head]  # first bytes: characters of ASCII by themselves
        n = len(code)
        cls = np.frombuffer(bytearray(code.tobytes().translate(self.classes[:256].tobytes())), np.uint8)
        if lead is not None:
            pad = np.concatenate([data, np.zeros(3, np.uint8)])
            for size, low, high, mask in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
                at = np.flatnonzero((code >= low) & (code < high))
                if len(at):
                    c = (code[at] & mask).astype(np.int32)
                    for k in range(1, size):
                        c = c << 6 | (pad[lead[at] + k] & 0x3F)
                    cls[at] = self.classes[np.where(c < 0x110000, c, 0xFFFD)]
        first = np.zeros(n + 1, bool)  # of pieces
        at = bounds[bounds < len(data)]
        first[at if lead is None else np.searchsorted(lead, at)] = True
        first[n] = True
        space, blank = cls == _SPACE, code == 0x20
        start = first.copy()
        start[1:n] |= cls[1:] != cls[:-1]
        # a plain blank belongs to what follows it
        start[1:n] &= ~(blank[:-1] & ~space[1:]) | first[1:n]
        # the last of several blanks is apart if something follows
        more = np.zeros(n, bool)
        if n > 2:
            more[1:-1] = space[1:-1] & space[:-2] & ~space[2:] & ~first[1 : n - 1] & ~first[2:n]
        start[:n] |= more
        for i in np.flatnonzero(code == 0x27).tolist():
            if not first[i] and i and (cls[i - 1] == _OTHER or blank[i - 1]):
                continue
            rest = code[i + 1 : i + 3].tobytes()
            k = 2 if rest[:1] in (b"s", b"t", b"m", b"d") else 3 if rest in (b"re", b"ve", b"ll") else 0
            if k and not first[i + 1 : i + k].any():
                start[i + 1] = False
                start[i + k] = True
        at = np.flatnonzero(start[:n])
        return at if lead is None else lead[at]

    # ------------------------------------------------------------- distinct words

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, bounds) of words data[offsets[k]:offsets[k + 1]], in own numbers."""
        n = len(offsets) - 1
        tokens, bounds = self._propose(data, offsets)
        inner = np.ones(len(tokens), bool)
        inner[bounds[1:] - 1] = False  # last tokens open no pair; every word has a token
        at = np.flatnonzero(inner)
        keys, back = np.unique((tokens[at] << 32) | tokens[at + 1], return_inverse=True)
        bad = at[~self.compatible(keys >> 32, keys & 0xFFFFFFFF)[back]]
        if not len(bad):
            return tokens, bounds
        wrong = np.unique(np.searchsorted(bounds, bad, side="right") - 1)
        mended, each = self._merge_exactly(data, offsets, wrong)
        count = np.diff(bounds)
        count[wrong] = each
        new = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(new[-1], np.int64)
        right = np.ones(n, bool)
        right[wrong] = False
        keep = np.repeat(right, np.diff(bounds))
        out[np.repeat(right, count)] = tokens[keep]
        out[np.repeat(~right, count)] = mended
        return out, new

    def _known_words(self, data, offsets):
        """encode_words() for what this worker has not met yet; memory is bounded by KNOWN words."""
        known, length = self.known, np.diff(offsets)
        keys, short = known.keys_of(data, offsets), length <= known.LONGEST
        at = np.where(short, known.find(keys), -1)
        new = np.flatnonzero(at < 0)
        first, count = known.first[at], known.count[at]
        if not len(new):
            out = np.concatenate([[0], np.cumsum(count)])
            return known.tokens[np.repeat(first - out[:-1], count) + np.arange(out[-1])].astype(np.int64), out
        size = length[new]
        no = np.concatenate([[0], np.cumsum(size)])
        tokens, tb = self.encode_words(data[np.repeat(offsets[new] - no[:-1], size) + np.arange(no[-1])], no)
        first[new], count[new] = tb[:-1], np.diff(tb)
        out = np.concatenate([[0], np.cumsum(count)])
        here = np.repeat(first - out[:-1], count) + np.arange(out[-1])
        fresh = np.repeat(at < 0, count)
        got = np.empty(out[-1], np.int64)
        got[fresh], got[~fresh] = tokens, known.tokens[here[~fresh]]
        keep = np.flatnonzero(short[new])[: max(0, self.KNOWN - known.n)]
        if len(keep):
            kept = np.zeros(len(new), bool)
            kept[keep] = True
            known.add(keys[new[keep]], count[new[keep]], tokens[np.repeat(kept, count[new])])
        return got, out

    #: Words whose tokens a worker remembers; beyond it words are encoded anew each time.
    KNOWN = 300_000

    def _propose(self, data, offsets):
        """Greedy longest match, one token a word and round."""
        n = len(offsets) - 1
        pos, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        who = np.flatnonzero(pos < end)
        rounds, count = [], np.zeros(n, np.int64)
        pos = pos.copy()
        while len(who):
            p = pos[who]
            node = np.zeros(len(who), np.int64)
            best, upto = np.full(len(who), -1, np.int64), p.copy()
            live = np.arange(len(who))
            while len(live):
                node = self.trie.get(node << 8 | data[p[live]], -1)
                ok = node >= 0
                live, node = live[ok], node[ok]
                p[live] += 1
                token = self.trie_end[node]
                hit = token >= 0
                best[live[hit]] = token[hit]
                upto[live[hit]] = p[live[hit]]
                ok = p[live] < end[who[live]]
                live, node = live[ok], node[ok]
            rounds.append((who, best))
            count[who] += 1
            pos[who] = upto
            who = who[upto < end[who]]
        bounds = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(bounds[-1], np.int64)
        for k, (w, t) in enumerate(rounds):
            out[bounds[w] + k] = t
        return out, bounds

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges can leave tokens a and b side by side.

        Merges across the border are undone from the latest on: at every moment
        of the merging the two pieces that touch the border must not have a
        merge that comes before the next one that is known to happen.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), _NONE)
        while len(live):
            x, y = a[live], b[live]
            bad = self.pairs.get((x << 32) | y, _NONE) < limit[live]
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            # the later merge of the two is undone; a byte has none
            px, py = np.where(self.merged[x], x, -1), np.where(self.merged[y], y, -1)
            left = px > py
            go = np.maximum(px, py) >= 0
            live, x, y, left = live[go], x[go], y[go], left[go]
            limit[live] = np.where(left, x, y + 1)
            a[live] = np.where(left, self.right[x], x)
            b[live] = np.where(left, y, self.left[y])
        return ok

    def _merge_exactly(self, data, offsets, which: np.ndarray, width: int = 40) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, how many a word) of the words ``which``."""
        size = (offsets[1:] - offsets[:-1])[which]
        found = []  # (words, a row of tokens each, -1 for none)
        for k in np.flatnonzero(size > width).tolist():
            w = which[k]
            found.append((np.array([k]), self._merge_long(data[offsets[w] : offsets[w + 1]])[None, :]))
        todo = np.flatnonzero(size <= width)
        todo = todo[np.argsort(size[todo], kind="stable")]
        for block in np.array_split(todo, max(1, len(todo) // 1500)):  # words of about one length, so rows are short and stay in the cache
            if not len(block):
                continue
            n, most = size[block], int(size[block].max())
            col = np.arange(most)
            at = offsets[:-1][which[block]][:, None] + col
            inside = col < n[:, None]
            t = np.where(inside, data[np.where(inside, at, 0)].astype(np.int64), -1)
            rows = np.arange(len(block))
            done = np.full((len(block), most), -1, np.int64)
            none = np.full((len(block), 1), _NONE)
            to = np.hstack([self.pairs.get(np.where(t[:, 1:] >= 0, (t[:, :-1] << 32) | t[:, 1:], -1), _NONE), none])
            while len(rows):
                each = np.arange(len(rows))
                j = to.argmin(axis=1)
                best = to[each, j]
                rest = best == _NONE
                done[rows[rest], : t.shape[1]] = t[rest]
                rows, t, to, j, best = rows[~rest], t[~rest], to[~rest], j[~rest], best[~rest]
                if not len(rows):
                    break
                each = np.arange(len(rows))
                t[each, j] = best
                col = np.arange(t.shape[1] - 1)
                moved = col + (col > j[:, None])  # what follows moves up
                t, to = np.take_along_axis(t, moved, axis=1), np.take_along_axis(to, moved, axis=1)
                for at in (j - 1, j):  # only the pairs beside the new token are new
                    k = np.flatnonzero((at >= 0) & (at + 1 < t.shape[1]))
                    x, y = t[k, at[k]], t[k, at[k] + 1]
                    to[k, at[k]] = self.pairs.get(np.where(y >= 0, (x << 32) | y, -1), _NONE)
                k = np.flatnonzero(j == t.shape[1] - 1)
                to[k, j[k]] = _NONE
            found.append((block, done))
        count = np.zeros(len(which), np.int64)
        for k, x in found:
            count[k] = (x >= 0).sum(axis=1)
        begin = np.cumsum(count) - count
        out = np.empty(count.sum(), np.int64)
        for k, x in found:
            n = count[k]
            out[np.repeat(begin[k] - np.cumsum(n) + n, n) + np.arange(n.sum())] = x[x >= 0]
        return out, count

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        """A heap of pairs over a linked list: n log n for one word of any length."""
        t = data.astype(np.int64).tolist()
        n = len(t)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alone = np.array(t, np.int64)
        first = self.pairs.get((alone[:-1] << 32) | alone[1:], _NONE)
        heap = [(int(r), i) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        keys, to, none = self.pair_keys, self.pair_to, int(_NONE)

        def rank(i):
            k = after[i]
            if k >= n:
                return none
            key = t[i] << 32 | t[k]
            p = int(np.searchsorted(keys, key))
            return int(to[p]) if p < len(keys) and keys[p] == key else none

        while heap:
            r, i = heapq.heappop(heap)
            if t[i] < 0 or rank(i) != r:
                continue
            k = after[i]
            t[i], t[k] = r, -1
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
            for x in (i, before[i]):
                if x >= 0 and (q := rank(x)) != none:
                    heapq.heappush(heap, (q, x))
        return np.array([x for x in t if x >= 0], np.int64)

    # ------------------------------------------------------------- texts

    def _pieces(self, text: pa.Array):
        """(data, bounds of pieces, piece -> document, special id after each piece or -1)."""
        text = filled(text).cast(pa.large_binary())
        hit = None
        for s in self.special:
            h = pc.match_substring(text, s)
            hit = h if hit is None else pc.or_(hit, h)
        if hit is None or not pc.any(hit).as_py():
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(text) and text.buffers()[2] else np.zeros(0, np.uint8)
            return data, offsets - offsets[0], np.arange(len(text)), np.full(len(text), -1)
        import re

        cut = re.compile(b"(" + b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True)) + b")")
        parts, doc, special = [], [], []
        for k, x in enumerate(text.to_pylist()):
            found = cut.split(x)
            for i in range(0, len(found), 2):
                parts.append(found[i])
                doc.append(k)
                special.append(self.special[found[i + 1].decode()] if i + 1 < len(found) else -1)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return np.frombuffer(b"".join(parts), np.uint8), bounds, np.array(doc), np.array(special)

    def encode_batch(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): document k has ids[bounds[k]:bounds[k + 1]]."""
        data, bounds, doc, special = self._pieces(text)
        starts = self.word_starts(data, bounds)
        offsets = np.concatenate([starts, [len(data)]]).astype(np.int64)
        if len(starts):
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            uniq = words.dictionary
            uo = np.frombuffer(uniq.buffers()[1], np.int64)[uniq.offset : uniq.offset + len(uniq) + 1]
            tokens, tb = self._known_words(np.frombuffer(uniq.buffers()[2], np.uint8), uo)
            codes = words.indices.to_numpy(zero_copy_only=False)
            count = np.diff(tb)[codes]
            total = np.concatenate([[0], np.cumsum(count)])
            ids = self.ids[tokens][np.repeat(tb[codes] - total[:-1], count) + np.arange(total[-1])]
            piece_at = total[np.searchsorted(starts, bounds)]
        else:
            ids, piece_at = np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        if (special >= 0).any():
            k = np.flatnonzero(special >= 0)
            ids = np.insert(ids, piece_at[k + 1], special[k])
            piece_at = piece_at + np.concatenate([[0], np.cumsum(special >= 0)])
        first = np.searchsorted(doc, np.arange(len(text) + 1))  # every document has a piece
        return ids, piece_at[first]

    def decode_batch(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where the bytes of each id end): a table lookup."""
        got = one_array(self.token_bytes.take(pa.array(ids.astype(np.int32))))
        return _flat(got)

    def digits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _flat(one_array(self.token_digits.take(pa.array(ids.astype(np.int32)))))


def _flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def valid_text(raw: bytes) -> bytes:
    """Bytes that are no UTF-8 (possible for arbitrary ids) become U+FFFD, as the library does."""
    return raw.decode("utf-8", "replace").encode()


_CODECS: dict[str, Codec] = HELD.setdefault("bpe", {})
#: Bytes of text that are encoded at a time: longer stretches repeat more words.
SLICE = 2 << 20


def codec_of(spec) -> Codec:
    """The codec of a broadcast file, built once a worker."""
    key, text = spec.value
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(text)
    return _CODECS[key]


def broadcast_spec(spark: SparkSession, path: str):
    """The tokenizer file (a few MB, whatever the corpus) and its digest for all executors."""
    ship(spark)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast((hashlib.md5(text.encode()).hexdigest(), text))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", id_col: str | None = "doc_id") -> DataFrame:
    """Adds ``ids`` (array<int>) to (id_col, ) of every row; null text: empty.  Map only."""
    spec = broadcast_spec(docs.sparkSession, path)
    keep = [id_col] if id_col else []

    def run(batches):
        codec = codec_of(spec)
        for big in batches:
            for b in slices(big, text, SLICE):
                got, bounds = codec.encode_batch(one_array(b.column(text)))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(got.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], names=[*keep, ids])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, text).mapInArrow(resting(run, "bpe"), ", ".join([*fields, f"`{ids}` array<int>"]))


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text", id_col: str | None = "doc_id") -> DataFrame:
    """The texts of id lists.  Map only; a null list: null text."""
    spec = broadcast_spec(tokens.sparkSession, path)
    keep = [id_col] if id_col else []

    def run(batches):
        codec = codec_of(spec)
        for b in batches:
            out = []
            for x in b.column(ids).to_pylist():
                out.append(None if x is None else bytes(codec.decode_batch(np.array(x, np.int64))[0]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, text])

    fields = [f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep]
    return tokens.select(*keep, ids).mapInArrow(resting(run, "bpe"), ", ".join([*fields, f"`{text}` string"]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (op7's digest).

    Null text: as empty (no tokens, digests of nothing).  Repeated rows stay
    repeated, an empty table gives an empty one, further columns are ignored.
    """
    spec = broadcast_spec(docs.sparkSession, path)

    def run(batches):
        codec = codec_of(spec)
        for big in batches:
            for b in slices(big, most=SLICE):
                ids, bounds = codec.encode_batch(one_array(b.column("text")))
                digits, d_at = codec.digits(ids)
                plain, p_at = codec.decode_batch(ids)
                ids_sha, text_sha = [], []
                view, raw = memoryview(digits), memoryview(plain)
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    ids_sha.append(hashlib.sha256(view[d_at[lo] : max(d_at[lo], d_at[hi] - 1)]).hexdigest())
                    text_sha.append(hashlib.sha256(valid_text(bytes(raw[p_at[lo] : p_at[hi]]))).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(resting(run, "bpe"), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
