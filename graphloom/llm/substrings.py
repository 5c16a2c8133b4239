"""Exact substring dedup: repeated strings of a fixed length, found by suffix arrays of shards.

1. Every window (string of `length` bytes) has an anchor: the gram of least hash in it, the leftmost of
   equal ones. Equal windows have equal anchors at equal offsets, so windows whose anchor's gram stands
   nowhere else can't be repeated. Windows in a row with one anchor are a run; its bytes are its context.
2. Keys of runs are dealt out by their gram, only to tell which grams stand in several places. The bytes of
   all contexts of those grams are read from the texts and dealt out to shards by the gram.
3. A shard builds a suffix array of its contexts by Larsson-Sadakane refinement and common prefixes by
   Kasai's bound; neighbours that share `length` bytes are equal windows, of which all but the first are
   repeated.
4. A gram of many places is dealt to several shards by the place. The first windows of these shards go on
   by a hash of their bytes and are merged by binary search in sorted bytes.

Hashes only decide what meets where; what is equal is decided by bytes. (Contexts of one batch that have
equal hashes are compared byte by byte, and the later ones go no further.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces

LENGTH, GRAM = 100, 32
#: Bytes of text that one shard's suffix array takes.
SHARD_BYTES = 1 << 19
#: Bytes of contexts that are held at once: a bucket's, on average.
BUCKET_BYTES = 16 << 20
#: Longer texts are searched in slices of so many bytes.
SLICE_BYTES = 1 << 20
#: Places of one gram that lie in one shard.
SHARD_PLACES = 4_000
_PLACE = np.uint64((1 << 28) - 1)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_BYTE_KEYS = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Runs:
    """Runs of windows in texts that lie one behind the other: arrays of the runs' text, first and last
    window (in the text), key of the gram, place of the gram behind the first window."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.raw = raw = np.frombuffer(b"".join(texts), np.uint8)
        n, self.length = len(raw), length
        assert n <= int(_PLACE)  # long texts come in slices
        if n < length or not (sizes >= length).any():
            self.text = self.first = self.last = self.gram = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            self.prefix = self.inverse = np.ones(1, np.uint64)
            return
        size = 1 << max(20, (n + 1).bit_length())
        powers, self.inverse = _powers(size)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_KEYS[raw] * powers[:n], out=self.prefix[1:])
        grams = _mix((self.prefix[gram:] - self.prefix[:-gram]) * self.inverse[: n - gram + 1])
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, reach = length - gram + 1, 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        have = np.flatnonzero(sizes >= length)
        counts = sizes[have] - length + 1
        text = np.repeat(have, counts)
        window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place = (least[self.starts[text] + window] & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        self.text, self.first, self.last = text[cut], window[cut], window[np.append(cut[1:], len(window)) - 1]
        self.key = grams[place[cut]]
        self.gram = place[cut] - self.starts[self.text] - self.first

    def contexts(self, rows: np.ndarray) -> np.ndarray:
        """Keys of the runs' contexts with their places: equal for equal bytes, gram places and lengths."""
        s = self.starts[self.text[rows]] + self.first[rows]
        e = self.starts[self.text[rows]] + self.last[rows] + self.length
        bytes_key = _mix((self.prefix[e] - self.prefix[s]) * self.inverse[s])
        return _mix(bytes_key + (e - s).astype(np.uint64) * np.uint64(0x94D049BB133111EB) + self.gram[rows].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the runs a and b have the same context, byte by byte."""
        word = _words(self.raw)
        at = lambda rows: self.starts[self.text[rows]] + self.first[rows]
        x, y = at(a), at(b)
        n = self.last[a] - self.first[a] + self.length
        same = (n == self.last[b] - self.first[b] + self.length) & (self.gram[a] == self.gram[b])
        for k in range(0, int(n.max()) if len(n) else 0, 8):
            step = np.minimum(k, n - 8)  # the last 8 bytes again where fewer are left
            same &= word[x + step] == word[y + np.minimum(step, self.last[b] - self.first[b] + self.length - 8)]
        return same


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one number, highest first; zeros beyond the end."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= padded[k : n + k] << np.uint64(56 - 8 * k)
    return word


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of text sorted by their next `depth` bytes or more; whether each is equal to the one
    before in all these; and 8-byte words at all positions.

    Larsson-Sadakane: positions sorted by h bytes are in groups; those in groups of several are sorted
    by their group and the group of the position h on, which sorts them by 2h bytes.
    """
    n = len(text)
    word = _words(text)
    order = np.argsort(word)
    new = np.append(True, word[order][1:] != word[order][:-1])
    group = np.empty(n + 1, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    group[order], group[n] = head, -1
    h = 8
    several = ~(new & np.append(new[1:], True))
    while h < depth and several.any():
        at = np.flatnonzero(several)
        rows = order[at]
        key = (head[at].astype(np.uint64) << np.uint64(32)) | (group[np.minimum(rows + h, n)] + 1).astype(np.uint64)
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        order[at] = rows
        fresh = np.append(True, key[1:] != key[:-1])
        head[at] = np.maximum.accumulate(np.where(fresh, at, 0))
        group[rows] = head[at]
        new[at] |= fresh
        several[at] = ~(fresh & np.append(fresh[1:], True))
        h *= 2
    return order, ~new, word


def common_prefixes(order: np.ndarray, tied: np.ndarray, word: np.ndarray, cap: int) -> np.ndarray:
    """Of each sorted position: the bytes it shares with the one before, `cap` at most.

    Kasai's bound: a position shares with its neighbour at least as much as the position s before it
    does with its own, less s. All positions at one stride are extended together, from wide strides to 1.
    Tied positions share the cap; as their order is open, they bound none.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared, open_order = np.zeros(n, np.int64), np.zeros(n, bool)
    open_order[order] = tied
    shared[open_order] = cap
    stride = 64
    todo = np.arange(0, n, stride)
    while True:
        if len(todo):
            own = shared[todo]
            live = np.flatnonzero((before[todo] >= 0) & (own < cap))
            while len(live):
                a, b = todo[live] + own[live], before[todo[live]] + own[live]
                inside = np.maximum(a, b) < n
                live, a, b = live[inside], a[inside], b[inside]
                differ = word[a] ^ word[b]
                left = n - np.maximum(a, b)  # bytes before the text's end, where words are padded
                same = np.where(differ == 0, 8, (63 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64)) // 8)
                # A word of more than 53 bits may round up to the next power: check the byte at the edge.
                edge = np.minimum(same, 7).astype(np.uint64)
                top = (differ >> (np.uint64(56) - np.uint64(8) * edge)) & np.uint64(0xFF)
                same = np.where((differ != 0) & (top == 0), same + 1, same)
                same = np.minimum(same, left)
                own[live] += same
                live = live[(same == 8) & (own[live] < cap)]
            shared[todo] = np.minimum(own, cap)
        if stride == 1:
            return shared[order]
        stride //= 2
        todo = np.arange(stride, n, 2 * stride)
        todo = todo[~open_order[todo]]
        ahead = todo - stride
        shared[todo] = np.where(open_order[ahead], 0, np.maximum(shared[ahead] - stride, 0))


class Contexts:
    """Different contexts of a shard: bytes, and for each the rank of its document and its first window."""

    def __init__(self, raws: list[bytes], doc: np.ndarray, first: np.ndarray, length: int):
        self.raws, self.doc, self.first, self.length = raws, doc, first, length

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, window, group, order): windows by sorted bytes; group is equal for equal windows."""
        sizes = np.array([len(r) for r in self.raws], np.int64)
        starts = np.cumsum(sizes) - sizes
        order, tied, word = suffix_array(np.frombuffer(b"".join(self.raws), np.uint8), self.length)
        shared = common_prefixes(order, tied, word, self.length)
        group = np.cumsum(shared < self.length)
        context = np.searchsorted(starts, order, side="right") - 1
        window = order - starts[context]
        ok = window <= sizes[context] - self.length
        return context[ok], window[ok], group[ok], order[ok]

    def repeated(self) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """(context, window) of windows with an equal one that starts earlier; and the firsts, by sorted bytes."""
        context, window, group, _ = self.windows()
        doc, at = self.doc[context], self.first[context] + window
        by = np.lexsort((at, doc, group))
        first = np.append(True, group[by][1:] != group[by][:-1]) if len(by) else np.zeros(0, bool)
        # The same place in two contexts is one window.
        firsts = by[first]
        lead = firsts[np.cumsum(first) - 1] if len(by) else firsts
        later = (doc[by] != doc[lead]) | (at[by] != at[lead])
        return context[by[later]], window[by[later]], (context[firsts], window[firsts])


class FirstPlaces:
    """The windows met so far by their sorted bytes, each with its first place; rows come in any order."""

    def __init__(self) -> None:
        self.keys: np.ndarray | None = None
        self.places = np.zeros((0, 3), np.int64)  # document, hash of the text, window

    def merge(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Places that turn out to be repeated when these windows (sorted, each once) are looked up by binary search."""
        if self.keys is None:
            self.keys, self.places = keys, places
            return places[:0]
        spot = np.searchsorted(self.keys, keys)
        near = np.minimum(spot, len(self.keys) - 1)
        hit = self.keys[near] == keys
        at, own = near[hit], places[hit]
        old = self.places[at]
        same = (old[:, 0] == own[:, 0]) & (old[:, 2] == own[:, 2])
        turned = (own[:, 0] < old[:, 0]) | ((own[:, 0] == old[:, 0]) & (own[:, 2] < old[:, 2]))
        self.places[at[turned]] = own[turned]
        fresh = ~hit
        self.keys = np.insert(self.keys, spot[fresh], keys[fresh])
        self.places = np.insert(self.places, spot[fresh], places[fresh], axis=0)
        return np.concatenate([own[~same & ~turned], old[turned]])


def _spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Maximal spans of the windows first to last (each a range of windows)."""
    by = np.lexsort((last, first))
    s, e = first[by], np.maximum.accumulate(last[by] + length)
    cut = np.append(True, s[1:] > e[:-1])
    return s[cut].tolist(), e[np.append(np.flatnonzero(cut)[1:] - 1, len(s) - 1)].tolist()


#: A place in one number: bits of the text's hash, the first window, and how many windows follow it in its run.
_TEXT_BITS, _FIRST_BITS, _MORE_BITS = 24, 31, 8


def _place(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (text << (_FIRST_BITS + _MORE_BITS)) | (first << _MORE_BITS) | (last - first)


def _first(place: np.ndarray) -> np.ndarray:
    return (place >> _MORE_BITS) & ((1 << _FIRST_BITS) - 1)


def _differ(*cols: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any column; the first does."""
    if not len(cols[0]):
        return np.zeros(0, bool)
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))


def _sliced(part: pa.RecordBatch, length: int, most: int) -> Iterator[tuple[list[int], np.ndarray, list[bytes]]]:
    """(rows, starts, bytes) of the texts in lists of bounded size: long texts in slices that share no window."""
    texts = part.column("text").to_pylist()
    short = [i for i, t in enumerate(texts) if len(t) <= most]
    if short:
        yield short, np.zeros(len(short), np.int64), [texts[i] for i in short]
    for i, t in enumerate(texts):
        for s in range(0, len(t) - length + 1, most) if len(t) > most else ():
            yield [i], np.array([s]), [t[s : s + most + length - 1]]


def _part(doc: np.ndarray, place: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """One of so many parts for each place, by a hash."""
    return _mix(_mix(doc.view(np.uint64) + np.uint64(_BASE)) + place.view(np.uint64)) % parts.astype(np.uint64)


def _salted(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    return _mix(key.view(np.uint64) + _mix(part + np.uint64(1))).view(np.int64)


def _runs_of(length: int, gram: int, hot=None, slice_bytes: int = SLICE_BYTES):
    """Batches of texts to their runs (key, doc, place, state); a context's later places in a batch are done.

    A hot gram's key is split by the place into as many as its entry in `hot` (keys, parts) says.
    """

    def run(batch: pa.RecordBatch):
        known, parts = hot.value if hot else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for part in pieces(batch, "text", 1 << 19):
            for rows, starts, raws in _sliced(part, length, slice_bytes):
                runs = Runs(raws, length, gram)
                if not len(runs.key):
                    continue
                doc, text = (part.column(c).to_numpy()[np.array(rows)][runs.text] for c in ("doc", "hash"))
                first = runs.first + starts[runs.text]
                place = _place(text, first, runs.last + starts[runs.text])
                key, context = runs.key.view(np.int64), runs.contexts(np.arange(len(runs.key)))
                state = np.zeros(len(key), np.int32)
                if len(known):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    some = np.flatnonzero(known[at] == key)
                    key = key.copy()
                    key[some] = _salted(key[some], _part(doc[some], place[some], parts[at[some]]))
                    state[some] = _HOT
                order = np.lexsort((place, first, doc, context))
                lead = order[np.maximum.accumulate(np.where(_differ(context[order]), np.arange(len(order)), 0))]
                later = (doc[order] != doc[lead]) | (first[order] != first[lead])
                order, lead = order[later], lead[later]
                state[order[runs.same_bytes(lead, order)]] = _DONE
                key = np.where(state == _DONE, doc, key)  # spread out; only runs that aren't done are compared
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, doc, place, state)], names=["key", "doc", "place", "state"])

    return run


def _hot_grams(rows: DataFrame, length: int, gram: int, one_in: int = 32, least: int = 8, per_shard: int = SHARD_PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Keys of grams in more than a 512th of a sample of documents (and `least` of them) that need several
    shards, and how many. There can't be more of them than runs in 512 documents."""
    sample = rows.where(F.pmod(F.xxhash64("doc", "hash"), F.lit(one_in)) == 0)

    def keys(batch: pa.RecordBatch):
        for part in pieces(batch, "text", 1 << 19):
            for _, _, raws in _sliced(part, length, SLICE_BYTES):
                runs = Runs(raws, length, gram)
                pairs = np.unique(np.stack([runs.key.view(np.int64), runs.text], 1), axis=0)
                key, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    n_docs = sample.count()
    found = in_arrow(sample, "key long, n long", keys).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, n_docs // 512)).collect()
    found = sorted((r["key"], -(-r["n"] * one_in // per_shard)) for r in found)
    found = [(k, n) for k, n in found if n > 1]
    return np.array([k for k, _ in found], np.int64), np.array([n for _, n in found], np.uint64)


def _look(per_shard: int):
    """All runs of the partition's grams: those of grams in several places, to be compared; and what is done already.

    A gram of more than per_shard places is split by the place, so that what a shard holds is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        cols = {c: table.column(c).to_numpy() for c in table.column_names}
        known = np.flatnonzero(cols["state"] == _DONE)
        rows = np.flatnonzero(cols["state"] != _DONE)
        rows = rows[np.lexsort((cols["place"][rows], cols["doc"][rows], cols["key"][rows]))]
        rows = rows[_differ(*(cols[c][rows] for c in ("key", "doc", "place")))]  # rows of equal id and text are one document
        key, state = cols["key"][rows], cols["state"][rows]
        group = np.cumsum(_differ(key)) - 1
        n = np.bincount(group)[group] if len(group) else group
        several = (n > 1) | (state == _HOT)
        rows, key, state, n = rows[several], key[several], state[several], n[several]
        many = (n > per_shard) & (state != _HOT)
        key = np.where(many, _salted(key, _part(cols["doc"][rows], cols["place"][rows], np.maximum(1, -(-n // per_shard)))), key)
        pick = np.concatenate([known, rows])
        state = np.concatenate([np.full(len(known), _DONE, np.int32), np.where(many, np.int32(_HOT), state)])
        bits = _FIRST_BITS + _MORE_BITS
        out = [cols["doc"][pick], cols["place"][pick] >> bits, cols["place"][pick] & ((1 << bits) - 1), np.concatenate([np.zeros(len(known), np.int64), key]), state]
        yield from pa.Table.from_arrays([pa.array(c) for c in out], names=["doc", "hash", "place", "key", "state"]).to_batches(max_chunksize=50_000)

    return run


#: States of a run: to be compared, repeated whole, to be compared across shards too.
_DONE, _HOT = 1, 2
_SPANS = "array<struct<start: long, end: long>>"
_SPANS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Contexts and finished spans, many in a blob, by the bucket of their gram.
_DEALT = "bucket long, blob binary"
#: Windows that are repeated (by their document, no bytes), or first in their shard and hot (by a hash of their bytes).
_SEEN = "route long, doc long, hash long, first long, last long, raw binary"


def _seen(doc, text, first, last, route=None, raw=None) -> pa.RecordBatch:
    cols = [pa.array(c) for c in (doc if route is None else route, doc, text, first, last)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(raw, pa.binary()) if raw is not None else pa.nulls(len(doc), pa.binary())], names=["route", "doc", "hash", "first", "last", "raw"])


_INTS = ("route", "doc", "hash", "first", "last", "hot", "size")


def _blob(cols: list[np.ndarray], raws: list[bytes]) -> bytes:
    """Rows of integers, the last of them the sizes of the rows' bytes, and these bytes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.stack(cols).astype("<i8").tobytes() + b"".join(raws) + len(cols[0]).to_bytes(8, "little"))


def _unblob(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[-8:], "little")
    cols = np.frombuffer(data, "<i8", len(_INTS) * n).reshape(len(_INTS), n)
    ends = (np.cumsum(cols[-1]) + cols.nbytes).tolist()
    return cols, [data[s:e] for s, e in zip([cols.nbytes, *ends], ends)]


def _fetch(length: int, buckets: int):
    """Texts with their runs to blobs of contexts, and of spans that are done (without bytes)."""

    def run(batch: pa.RecordBatch):
        unpack = zstandard.ZstdDecompressor().decompress
        for part in pieces(batch, "packed", 1 << 20):
            counts = pc.list_value_length(part.column("runs")).to_numpy()
            place, key, state = (c.to_numpy() for c in part.column("runs").flatten().flatten())
            first = _first(place)
            last = first + (place & ((1 << _MORE_BITS) - 1))
            doc, text, packed = part.column("doc").to_numpy(), part.column("hash").to_numpy(), part.column("packed")
            ends = np.cumsum(counts)
            cols: list[np.ndarray] = []
            raws: list[bytes] = []
            for i, (s, e) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                done = state[s:e] == _DONE
                starts, stops = (np.array(x) for x in _spans(first[s:e][done], last[s:e][done], length)) if done.any() else (first[:0], first[:0])
                live = np.flatnonzero(~done) + s
                n, m = len(starts), len(live)
                cols.append(np.stack([
                    np.append(np.full(n, doc[i]), key[live]), np.full(n + m, doc[i]), np.full(n + m, text[i]), np.append(starts, first[live]),
                    np.append(stops - length, last[live]), np.append(np.zeros(n, np.int64), state[live] == _HOT), np.append(np.zeros(n, np.int64), last[live] - first[live] + length),
                ]))
                raws += [b""] * n
                if m:
                    raw = unpack(packed[i].as_py())
                    raws += [raw[x:y] for x, y in zip(first[live].tolist(), (last[live] + length).tolist(), strict=True)]
            rows = np.concatenate(cols, 1)
            bucket = (_mix(rows[0].view(np.uint64) + np.uint64(_BASE)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(_differ(bucket[order]))
            blobs = [_blob(list(rows[:, at]), [raws[i] for i in at.tolist()]) for at in np.split(order, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _shards(length: int, shard_bytes: int):
    """Blobs of a partition, sorted by bucket, to windows that are repeated, and first ones that are hot."""

    def search(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        read = [_unblob(b) for b in blobs]
        cols = dict(zip(_INTS, np.concatenate([c for c, _ in read], 1), strict=True))
        raws = [r for _, rs in read for r in rs]
        done = np.flatnonzero(cols["size"] == 0)
        yield _seen(*(cols[c][done] for c in ("doc", "hash", "first", "last")))
        rows = np.flatnonzero(cols["size"])
        rows = rows[np.argsort(cols["route"][rows], kind="stable")]
        # A shard ends between two grams.
        size, start = np.cumsum(cols["size"][rows]), 0
        ends = np.append(np.flatnonzero(_differ(cols["route"][rows]))[1:], len(rows))
        for end in ends.tolist() if len(rows) else ():
            if end == len(rows) or size[end - 1] - (size[start - 1] if start else 0) >= shard_bytes:
                at = rows[start:end]
                yield from _search([raws[i] for i in at.tolist()], *(cols[c][at] for c in ("doc", "hash", "first", "last", "hot")), length)
                start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if held and bucket != last:
                    yield from search(held)
                    held = []
                held.append(blob)
                last = bucket
        if held:
            yield from search(held)

    return run


def _search(raws: list[bytes], doc: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, hot: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows among the contexts of several grams; first windows of hot ones, with their bytes.

    Contexts are sorted by their bytes; equal ones are one string of the suffix array, which stands at the
    first of their places, so that the windows of the others are repeated.
    """
    keys = np.array([r + b"\1" for r in raws])  # zero bytes at an end don't count in comparisons
    order = np.lexsort((first, doc, keys))
    fresh = _differ(keys[order])
    lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    others = order[(doc[order] != doc[lead]) | (first[order] != first[lead])]
    yield _seen(*(c[others] for c in (doc, text, first, last)))
    own = order[fresh]
    own.sort()
    doc, text, first, hot = (c[own] for c in (doc, text, first, hot))
    shard = Contexts([raws[i] for i in own.tolist()], doc, first, length)
    context, window, (lead, lead_window) = shard.repeated()
    some = np.flatnonzero(hot[lead])
    for k in range(0, len(some), 10_000):
        rows, windows = lead[some[k : k + 10_000]], lead_window[some[k : k + 10_000]]
        raw = [shard.raws[r][w : w + length] for r, w in zip(rows.tolist(), windows.tolist(), strict=True)]
        route = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)
        at = first[rows] + windows
        yield _seen(doc[rows], text[rows], at, at, route, raw)
    if len(context):
        at = first[context] + window
        by = np.lexsort((at, context))
        context, at = context[by], at[by]
        head = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (at[1:] > at[:-1] + 1)))
        rows = context[head]
        yield _seen(doc[rows], text[rows], at[head], at[np.append(head[1:], len(at)) - 1])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hot first windows of many shards, merged by binary search in sorted bytes: all but the first place of
    equal ones are repeated. Other rows go on as they are. Only different windows are held."""
    names, known = ["doc", "hash", "first", "last"], FirstPlaces()
    for batch in batches:
        hot = batch.column("raw").is_valid()
        yield batch.filter(pc.invert(hot)).select(names)
        some = batch.filter(hot)
        if not some.num_rows:
            continue
        keys = np.array([r + b"\1" for r in some.column("raw").to_pylist()])
        places = np.stack([some.column(c).to_numpy() for c in ("doc", "hash", "first")], 1)
        order = np.lexsort((places[:, 2], places[:, 0], keys))
        keys, places = keys[order], places[order]
        fresh = np.append(True, keys[1:] != keys[:-1])
        lead = places[np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))]
        again = (places[:, 0] != lead[:, 0]) | (places[:, 2] != lead[:, 2])
        again = np.concatenate([places[again], known.merge(keys[fresh], places[fresh])])
        yield pa.RecordBatch.from_arrays([pa.array(again[:, k]) for k in (0, 1, 2, 2)], names=names)


def repeated_spans(rows: DataFrame, packed: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_least: int = 8, per_shard: int = SHARD_PLACES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc, hash, spans) of the rows (doc, hash, text binary) with repeated windows; spans [start, end) in bytes.

    doc orders the documents; hash (24 bits of the text) tells texts with one doc apart. packed has the
    same rows with the text compressed, to be read again.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("doc", "hash", "text")
    hot = spark.sparkContext.broadcast(_hot_grams(rows, length, gram, least=hot_least, per_shard=per_shard))
    runs = in_arrow(rows, "key long, doc long, place long, state int", _runs_of(length, gram, hot, slice_bytes))
    looked = runs.repartition(n, "key").mapInArrow(_look(per_shard), "doc long, hash long, place long, key long, state int")
    wanted = looked.groupBy("doc", "hash").agg(F.collect_list(F.struct("place", "key", "state")).alias("runs"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(n, -(-4 * size // BUCKET_BYTES))  # contexts overlap: their bytes are up to four times the texts'
    dealt = in_arrow(packed.join(wanted, ["doc", "hash"]), _DEALT, _fetch(length, buckets))
    found = dealt.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket").mapInArrow(_shards(length, shard_bytes), _SEEN)
    found = found.repartition(n, "route").mapInArrow(_across, "doc long, hash long, first long, last long")
    by = found.groupBy("doc", "hash").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def spans(batch: pa.RecordBatch):
        got = []
        for runs in batch.column("runs").to_pylist():
            s, e = _spans(np.array([r["first"] for r in runs], np.int64), np.array([r["last"] for r in runs], np.int64), length)
            got.append([{"start": a, "end": b} for a, b in zip(s, e, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("hash"), pa.array(got, _SPANS_TYPE)], names=["doc", "hash", "spans"])

    return in_arrow(by, f"doc long, hash long, spans {_SPANS}", spans)


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, hot_least: int = 8, per_shard: int = SHARD_PLACES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, text binary, spans, kept binary): the bytes of each text, the repeated spans, and what is left.

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a document with a
    smaller id (a null id is smaller than all), or earlier in the same one. Null text is empty. Rows
    with equal id and text are one document, and each has its result; rows with equal ids and different
    texts are told apart by 24 bits of the texts' hashes and are ordered by place only. Long texts are
    searched in slices, so that only the bytes of one text have to fit into a task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    rows = rows.withColumns({"doc": F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))), "hash": F.xxhash64("text").bitwiseAND(F.lit((1 << _TEXT_BITS) - 1))})

    def pack(batch: pa.RecordBatch):
        press = zstandard.ZstdCompressor(level=3).compress
        for part in pieces(batch, "text", 1 << 20):
            packed = pa.array([press(t) for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("doc"), part.column("hash"), packed], names=["id", "doc", "hash", "packed"])

    kind = dict(docs.dtypes)[id_col]
    packed = in_arrow(rows.select("id", "doc", "hash", "text"), f"id {kind}, doc long not null, hash long not null, packed binary not null", pack)
    found = repeated_spans(rows, packed, length, shard_bytes=shard_bytes, hot_least=hot_least, per_shard=per_shard, slice_bytes=slice_bytes)
    joined = packed.join(found, ["doc", "hash"], "left").select("id", "packed", "spans")

    def cut(batch: pa.RecordBatch):
        unpack = zstandard.ZstdDecompressor().decompress
        for part in pieces(batch, "packed", 1 << 20):
            texts = [unpack(t) for t in part.column("packed").to_pylist()]
            kept = []
            for text, spans in zip(texts, part.column("spans").to_pylist(), strict=True):
                ends = [0, *(s["end"] for s in spans or [])]
                starts = [*(s["start"] for s in spans or []), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, starts, strict=True)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.binary()), part.column("spans"), pa.array(kept, pa.binary())], names=["id", "text", "spans", "kept"])

    return in_arrow(joined, f"id {kind}, text binary, spans array<struct<start: long, end: long>>, kept binary", cut)
