"""Benchmark decontamination by a prefix-filtered containment join.

Every window of an item must lie in a document whole, so one of its shingles, its prefix, suffices to
find it: the one that is rarest in the corpus. Where a document has that shingle, its place in the
window gives the window's place in the document (positional bound), which must lie inside the document
(length bound); then the words are compared one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, pieces, settled, with_row

#: Bytes of benchmark text in one block. Blocks are what the driver holds and broadcasts; more text is more blocks.
BLOCK_BYTES = 16 << 20
#: Words of an item that are one row of a block; longer items are several, which overlap.
ITEM_WORDS = 100_000

_WORD = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII digits, letters (in lower case) and all characters beyond ASCII."""
    return text.translate(_TO_WORDS).split()


@dataclass
class Windows:
    """A block's windows as slices of its items' words, which are numbers. A shingle is two words, or the word of a window of one."""

    vocab: dict[bytes, int]  # from 1; 0 is any other word
    items: list[str]
    words: np.ndarray  # of all items, one behind the other, 0 behind each
    item: np.ndarray  # of each window
    start: np.ndarray  # in words
    length: np.ndarray
    width: int

    @classmethod
    def of(cls, rows: list[Row], width: int) -> Windows:
        vocab: dict[bytes, int] = {}
        names: dict[str, int] = {}
        words, item, start, length, at = [np.zeros(0, np.int32)], [], [], [], 0
        for row in rows:
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(bytes(row["text"] or b""))]
            if ids and row["item"] is not None:
                n = max(1, len(ids) - width + 1)
                words.append(np.array([*ids, 0], np.int32))
                item.append(np.full(n, names.setdefault(row["item"], len(names)), np.int32))
                start.append(np.arange(at, at + n, dtype=np.int32))
                length.append(np.full(n, min(width, len(ids)), np.int32))
                at += len(ids) + 1
        join = lambda x: np.concatenate([np.zeros(0, np.int32), *x])
        return cls(vocab, list(names), np.concatenate(words), join(item), join(start), join(length), width)

    def pairs(self) -> np.ndarray:
        """The key of the pair of words at each place, -1 at an item's last word and behind it."""
        after = np.append(self.words[1:], 0)[: len(self.words)]
        return np.where((self.words > 0) & (after > 0), self.words.astype(np.int64) * (len(self.vocab) + 1) + after, -1)

    def keys(self) -> np.ndarray:
        """The shingles' keys, sorted, each once."""
        pairs, single = self.pairs(), self.words[self.start[self.length == 1]]
        return np.unique(np.concatenate([pairs[pairs >= 0], single.astype(np.int64)]))


def _corpus(windows: Windows, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' words as numbers, one 0 behind each text; where texts start; numbers of words; pair keys at places."""
    get = windows.vocab.get
    each = [words_of(t or b"") for t in texts]
    sizes = np.array([len(w) for w in each], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    ids = np.fromiter((get(w, 0) for words in each for w in (*words, b"")), np.int64, int((sizes + 1).sum()))
    pairs = ids * (len(windows.vocab) + 1) + np.append(ids[1:], 0)
    return ids, starts, sizes, pairs


def _rarity(docs: DataFrame, windows: Windows) -> np.ndarray:
    """In how many places of the whole corpus each of the block's shingles stands, by the shingles' sorted keys."""
    keys = windows.keys()
    shared = docs.sparkSession.sparkContext.broadcast((windows, keys))

    def run(batch: pa.RecordBatch):
        windows, keys = shared.value
        total = np.zeros(len(keys), np.int64)
        for part in pieces(batch, "text", 2 << 20):
            ids, _, _, pairs = _corpus(windows, part.column("text").to_pylist())
            for seen in (ids[ids > 0], pairs[(ids > 0) & (np.append(ids[1:], 0) > 0)]):
                at = np.searchsorted(keys, seen)
                hit = at[keys[np.minimum(at, len(keys) - 1)] == seen]
                total += np.bincount(hit[hit < len(keys)], minlength=len(keys))[: len(keys)]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    counted = in_arrow(docs.select("text"), "k long, n long", run).groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    rarity = np.zeros(len(keys), np.int64)
    rarity[counted.column("k").to_numpy()] = counted.column("n").to_numpy()
    return rarity


@dataclass
class Prefixes:
    """For each prefix shingle: the windows that have it as their rarest, and its place in them."""

    keys: np.ndarray
    first: np.ndarray  # of a key's windows in `window`
    window: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, windows: Windows, rarity: np.ndarray) -> Prefixes:
        keys, pairs = windows.keys(), windows.pairs()
        cost = np.where(pairs >= 0, rarity[np.searchsorted(keys, np.maximum(pairs, keys[0]))], 0) if len(keys) else pairs
        place, own, least = np.zeros(len(windows.start), np.int32), windows.words[windows.start].astype(np.int64), np.full(len(windows.start), np.iinfo(np.int64).max)
        for j in range(windows.width - 1):
            at = np.minimum(windows.start + j, len(pairs) - 1)
            better = (j < windows.length - 1) & (cost[at] < least)
            place[better], own[better], least[better] = j, pairs[at[better]], cost[at[better]]
        order = np.argsort(own, kind="stable").astype(np.int32)
        known, first = np.unique(own[order], return_index=True)
        return cls(known, np.append(first, len(order)), order, place[order])

    def candidates(self, at: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) for shingles `seen` at places `at`."""
        k = np.searchsorted(self.keys, seen)
        hit = self.keys[np.minimum(k, len(self.keys) - 1)] == seen
        at, k = at[hit], k[hit]
        n = self.first[k + 1] - self.first[k]
        rows = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.window[rows], np.repeat(at, n) - self.place[rows]


def _matches(windows: Windows, prefixes: Prefixes, texts: list[bytes | None]):
    """(text, start, end, item) of every occurrence of a window, in words of the text; numbers of words."""
    ids, starts, sizes, pairs = _corpus(windows, texts)
    two = np.flatnonzero((ids > 0) & (np.append(ids[1:], 0) > 0))
    one = np.flatnonzero(ids > 0)
    found = [prefixes.candidates(two, pairs[two]), prefixes.candidates(one, ids[one])]
    window, start = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(starts, np.maximum(start, 0), side="right") - 1
    length = windows.length[window]
    ok = (start >= starts[text]) & (start + length <= starts[text] + sizes[text])
    for j in range(windows.width):
        window, start, text, length = window[ok], start[ok], text[ok], length[ok]
        if not len(window):
            break
        ok = (j >= length) | (ids[np.minimum(start + j, len(ids) - 1)] == windows.words[np.minimum(windows.start[window] + j, len(windows.words) - 1)])
    else:
        window, start, text, length = window[ok], start[ok], text[ok], length[ok]
    return text, start - starts[text], start - starts[text] + length, windows.item[window], sizes


def _union(starts: list[int], ends: list[int]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KINDS = "spans array<struct<start: long, end: long>>, items array<string>"


def _found(windows: Windows, prefixes: Prefixes, texts: list[bytes | None]) -> tuple[np.ndarray, dict[int, tuple[list[dict], list[str]]]]:
    """Numbers of words, and of each text with a hit its spans and items."""
    if not len(windows.start):
        return np.array([len(words_of(t or b"")) for t in texts], np.int64), {}
    text, start, end, item, sizes = _matches(windows, prefixes, texts)
    order, out = np.argsort(text, kind="stable"), {}
    for group in np.split(order, np.flatnonzero(np.diff(text[order])) + 1) if len(order) else []:
        out[int(text[group[0]])] = _union(start[group].tolist(), end[group].tolist()), sorted(windows.items[i] for i in set(item[group].tolist()))
    return sizes, out


def _item_rows(benchmark: DataFrame, width: int, most: int) -> DataFrame:
    """(item, text) of items that have an id; an item of over `most` words in several rows, which have each window once."""

    def run(batch: pa.RecordBatch):
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            cuts = [text] if len(words) <= most + width else [b" ".join(words[s : s + most + width - 1]) for s in range(0, len(words) - width + 1, most)]
            for cut in cuts:
                yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([cut], pa.binary())], names=["item", "text"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode("text", "UTF-8").alias("text"))
    return in_arrow(rows.where("item is not null and text is not null"), "item string, text binary", run)


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: bool = False, item_words: int = ITEM_WORDS
) -> DataFrame:
    """(id, n_words, spans, items): per document the word spans [start, end) inside occurrences of windows, and the items.

    A window is `width` consecutive words of an item, or all of an item of fewer words. Null texts have
    no words; items without words or with a null id have no windows; items with the same id count as one.
    Long texts are taken whole: a task holds one text and about 20 bytes a word.
    benchmark has item_id and text. It is read in blocks of about block_bytes, of which each is broadcast
    (some ten bytes for each of its own) and sees all documents. One block's finds go straight to the rows;
    of several blocks the few documents with hits are joined to the rows by id and text, once.
    Only id and text are read, unless all columns are to be carried along, in a struct `row`.
    """
    spark = docs.sparkSession
    items = _item_rows(benchmark, width, item_words)
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    items = items if blocks == 1 else settled(items)
    more = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"), *more)
    kind, tail = rows.schema["id"], ["row"] if carry else []
    schema = lambda middle: T.StructType([kind, *T._parse_datatype_string(middle).fields, *(rows.schema[c] for c in tail)])

    def block(k: int):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        windows = Windows.of(part.collect(), width)
        return spark.sparkContext.broadcast((windows, Prefixes.of(windows, _rarity(rows, windows)) if len(windows.start) else None))

    def spelled(sizes, found: list[tuple], part: pa.RecordBatch) -> pa.RecordBatch:
        columns = [part.column("id"), pa.array(sizes), pa.array([s for s, _ in found], _SPANS), pa.array([i for _, i in found], pa.list_(pa.string())), *(part.column(c) for c in tail)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "spans", "items", *tail])

    if blocks == 1:
        shared = block(0)

        def whole(batch: pa.RecordBatch):
            for part in pieces(with_row(batch, id_col, text_col) if carry else batch, "text", 2 << 20):
                sizes, found = _found(*shared.value, part.column("text").to_pylist())
                yield spelled(sizes, [found.get(i, ([], [])) for i in range(part.num_rows)], part)

        return in_arrow(rows.select("row") if carry else rows, schema(f"n_words long, {_KINDS}"), whole)

    keyed = rows.withColumn("h", F.xxhash64("text"))
    hits = None
    for k in range(blocks):
        shared = block(k)

        def some(batch: pa.RecordBatch, shared=shared):
            for part in pieces(batch, "text", 2 << 20):
                _, found = _found(*shared.value, part.column("text").to_pylist())
                if found:
                    at = pa.array(list(found))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("h").take(at), *(pa.array(c, t) for c, t in zip(zip(*found.values(), strict=True), (_SPANS, pa.list_(pa.string())), strict=True))], names=["id", "h", "spans", "items"])

        one = settled(in_arrow(keyed.select("id", "text", "h"), T.StructType([kind, *T._parse_datatype_string(f"h long, {_KINDS}").fields]), some))
        shared.unpersist()
        hits = one if hits is None else hits.unionByName(one)
    hits = hits.groupBy("id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")).withColumnsRenamed({"id": "id2", "h": "h2"})
    joined = keyed.join(hits, keyed["id"].eqNullSafe(hits["id2"]) & (keyed["h"] == hits["h2"]), "left").select("id", "text", "spans", "items", *tail)

    def merged(batch: pa.RecordBatch):
        for part in pieces(batch, "text", 2 << 20):
            sizes = np.array([len(words_of(t or b"")) for t in part.column("text").to_pylist()], np.int64)
            found = [(_union([x["start"] for x in s or ()], [x["end"] for x in s or ()]), sorted(set(i or ()))) for s, i in zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)]
            yield spelled(sizes, found, part)

    return in_arrow(joined, schema(f"n_words long, {_KINDS}"), merged)


def judged(found: DataFrame) -> DataFrame:
    """found with n_hit (words in spans) and contaminated: hit at all, in a twentieth of the words or more."""
    n_hit = F.aggregate("spans", F.lit(0).cast(T.LongType()), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    return judged(contamination(docs, benchmark, id_col=id_col, text_col=text_col, carry=True)).where("not contaminated").select("row.*")
