"""Packing of token pieces into sequences by swap-based local search: exchanges fill bins until others are empty."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces, settled


def _byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable bytes stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranked_encoder(tokenizer_file: str):
    """The file's byte-level BPE in an encoder that takes ids as ranks; None if ids don't follow the merges."""
    import json
    from pathlib import Path

    import tiktoken

    model = json.loads(Path(tokenizer_file).read_text(encoding="utf-8"))
    vocab, alphabet = model["model"]["vocab"], _byte_alphabet()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    made = [vocab["".join(m)] for m in merges]
    step = model["pre_tokenizer"]
    if step["type"] != "ByteLevel" or step.get("add_prefix_space") or model.get("normalizer") or made != sorted(set(made)):
        return None
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocab.items() if t not in special}
    # Fixed value: the pattern of the ByteLevel splitter.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("of-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class ByteIds:
    """Ids of whole texts as little-endian 32-bit bytes, as the tokenizers library gives them.

    Texts go through a faster encoder of the same vocabulary where its ids follow the merges, else
    through the library; so do texts that hold the string of an added token.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_file)
        fast = _ranked_encoder(tokenizer_file)
        self.encode = fast.encode_ordinary if fast else self._whole
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None

    def _whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(self._whole(t) if self.added(t) else self.encode(t), "<u4").tobytes() for t in texts]


@lru_cache(maxsize=2)
def _encoder(tokenizer_file: str) -> ByteIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    return ByteIds(tokenizer_file)


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece int from 0, start long, length long, ids binary): each text's ids and then end_id.

    ids holds little-endian unsigned 32-bit numbers. A document of more than `capacity` ids is cut into
    pieces of that length, of which the first may be shorter; others are one piece. Null text is empty:
    one piece, which holds end_id alone. Long texts are encoded whole. Repeated rows give their pieces each.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch):
        for part in pieces(batch, "text", 2 << 20):
            rows, nums, starts, found = [], [], [], []
            for row, raw in enumerate(_encoder(tokenizer_file).ids([t or "" for t in part.column("text").to_pylist()])):
                raw += end
                cut, at, k = (len(raw) // 4) % capacity or capacity, 0, 0
                while at < len(raw) // 4:
                    rows.append(row), nums.append(k), starts.append(at), found.append(raw[4 * at : 4 * (at + cut)])
                    at, cut, k = at + cut, capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(rows)), pa.array(nums, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(b) // 4 for b in found], pa.int64()), pa.array(found, pa.binary())],
                names=[id_col, "piece", "start", "length", "ids"],
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(rows, f"`{id_col}` {kind}, piece int, start long, length long, ids binary", run)


class Bins:
    """Bins of one capacity with items of integer sizes, filled one after the other in the items' order.

    That start wastes a good part of the bins; all packing beyond it is the local search's.
    """

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes.tolist(), capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self.exchanges = 0
        for item, size in enumerate(self.sizes):
            if not self.bins or self.fill[-1] + size > capacity:
                self.bins.append([])
                self.fill.append(0)
            self.bins[-1].append(item)
            self.fill[-1] += size

    def improve(self) -> None:
        """Exchanges between underfull bins until none is left that raises the sum of squared fills.

        Bins with the largest items first, each takes from those still to come: an item that fits; one larger
        item for one of its own; one larger item for two of its own. Only exchanges that raise the sum of
        squares are made, so the search ends. A bin that is emptied goes. Where no fewer bins could hold
        all items, it is done.
        """
        least = -(-sum(self.sizes) // self.capacity)
        while len(self.bins) > least:
            before = (len(self.bins), self.exchanges)
            self._sweep()
            if (len(self.bins), self.exchanges) == before:
                return

    def _sweep(self) -> None:
        cap, sizes, bins, fill = self.capacity, self.sizes, self.bins, self.fill
        where: list[dict[int, int]] = [{} for _ in range(cap + 1)]  # size -> item -> bin, of bins still to come
        mask = 0
        todo = sorted((b for b in range(len(bins)) if fill[b] < cap), key=lambda b: (max(sizes[i] for i in bins[b]), fill[b]))
        for b in todo:
            for item in bins[b]:
                where[sizes[item]][item] = b
                mask |= 1 << sizes[item]

        def out(item: int) -> None:
            nonlocal mask
            del where[sizes[item]][item]
            if not where[sizes[item]]:
                mask &= ~(1 << sizes[item])

        def largest(low: int, high: int, most: int) -> tuple[int, int]:
            """The largest item above low and up to high, and its size, whose bin holds less than `most` and what it gains; else size 0."""
            usable = mask & ((1 << (high + 1)) - 1)
            while size := usable.bit_length() - 1 if usable >> (low + 1) else 0:
                for item, b in where[size].items():
                    if fill[b] < most + size - low:
                        return size, item
                usable ^= 1 << size
            return 0, -1

        while todo:
            a = todo.pop()
            if not bins[a]:
                continue
            for item in bins[a]:
                out(item)
            while space := cap - fill[a]:
                give: tuple[int, ...] = ()
                gain, item = largest(0, space, fill[a])
                if not gain:
                    own: dict[int, list[int]] = {}
                    for i in bins[a]:
                        own.setdefault(sizes[i], []).append(i)
                    known = sorted(own)
                    sums = [(x, (own[x][-1],)) for x in known]
                    sums += [(x + y, (own[x][-1], own[y][-1 if y > x else -2])) for k, x in enumerate(known) for y in known[k if len(own[x]) > 1 else k + 1 :]]
                    for x, items in sums:
                        if gain < space and x + gain < cap:
                            size, found = largest(x + gain, min(cap, x + space), fill[a] + gain)
                            if size:
                                gain, item, give = size - x, found, items
                if not gain:
                    break
                b = where[sizes[item]][item]
                out(item)
                bins[b].remove(item)
                bins[a].append(item)
                for i in give:
                    bins[a].remove(i)
                    bins[b].append(i)
                    where[sizes[i]][i] = b
                    mask |= 1 << sizes[i]
                fill[a] += gain
                fill[b] -= gain
                self.exchanges += 1
        keep = [b for b in range(len(bins)) if bins[b]]
        self.bins, self.fill = [bins[b] for b in keep], [fill[b] for b in keep]


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Per item: its bin's number and its offset there. Items that fill a bin have one each."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = np.flatnonzero(sizes >= capacity)
    bin_of[full] = np.arange(len(full))
    rest = np.flatnonzero(sizes < capacity)
    bins = Bins(sizes[rest], capacity)
    bins.improve()
    for b, items in enumerate(bins.bins):
        at = rest[items]
        bin_of[at] = len(full) + b
        offset[at] = np.cumsum(sizes[at]) - sizes[at]
    return bin_of, offset


def pack(items: DataFrame, capacity: int = 2048, share: int = 50_000) -> DataFrame:
    """items with two columns more: sequence_id and offset, so that no sequence exceeds `capacity`.

    items has a column `length` (1 to capacity); columns that have the new ones' names give way to them. Shares of about `share` rows are dealt out evenly and
    packed each by itself: a share's last, partly filled sequences are its only loss, and its size
    bounds a task's memory at any number of rows. Rows aren't ordered; repeated rows are packed each.
    """
    items = settled(items.drop("sequence_id", "offset"))
    n = items.count()
    names = items.columns
    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        bin_of, offset = pack_sizes(rows.column("length").to_numpy(), capacity)
        first = TaskContext.get().partitionId() << 32
        rows = rows.append_column("sequence_id", pa.array(bin_of + first)).append_column("offset", pa.array(offset))
        yield from rows.to_batches(max_chunksize=10_000)

    return items.select(*names).repartition(max(1, -(-n // share))).mapInArrow(run, f"{kinds}, sequence_id long, offset long")
