"""Token counts by rank-synchronous merging of ragged numpy arrays.

Null and empty texts have no tokens. Repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

SPACE = "▁"
_NEVER = np.int64(1) << 60


class PieceMerges:
    """The merges of a BPE vocabulary of pieces, as sorted arrays of pairs.

    A symbol is a piece's number, or, for a character that is no piece, a number above all pieces'.
    A pair of symbols may be merged if their strings together are a piece; its rank is that piece's
    place by falling score.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib, n = self.lib, self.lib.vocab_size()
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in normal):
            raise ValueError("a vocabulary with unused pieces is not supported")
        by_name = {lib.id_to_piece(i): i for i in normal}
        if any(SPACE in name.lstrip(SPACE) for name in by_name):
            raise ValueError("a vocabulary with pieces that go on over a space is not supported")
        scores = np.array([lib.get_score(i) for i in normal])
        rank_of = dict(zip(normal, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        self.width = 2 * n + 0x110000
        self.chars: dict[str, int] = {}
        triples = {}
        for name, i in by_name.items():
            for cut in range(1, len(name)):
                left, right = name[:cut], name[cut:]
                a = by_name.get(left, self._char(left, n) if cut == 1 else None)
                b = by_name.get(right, self._char(right, n) if len(right) == 1 else None)
                if a is not None and b is not None:
                    triples[a * self.width + b] = (rank_of[i], i)
        keys = np.array(sorted(triples), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([triples[k][0] for k in keys.tolist()] + [_NEVER], np.int64)
        self.made = np.array([triples[k][1] for k in keys.tolist()] + [0], np.int64)
        # A piece is steady if no piece that begins or ends with it goes before it: once merged, it waits for all
        # pairs of its own rank.
        self.steady = np.ones(n, bool)
        for key, (rank, _) in triples.items():
            for part in divmod(key, self.width):
                if part < n and rank <= rank_of.get(part, -1):
                    self.steady[part] = False
        self.single = {p: i for p, i in by_name.items() if len(p) == 1}
        self.n = n

    def _char(self, c: str, n: int) -> int:
        return n + ord(c)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NEVER), np.where(hit, self.made[at], 0)

    def count(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each word, all words merged in step.

        Each round merges, in every word at once, its pairs of lowest rank that don't overlap from the left, or,
        where they make a piece that isn't steady, the leftmost alone: the order of one merge at a time. So a
        long word takes a round for each rank rather than for each merge. Words without pairs to merge leave the arrays.
        """
        out = np.zeros(len(words), np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        kinds, where = np.unique(points, return_inverse=True)
        names = [chr(c) for c in kinds.tolist()]
        known = np.array([self.single.get(c, self.n + ord(c)) for c in names], np.int64)
        cost = np.array([1 if c in self.single else len(c.encode("utf-8", "surrogatepass")) for c in names], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        np.add.at(out, word, cost[where])
        sym = known[where]
        # Pair j joins symbols j and j + 1; the last symbol of a word has none.
        rank, made = self._pairs(sym, word)
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            alive = least < _NEVER
            if not alive.all():
                sym, word, rank, made, least = sym[alive], word[alive], rank[alive], made[alive], least[alive]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == least)
            first = np.append(True, word[hits][1:] != word[hits][:-1])  # the leftmost of each word
            if not first.all():
                place = np.arange(len(hits))
                run = np.maximum.accumulate(np.where(first | np.append(True, hits[1:] != hits[:-1] + 1), place, 0))
                steady = np.minimum.reduceat(self.steady[made[hits]], np.flatnonzero(first))[np.cumsum(first) - 1]
                hits = hits[first | (steady & ((place - run) % 2 == 0))]
            # Two symbols become one. A part that is no piece (a lone unknown character) costs its bytes
            # at first; once merged, the pair costs what one piece costs.
            gone = self._cost(sym[hits]) + self._cost(sym[hits + 1]) - 1
            np.subtract.at(out, word[hits], gone)
            sym[hits] = made[hits]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            for j in (at, at[at > 0] - 1):
                ok = (j + 1 < len(sym)) & (word[np.minimum(j + 1, len(sym) - 1)] == word[j])
                rank[j], made[j] = _NEVER, 0
                k = j[ok]
                rank[k], made[k] = self.rank(sym[k], sym[k + 1])
        return out

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(sym), _NEVER), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same], made[same] = self.rank(sym[same], sym[same + 1])
        return rank, made

    def _cost(self, sym: np.ndarray) -> np.ndarray:
        c = sym - self.n
        utf8 = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        return np.where(sym < self.n, 1, utf8)


class TokenCounter:
    """Counts tokens of whole texts; counts of words met before are kept, up to `memory` words."""

    def __init__(self, model_file: str, memory: int = 400_000, block: int = 50_000):
        self.merges, self.memory, self.block = PieceMerges(model_file), memory, block
        self.known: dict[str, int] = {}
        self.plain = self.merges.lib.normalize(f" a  éﬁ{SPACE}\t\n ") == f"{SPACE}{SPACE}a{SPACE}{SPACE}éﬁ{SPACE}\t\n{SPACE}"
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def words(self, text: str) -> list[str]:
        """Pre-tokens: no piece goes on over a mark of space behind other characters."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE) if self.plain else self.merges.lib.normalize(text)
        parts = text.split(SPACE)
        if parts[0] == "" and "" not in parts[1:]:
            return [SPACE + p for p in parts[1:]]
        return self.split(text)

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.words(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(new) > self.memory:
            self.known.clear()
            new = list({w for words in split for w in words})
        for i in range(0, len(new), self.block):
            part = new[i : i + self.block]
            self.known.update(zip(part, self.merges.count(part).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in split]


@lru_cache(maxsize=2)
def _counter(model_file: str) -> TokenCounter:
    return TokenCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens by the piece vocabulary at model_file, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes, 0 tokens; repeated rows count each. A narrow map: no shuffle, a batch of
    texts in memory. Long texts are counted whole; a word takes a round for each rank that is merged in it.
    """

    def run(batch: pa.RecordBatch):
        from .common import pieces

        for part in pieces(batch, "text", 4 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            n = _counter(model_file).counts(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return in_arrow(rows, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", run)
