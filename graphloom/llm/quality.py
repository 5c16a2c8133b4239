"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Viterbi decoding gives each text's best labels; the share of its words in content lines decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, pieces, with_row

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
#: Classes of bytes that features count: white space, symbols, upper case, digits, marks that end a sentence, "!", "|".
_CLASSES = [_SPACES, SYMBOLS, bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?", b"!", b"|"]
_TABLE = np.zeros((len(_CLASSES), 256), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _TABLE[_k, list(_c)] = 1
FEATURES = ("bias", "first", "symbols", "many symbols", "upper", "mostly upper", "digits", "marks", "exclamation", "many exclamation", "bars", "many bars", "repeated", "echo", "much echo", "short words", "long words", "one word")
WINDOW = 8


@dataclass
class Lines:
    """Lines of a batch of texts that have words: of which text, how many words, their features."""

    text: np.ndarray
    words: np.ndarray
    features: np.ndarray


def number_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts as numbers, equal for equal words, and how many each text has."""
    each = [t.split() for t in texts]
    sizes = np.array([len(w) for w in each], np.int64)
    number: dict[bytes, int] = {}
    for words in each:
        for w in words:
            if w not in number:
                number[w] = len(number)
    return np.fromiter((number[w] for words in each for w in words), np.int64, int(sizes.sum())), sizes


def split_lines(texts: list[bytes], ids: np.ndarray) -> tuple[Lines, np.ndarray]:
    """The lines with words, and per text the number of lines with a word that equal an earlier line."""
    each = [t.split(b"\n") for t in texts]
    flat = [x for lines in each for x in lines]
    text = np.repeat(np.arange(len(texts)), [len(x) for x in each])
    size = np.array([len(x) for x in flat], np.int64) + 1
    raw = np.frombuffer(b"\n".join(flat) + b"\n", np.uint8)
    starts = np.cumsum(size) - size
    counts = np.stack([np.add.reduceat(t[raw].astype(np.int32), starts) for t in _TABLE], 1)
    space = _TABLE[0][raw].astype(bool)
    begins = ~space & np.append(True, space[:-1])
    words = np.add.reduceat(begins.astype(np.int32), starts)
    seen: list[bool] = []
    for lines in each:
        met: set[bytes] = set()
        for x in lines:
            seen.append(x in met)
            met.add(x)
    again = np.array(seen, bool) & (words > 0)
    n_dup = np.bincount(text[again], minlength=len(texts))
    have = words > 0
    counts, w, chars, text_of = counts[have], words[have], (size - counts[:, 0])[have], text[have]
    line = np.repeat(np.arange(len(w)), w)
    echo = np.flatnonzero((ids[1:] == ids[:-1]) & (line[1:] == line[:-1]))
    echo = np.bincount(line[echo], minlength=len(w)) / w
    mean = chars / w
    share = lambda k, of: np.minimum(1, counts[:, k] / of)
    symbols, upper, loud, bars = share(1, w), share(2, chars), share(5, w), share(6, w)
    first = np.append(True, text_of[1:] != text_of[:-1])[: len(w)]
    features = np.stack(
        [np.ones(len(w)), first, symbols, symbols > 0.3, upper, upper > 0.6, share(3, chars), share(4, w), loud, loud > 0.3, bars, bars > 0.3, again[have], echo, echo > 0.3, mean < 3, mean > 12, w == 1], 1
    )
    return Lines(text_of, w, features), n_dup


def repeated_words(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: its words in windows of 8 words that stand twice or more in the text."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    flagged = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(text[WINDOW - 1 :] == text[: len(text) - WINDOW + 1]) if len(ids) >= WINDOW else np.zeros(0, np.int64)
    if len(starts):
        # A random number for each word, and for each text, mixed into one key for a window.
        mix = lambda x: (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        fold = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        word_key, key = fold(mix(ids)), fold(mix(text[starts] + len(ids)))
        for j in range(WINDOW):
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25) + word_key[starts + j]
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        a, b = starts[order[same]], starts[order[same + 1]]
        true = (text[a] == text[b]) & np.logical_and.reduce([ids[a + j] == ids[b + j] for j in range(WINDOW)])
        if not true.all():  # keys that collide: compare the windows themselves
            a, b = _equal_windows(ids, text, starts)
        hit = np.unique(np.concatenate([a, b]))
        np.add.at(flagged, hit, 1)
        np.add.at(flagged, hit + WINDOW, -1)
    inside = np.cumsum(flagged[:-1]) > 0
    return np.bincount(text[inside], minlength=len(sizes))


def _equal_windows(ids: np.ndarray, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first: dict[tuple[int, ...], int] = {}
    pairs = [(first.setdefault((int(text[s]), *ids[s : s + WINDOW].tolist()), s), s) for s in starts.tolist()]
    pairs = [p for p in pairs if p[0] != p[1]]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


class Chains:
    """Lines as chains, one per text, so ordered that step t of all chains is a slice: longest first."""

    def __init__(self, lines: Lines):
        starts = np.flatnonzero(np.append(True, lines.text[1:] != lines.text[:-1])) if len(lines.text) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(lines.text)))
        order = np.argsort(-sizes, kind="stable")
        self.text = lines.text[starts][order] if len(starts) else starts
        starts, sizes = starts[order], sizes[order]
        self.steps = [starts[: np.searchsorted(-sizes, -t, side="left")] + t for t in range(int(sizes[0]) if len(sizes) else 0)]
        self.last = starts + sizes - 1


@dataclass
class LineField:
    """Weights of the field: labels x features, label before x label, and how much content a text must have."""

    weights: np.ndarray
    moves: np.ndarray
    least: float = 0.5

    def decode(self, lines: Lines) -> np.ndarray:
        """The best label of each line (1: content), all chains decoded in step."""
        score = lines.features @ self.weights.T
        chains, back = Chains(lines), np.zeros((len(lines.text), 2), np.int8)
        best = np.zeros((0, 2))
        ends = np.zeros((len(chains.text), 2))
        for t, at in enumerate(chains.steps):
            if t:
                paths = best[: len(at), :, None] + self.moves[None]
                back[at] = paths.argmax(1)
                best = paths.max(1) + score[at]
            else:
                best = score[at]
            ends[: len(at)] = best
        labels = np.zeros(len(lines.text), np.int8)
        labels[chains.last] = ends.argmax(1)
        for t in range(len(chains.steps) - 1, 0, -1):
            at = chains.steps[t]
            labels[at - 1] = back[at, labels[at]]
        return labels

    def content(self, lines: Lines, n_texts: int) -> np.ndarray:
        """Per text: the share of its words in content lines; 0 without words."""
        words = np.bincount(lines.text, lines.words, minlength=n_texts)
        good = np.bincount(lines.text, lines.words * self.decode(lines), minlength=n_texts)
        return good / np.maximum(words, 1)

    @classmethod
    def learn(cls, lines: Lines, quality: np.ndarray, least: float = 0.5, most_rounds: int = 8) -> LineField:
        """A field from the quality (0 or 1) of whole texts, where lines' own labels are unknown.

        Lines begin with their text's label, and a model of single lines is fitted to them. Then lines take the
        labels that are decoded, corrected only where a text's share of content denies its quality: there
        the lines that lean least to their label change it. A field is trained on these, and so on until no
        label changes, or most_rounds fields have been trained (labels may go to and fro).
        """
        labels = quality[lines.text]
        for k in range(most_rounds):
            field = cls.train(lines, labels, chained=k > 0)
            field.least = least
            now = field.agreeing(lines, quality)
            if k and (now == labels).all():
                break
            labels = now
        return field

    def agreeing(self, lines: Lines, quality: np.ndarray) -> np.ndarray:
        """Decoded labels, changed in the fewest words so that each text's share of content agrees with its quality."""
        labels = self.decode(lines).astype(np.int64)
        lean = lines.features @ (self.weights[1] - self.weights[0])
        words, good = (np.bincount(lines.text, w, minlength=len(quality)) for w in (lines.words, lines.words * labels))
        for t in np.flatnonzero((good >= self.least * words) != (quality == 1)).tolist():
            rows = np.flatnonzero(lines.text == t)
            rows = rows[labels[rows] != quality[t]]
            for i in rows[np.argsort(-lean[rows] if quality[t] else lean[rows], kind="stable")].tolist():
                labels[i] = quality[t]
                good[t] += lines.words[i] * (1 if quality[t] else -1)
                if (good[t] >= self.least * words[t]) == (quality[t] == 1):
                    break
        return labels

    @classmethod
    def train(cls, lines: Lines, labels: np.ndarray, rounds: int = 100, decay: float = 1e-4, chained: bool = True) -> LineField:
        """Weights of the greatest likelihood of the lines' labels, by forward-backward and gradient steps.

        Unless chained, labels of neighbours count for nothing.
        """
        n, chains = len(labels), Chains(lines)
        weights, moves = np.zeros((2, lines.features.shape[1])), np.zeros((2, 2))
        onehot = np.eye(2)[labels]
        inner = np.concatenate(chains.steps[1:]) if len(chains.steps) > 1 else np.zeros(0, np.int64)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
        moment = [np.zeros(weights.size + 4), np.zeros(weights.size + 4)]
        for step in range(1, rounds + 1):
            score = lines.features @ weights.T
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            for t, at in enumerate(chains.steps):
                ahead[at] = score[at] + (_logsum(ahead[at - 1][:, :, None] + moves[None], 1) if t else 0)
            for at in chains.steps[:0:-1]:
                behind[at - 1] = _logsum((score[at] + behind[at])[:, None, :] + moves[None], 2)
            whole = _logsum(ahead + behind, 1)
            share = np.exp(ahead + behind - whole[:, None])
            pair = ahead[inner - 1][:, :, None] + moves[None] + (score + behind)[inner][:, None, :] - whole[inner][:, None, None]
            slope = np.append(((onehot - share).T @ lines.features / n - decay * weights).ravel(), ((seen - np.exp(pair).sum(0)) / n - decay * moves).ravel())
            for m, x, keep in ((moment[0], slope, 0.9), (moment[1], slope**2, 0.999)):
                m += (1 - keep) * (x - m)
            change = 0.3 * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
            weights += change[:-4].reshape(weights.shape)
            if chained:
                moves += change[-4:].reshape(2, 2)
        return cls(weights, moves)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train_field(docs: DataFrame, labels: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> LineField | None:
    """A field from at most `sample` documents labelled 0 or 1, taken by a hash of their ids.

    Lines' own labels are learned (see LineField.learn). Only sizes and features of lines come to the driver.
    None if a quality has no documents with lines.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("id is not null and quality in (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batch: pa.RecordBatch):
        for part in pieces(batch, "text", 2 << 20):
            texts = part.column("text").to_pylist()
            lines, _ = split_lines(texts, number_words(texts)[0])
            of = part.column("id").to_numpy()[lines.text]
            label = part.column("quality").to_numpy()[lines.text]
            rows = np.flatnonzero(np.append(True, lines.text[1:] != lines.text[:-1])) if len(lines.text) else []
            cuts = [*rows, len(lines.text)]
            for s, e in zip(cuts, cuts[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([of[s]]), pa.array([int(label[s])], pa.int32()), pa.array([np.column_stack([lines.words[s:e], lines.features[s:e]]).astype("<f4").tobytes()])], names=["id", "quality", "features"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text")).where("text is not null")
    found = in_arrow(rows.join(F.broadcast(chosen), "id"), "id long, quality int, features binary", run)
    got = sorted(map(tuple, found.collect()))
    if len({q for _, q, _ in got}) < 2:
        return None
    each = [np.frombuffer(f, "<f4").reshape(-1, 1 + len(FEATURES)).astype(float) for _, _, f in got]
    rows = np.concatenate(each)
    lines = Lines(np.repeat(np.arange(len(got)), [len(f) for f in each]), rows[:, 0], rows[:, 1:])
    return LineField.learn(lines, np.array([q for _, q, _ in got]))


def judge(docs: DataFrame, field: LineField | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content, kept) of each text.

    content is the share of words in lines that the field labels as content; kept if it is at least the
    field's `least` and no base rule failed. Without a field the base rules alone decide. Null and empty
    texts have no words and fail. Long texts are judged whole, a few at a time. Repeated rows each give a row; only id and text are read, unless all
    columns are to be carried along, in a struct `row`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch):
        field = shared.value
        for part in pieces(with_row(batch, id_col, text_col) if carry else batch, "text", 2 << 20):
            texts = [t or b"" for t in part.column("text").to_pylist()]
            ids, n_words = number_words(texts)
            lines, n_dup = split_lines(texts, ids)
            n_repeat = repeated_words(ids, n_words)
            dropped = [t.translate(None, _SPACES) for t in texts]
            chars = np.array([len(t) - len(t.translate(None, bytes(range(128, 192)))) for t in dropped])
            chars = np.array([len(t) for t in dropped]) - chars  # without the bytes that go on with a character
            symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts])
            failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
            content = field.content(lines, len(texts)) if field else np.ones(len(texts))
            kept = ~failed & (content >= (field.least if field else 0))
            longs = [pa.array(np.asarray(x).astype(np.int64)) for x in (n_words, chars, symbols, n_dup, n_repeat)]
            extra = [part.column("row")] if carry else []
            names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content", "kept", "row"]
            yield pa.RecordBatch.from_arrays([part.column("id"), *longs, pa.array(failed), pa.array(content), pa.array(kept), *extra], names=names[: 9 + carry])

    rows = docs.select(F.struct(*docs.columns).alias("row")) if carry else docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    known = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content double, kept boolean"
    schema = T.StructType([docs.select(F.col(id_col).alias("id")).schema["id"], *T._parse_datatype_string(known).fields, *([rows.schema["row"]] if carry else [])])
    return in_arrow(rows, schema, run)


def keep_good(docs: DataFrame, field: LineField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that `judge` keeps, with their columns."""
    return judge(docs, field, id_col, text_col, carry=True).where("kept").select("row.*")
