"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null url or one without "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does.

    rules are (verdict, "host/path"). A rule fits its host and all subdomains if the path begins with its
    path. Of equally long ones the first listed wins.
    """
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


@dataclass
class SuffixStats:
    """The share of allowed URLs by a key of the host and path, smoothed towards the whole share."""

    share: dict[str, float] = field(default_factory=dict)
    whole: float = 0.5

    @classmethod
    def of(cls, keys: list[str], labels: np.ndarray, weight: float = 5.0) -> SuffixStats:
        whole, sums = float(labels.mean()), {}
        for k, y in zip(keys, labels.tolist(), strict=True):
            n, s = sums.get(k, (0, 0.0))
            sums[k] = (n + 1, s + y)
        return cls({k: (s + weight * whole) / (n + weight) for k, (n, s) in sums.items()}, whole)

    def __call__(self, keys: list[str]) -> np.ndarray:
        return np.array([self.share.get(k, self.whole) for k in keys])


#: How many of the suffixes below name the host.
HOST_KEYS = 3


def suffixes(hosts: list[str], paths: list[str]) -> tuple[list[str], list[str], list[str], list[str]]:
    """Per URL: the host's last label; its last two; its last label and the path's first part; that part alone."""
    labels = [h.rsplit(".", 2)[-2:] for h in hosts]
    first = [p.split("/", 2)[1] if p.startswith("/") else "" for p in paths]
    return [x[-1] for x in labels], [".".join(x) for x in labels], [f"{x[-1]}/{f}" for x, f in zip(labels, first, strict=True)], first


def lexical(urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
    """Lengths, depth, labels, ratios of digits and hyphens, entropy, parameters, and marks of a URL."""
    out = np.zeros((len(urls), 10))
    digits, hyphens = re.compile("[0-9]").findall, re.compile("-").findall
    for i, (u, h, p) in enumerate(zip(urls, hosts, paths, strict=True)):
        n = max(1, len(u))
        counts = np.unique(np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1] / n
        query = u.partition("?")[2].partition("#")[0]
        out[i] = (len(u), len(h), p.count("/"), h.count("."), len(digits(u)) / n, len(hyphens(h)), -(counts * np.log2(counts)).sum(), query.count("&") + 1 if query else 0, "#" in u, u.startswith("https"))
    return out


@dataclass
class Trees:
    """Trees of a fixed depth, boosted on the logistic loss over binned features."""

    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # features, bins, values of leaves

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        total = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            total += leaf[node - (len(leaf) - 1)]
        return total

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, n_bins: int = 32, ridge: float = 1.0) -> Trees:
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(x.shape[1])]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model = cls(edges, float(np.log(p / (1 - p))), [])
        b, score = model.bins(x), np.full(len(y), model.start)
        n_nodes = 2**depth - 1
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            slope, curve = y - p, p * (1 - p)
            feature, cut = np.zeros(n_nodes, np.int64), np.full(n_nodes, n_bins)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                at = node - first
                best = np.full(width, 1e-9)
                for k in range(x.shape[1]):
                    key = at * (n_bins + 1) + b[:, k]
                    g = np.bincount(key, slope, minlength=width * (n_bins + 1)).reshape(width, -1).cumsum(1)
                    h = np.bincount(key, curve, minlength=width * (n_bins + 1)).reshape(width, -1).cumsum(1)
                    gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                    top = gain[:, :-1].argmax(1)
                    better = gain[np.arange(width), top] > best
                    best = np.where(better, gain[np.arange(width), top], best)
                    feature[first : first + width] = np.where(better, k, feature[first : first + width])
                    cut[first : first + width] = np.where(better, top, cut[first : first + width])
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - n_nodes
            value = rate * np.bincount(leaf, slope, minlength=n_nodes + 1) / (np.bincount(leaf, curve, minlength=n_nodes + 1) + ridge)
            model.trees.append((feature, cut, value))
            score += value[leaf]
        return model


@dataclass
class UrlModel:
    """Statistics of suffixes and trees over them and the lexical features; without trees all are allowed."""

    stats: tuple[SuffixStats, ...] = ()
    trees: Trees | None = None

    def features(self, urls: list[str], hosts: list[str], paths: list[str], unseen: bool = False) -> np.ndarray:
        """Features of URLs; with `unseen` as if no host like theirs had a label."""
        shares = [s(k) for s, k in zip(self.stats, suffixes(hosts, paths), strict=True)]
        if unseen:
            shares[:HOST_KEYS] = [np.full(len(urls), s.whole) for s in self.stats[:HOST_KEYS]]
        return np.concatenate([lexical(urls, hosts, paths), np.stack(shares, 1)], 1)

    def allows(self, urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
        if self.trees is None or not urls:
            return np.ones(len(urls), bool)
        return self.trees.score(self.features(urls, hosts, paths)) >= 0

    @classmethod
    def train(cls, urls: list[str], hosts: list[str], paths: list[str], labels: np.ndarray) -> UrlModel:
        """Statistics come from one half of the URLs, trees from the other, so that no label describes itself; both
        from all if the other half has one label only. If all have one label, there is nothing to learn: no trees.

        Trees see each URL twice, once as of an unseen host, so that they also learn what the rest of a URL tells:
        URLs that no rule decides are of such hosts."""
        if len(set(labels.tolist())) < 2:
            return cls()
        half = np.arange(len(urls)) % 2 == 0
        rest_of = ~half
        if len(set(labels[rest_of].tolist())) < 2:
            half = rest_of = np.ones(len(urls), bool)
        take = lambda x, m: [v for v, k in zip(x, m.tolist(), strict=True) if k]
        stats = tuple(SuffixStats.of(k, labels[half]) for k in suffixes(take(hosts, half), take(paths, half)))
        model, rest = cls(stats), [take(x, rest_of) for x in (urls, hosts, paths)]
        x = np.concatenate([model.features(*rest), model.features(*rest, unseen=True)])
        model.trees = Trees.fit(x, np.tile(labels[rest_of], 2))
        return model


def labelled(pages: DataFrame, rules: Sequence[tuple[str, str]], sample: int = 20_000) -> tuple[list[str], list[str], list[str], np.ndarray]:
    """URLs that a rule decides, with 1 for allow: at most `sample` different ones, those of least hashes.

    Only URLs below a bound of the hash, which leaves about twice the sample, are sorted and sent to the driver.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("url", host.alias("host"), path.alias("path"))
    rows = rows.select("url", "host", "path", rule_of(F.col("host"), F.col("path"), rules)[1].alias("verdict")).where("verdict is not null")
    rows = rows.withColumn("h", F.xxhash64("url"))
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    if n > 2 * sample:
        rows = rows.where(F.col("h") < int((2 * sample / n - 0.5) * 2**64))
    got = rows.distinct().orderBy("h", "url").limit(sample).collect()
    return [r["url"] for r in got], [r["host"] for r in got], [r["path"] for r in got], np.array([float(r["verdict"] == "allow") for r in got])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: UrlModel, id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) of each row: the rule's verdict, else the model's."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})

    def run(batch: pa.RecordBatch):
        said = batch.column("verdict").to_pylist()
        todo = [i for i, v in enumerate(said) if v is None]
        cols = [[c[i] for i in todo] for c in (batch.column(n).to_pylist() for n in ("url", "host", "path"))]
        for i, ok in zip(todo, shared.value.allows(*cols).tolist(), strict=True):
            said[i] = "allow" if ok else "block"
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "host", "path", "rule")), pa.array(said, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)[id_col]
    return in_arrow(rows, f"id {kind}, host string, path string, rule string, verdict string", run)
