"""Token counts, SimHash, decontamination, quality, packing: brute force, and odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, packing, quality, queries, simhash, tokens
from graphloom.llm.common import table
from graphloom.llm.components import components

SF = "/root/testdata/sf0.001"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
#: Clashing names, a null id, a null and an empty text, repeated rows.
ODD = "doc_id long, text string, id long, row string, key string, n_words long, offset long, hash long"
ODD_ROWS = [(1, None, 1, "r", "k", 1, 1, 1), (2, "", 2, "r", "k", 1, 1, 1), (None, "no id here", 3, "r", "k", 1, 1, 1), (4, "same same", 4, "r", "k", 1, 1, 1), (4, "same same", 4, "r", "k", 1, 1, 1), (5, " \t\n ", 5, "r", "k", 1, 1, 1), (6, "x" * 30_000, 6, "r", "k", 1, 1, 1)]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").persist()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# Token counts


def test_tokens_equal_the_library(spark, docs, odd, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in queries.op1_token_counts(spark, SF).collect()}
    for i, t in texts_of(docs).items():
        n = len(lib.encode(t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n, n > 4096)
    rows = tokens.count_tokens(odd, PIECES).collect()
    assert len(rows) == len(ODD_ROWS) and {(r["doc_id"], r["n_tokens"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 0), (2, 0)}
    assert tokens.count_tokens(empty, PIECES).count() == 0


def test_tokens_of_odd_strings():
    import sentencepiece

    lib, ours = sentencepiece.SentencePieceProcessor(model_file=PIECES), tokens.TokenCounter(PIECES, memory=50)
    r = random.Random(1)
    texts = ["".join(r.choice("aab  ▁\n\tz0é中😀<s>　́thei") for _ in range(r.randint(0, 60))) for _ in range(800)] + ["aaaa" * 300, " " * 50, "<s></s>", "x"]
    texts += ["".join(r.choice(letters) for _ in range(n)) for letters in ("ab", "etaoin", "abcdefghij", "thé中") for n in (200, 3000, 20_000)]
    texts += ["ab" * 5000, "aab" * 3000, "0" * 9999, "=" * 777, "thethe" * 1000]
    assert ours.counts(texts) == [len(x) for x in lib.encode(texts)]


# SimHash


def plain_fingerprint(t, words):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, docs):
    fps = {i: plain_fingerprint(t, 3) for i, t in texts_of(docs).items()}
    got = {r["doc_id"]: r for r in queries.op2_simhash_near_duplicates(spark, SF).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(fps, 3)


@pytest.mark.parametrize("tile_rows", [16, 1000])
def test_links_keep_components(spark, tile_rows):
    r = random.Random(2)
    fps = {}
    for i in range(0, 300, 6):
        base = r.getrandbits(64)
        for j in range(6):
            fps[i + j] = base
            for _ in range(r.randint(0, 2)):
                base ^= 1 << r.randrange(64)
    fps = {i: f for i, f in fps.items() if f not in [fps[k] for k in range(i)]}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    found = simhash.links(spark.createDataFrame(rows, "node long, fp long"), 3, tile_rows)
    roots = {x["node"]: x["root"] for x in components(found).collect()}
    assert {i: roots.get(i, i) for i in fps} == plain_components(fps, 3)


@pytest.mark.parametrize("shingles,rows_least", [(4_000_000, 1024), (400, 8)])
def test_wide_links_are_verified(spark, shingles, rows_least, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_SHINGLES", shingles)
    monkeypatch.setattr(simhash, "LEAST_ROWS", rows_least)
    r = random.Random(11)
    vocab = ["w%d" % i for i in range(4000)]
    base = [r.choice(vocab) for _ in range(150)]
    rows, near = [], set()
    for i in range(60):
        w = list(base) if i % 3 == 0 else [r.choice(vocab) for _ in range(150)]
        if i % 3 == 0:
            for _ in range(r.randint(0, 2)):
                w[r.randrange(150)] = r.choice(vocab)
            near.add(i)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in rows}
    fps = {i: plain_fingerprint(t, 5) for i, t in rows}
    got = {x["id"]: x["component"] for x in simhash.near_duplicates(docs, words=5, radius=0, wide=24, similarity=0.8).collect()}
    for i, _ in rows:
        for j in range(i):
            same = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (fps[i] ^ fps[j]).bit_count() <= 24
            assert not same or got[i] == got[j]
    assert {i for i, c in got.items() if c == 0} == near and all(got[i] == i for i in got if i not in near)


def edited(words, at):
    return " ".join("z%d" % k if k in at else w for k, w in enumerate(words))


def test_pipeline_links_distant_fingerprints(spark):
    import corpus_pipeline

    r = random.Random(5)
    rows, far = [], 0
    for i in range(0, 120, 2):
        w = ["w%d" % r.randrange(9000) for _ in range(100)]
        pair = edited(w, []), edited(w, r.sample(range(0, 100, 7), 2))
        far += (plain_fingerprint(pair[0], 5) ^ plain_fingerprint(pair[1], 5)).bit_count() > 6
        rows += [(i, pair[0]), (i + 1, pair[1])]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert far > 10 and {x["doc_id"] for x in kept.collect()} == set(range(0, 120, 2))


def test_failing_short_links_hide_no_longer_one():
    u = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    sets = [u[:500], np.sort(np.concatenate([u[:400], u[800:900]])), u[20:500]]  # only the first and last are similar
    links = [(np.array([0, 1, 0]), np.array([1, 2, 2]), np.array([4, 4, 5]))]
    assert simhash.similar_components(sets, iter(links), 0.8).tolist() == [0, 1, 0]


def test_equal_fingerprints_of_unlike_texts_stay(spark):
    import corpus_pipeline

    rows = [(1, "a a a a a"), (2, "a " * 20 + "b c d e f g"), (3, "A a a  a a a")]
    assert plain_fingerprint(rows[0][1], 5) == plain_fingerprint(rows[1][1], 5)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert {x["doc_id"] for x in kept.collect()} == {1, 2}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    star = [(0, i) for i in range(1, 300)]
    assert {r["root"] for r in components(spark.createDataFrame(star, "a long, b long")).collect()} == {0}


def test_simhash_of_odd_tables(spark, odd, empty):
    rows = {(r["id"], r["component"]) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (5, 1), (4, 4), (None, None), (6, 6)} == rows
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "6", "None"]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


# Decontamination


def plain_contamination(docs, items, width):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wins = {}
    for i, t in items:
        w = word.findall(lower(t))
        for s in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + width]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = word.findall(lower(t)), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if k := wins.get(tuple(w[s : s + n])):
                    found |= k
                    hit |= set(range(s, s + n))
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_bytes,item_words", [(700, 100), (1 << 20, 1), (700, 2)])
def test_contamination_equals_brute_force(spark, block_bytes, item_words):
    r = random.Random(3)
    some = lambda n, m: None if r.random() < 0.05 else " ".join(r.choice(["a", "b", "c", "D", "é-"]) for _ in range(r.randint(n, m)))
    rows, items = [(i, some(0, 40)) for i in range(150)], [(i, some(0, 7)) for i in range(30)]
    found = decontaminate.judged(decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=4, block_bytes=block_bytes, item_words=item_words))
    assert {x["id"]: (x["n_words"], x["n_hit"], x["items"], x["contaminated"]) for x in found.collect()} == plain_contamination(rows, items, 4)


def test_contamination_of_odd_tables(spark, odd, empty):
    many = [(i, t) for i, t in enumerate(["same", "here", "x" * 30_000, "id same"] * 20)]
    found = decontaminate.judged(decontaminate.contamination(odd, spark.createDataFrame(many, "item_id long, text string"), block_bytes=40_000, carry=True))
    assert Counter((r["id"], r["n_hit"], len(r["items"])) for r in found.collect()) == Counter({(1, 0, 0): 1, (2, 0, 0): 1, (None, 1, 20): 1, (4, 2, 20): 2, (5, 0, 0): 1, (6, 1, 20): 1})
    none = spark.createDataFrame([(1, None), (None, "same same")], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.judged(decontaminate.contamination(odd, none)).collect()} == {0}
    one = spark.createDataFrame([(7, "Same")], "item_id long, text string")
    assert Counter(r["n_hit"] for r in decontaminate.judged(decontaminate.contamination(odd, one)).collect()) == {0: 5, 2: 2}
    clean = decontaminate.without_contaminated(odd, one)
    assert clean.columns == odd.columns and clean.count() == 5
    assert decontaminate.contamination(empty, one).count() == 0


# Quality


def plain_measures(t):
    t = t or ""
    w, seen, n_dup = re.findall("[^\x20\x09-\x0d]+", t), set(), 0
    for line in t.split("\n"):
        n_dup += bool(re.search("[^\x20\x09-\x0d]", line)) and line in seen
        seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), n_dup, len(inside)


def measures(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]


def test_quality_measures(spark, docs, odd, empty):
    field = quality.train_field(docs, table(spark, SF, "labels"))
    got = {r["id"]: r for r in quality.judge(docs, field).collect()}
    for i, t in texts_of(docs).items():
        want = plain_measures(t)
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert measures(got[i]) == want and got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
    extra = [(k, t) for k, t in enumerate(["a b c d e f g h " * 9, "é ü\n\né ü\n \n \n" * 3, "|# <x> 中\x0b文" * 4, None, ""])]
    for r in quality.judge(spark.createDataFrame(extra, "doc_id long, text string"), field).collect():
        assert measures(r) == plain_measures(extra[r["id"]][1])
    assert quality.judge(odd, field).count() == len(ODD_ROWS) and quality.keep_good(odd, None).columns == odd.columns
    assert quality.judge(empty, field).count() == 0 and quality.train_field(empty, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    train = labels.where("doc_id % 2 = 0")
    field = quality.train_field(docs, train)
    found = quality.judge(docs, field).join(labels.where("doc_id % 2 = 1"), F.col("id") == F.col("doc_id")).where("not base_failed")
    right, n = found.agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count("*")).first()
    assert right >= 0.97 * n


def test_lines_of_mixed_texts_are_told_apart(spark):
    r = random.Random(12)
    good = lambda: " ".join(r.choice(["river", "stone", "walked", "under", "light", "they"]) for _ in range(14)) + "."
    loud = lambda: " ".join(r.choice(["BUY", "NOW", "CHEAP", "CLICK"]) + "!!" for _ in range(12))
    docs = [[good() for _ in range(6)] for _ in range(60)] + [[loud() for _ in range(5)] + [good()] for _ in range(40)]
    mixed = [[k for _ in range(4) for k in (0, 0, 1, 1, 1)] if i % 2 else [1] * 9 + [0] * 3 for i in range(30)]
    prepared = lambda ts: quality.split_lines(ts, quality.number_words(ts)[0])[0]
    field = quality.LineField.learn(prepared(["\n".join(t).encode() for t in docs]), np.array([1] * 60 + [0] * 40))
    lines = prepared(["\n".join(good() if k else loud() for k in ks).encode() for ks in mixed])
    want = np.concatenate([np.array(k) for k in mixed])
    assert (field.decode(lines) == want).mean() > 0.98  # no text of the sample was labelled line by line
    assert (np.abs(field.content(lines, len(mixed)) - np.bincount(lines.text, lines.words * want) / np.bincount(lines.text, lines.words)) < 0.05).all()
    sf = "/root/testdata/sf0.01"
    field = quality.train_field(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = table(spark, sf, "labels").where("quality = 0").join(table(spark, sf, "documents"), "doc_id").collect()
    lines = prepared([x["text"].encode() for x in rows])
    n, on = np.bincount(lines.text, minlength=len(rows)), np.bincount(lines.text, field.decode(lines), minlength=len(rows))
    assert ((on > 0) & (on < n)).sum() >= 0.3 * (n > 1).sum()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = quality.LineField(rng.normal(size=(2, 3)), rng.normal(size=(2, 2)))
    text = np.repeat(np.arange(4), [1, 5, 3, 7])
    lines = quality.Lines(text, np.ones(16), rng.normal(size=(16, 3)))
    got, score = field.decode(lines), lines.features @ field.weights.T
    for t in range(4):
        rows = np.flatnonzero(text == t)
        total = lambda p, rows=rows: sum(score[r, b] for r, b in zip(rows, p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))
        paths = [[(k >> j) & 1 for j in range(len(rows))] for k in range(2 ** len(rows))]
        assert np.isclose(total(got[rows].tolist()), max(map(total, paths)))


# Packing


def test_packing(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    rows = queries.op10_best_fit_packing(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in texts_of(docs).items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts))) and sum(p["length"] for p in parts) == len(ids)
        assert all(p["length"] == 2048 for p in parts[1:])
        for p in parts:
            own = ids[p["start"] : p["start"] + p["length"]]
            assert p["length"] == len(own) <= 2048 and p["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(bins) <= 1.01 * least + 1
    pieces = packing.pack(packing.token_pieces(odd, BYTES).drop("ids"))
    assert pieces.where("length = 1").count() == 2 and packing.pack(packing.token_pieces(empty, BYTES)).count() == 0


def test_special_strings_and_spaces():
    from tokenizers import Tokenizer

    lib, ours = Tokenizer.from_file(BYTES), packing.ByteIds(BYTES)
    r = random.Random(4)
    texts = ["".join(r.choice("aab  '\n\t\rs0é中😀.,\x1c\x85\xa0　thei't") for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["a <|endoftext|> b", "<|endoftext|>", ""]
    assert ours.ids(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_exchanges_empty_bins():
    bins = packing.Bins(np.array([6, 5, 5, 4]), 10)
    assert len(bins.bins) == 3
    bins.improve()
    assert len(bins.bins) == 2 and bins.exchanges == 1
    bins.bins, bins.fill = [[0], [1, 3], [2]], [6, 9, 5]  # a poor packing: 6 | 5 4 | 5
    bins.improve()
    assert len(bins.bins) == 2 and sorted(i for b in bins.bins for i in b) == [0, 1, 2, 3] and max(bins.fill) <= 10
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(1, 100, 200)
        bins = packing.Bins(sizes, 100)
        before, squares = len(bins.bins), sum(f * f for f in bins.fill)
        bins.improve()
        assert len(bins.bins) <= before and sum(f * f for f in bins.fill) >= squares
        assert sorted(i for b in bins.bins for i in b) == list(range(200)) and all(sum(sizes[i] for i in b) == f <= 100 for b, f in zip(bins.bins, bins.fill))


def test_exchanges_pack_documents(spark):
    sizes = np.array([r["length"] for r in packing.token_pieces(table(spark, "/root/testdata/sf0.01", "documents"), BYTES).select("length").collect()])
    sizes = sizes[sizes < 2048]
    bins, least = packing.Bins(sizes, 2048), -(-int(sizes.sum()) // 2048)
    assert len(bins.bins) > 1.2 * least
    bins.improve()
    assert bins.exchanges > len(sizes) / 4 and len(bins.bins) <= 1.003 * least + 1
    assert sorted(i for b in bins.bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) == f <= 2048 for b, f in zip(bins.bins, bins.fill))
    done = bins.exchanges
    bins._sweep()
    assert len(bins.bins) == least or bins.exchanges == done  # a fixed point


def test_equal_sizes_are_exchanged_and_passes_go_on(monkeypatch):
    bins = packing.Bins(np.array([9, 4, 4, 1]), 10)
    bins.bins, bins.fill = [[0], [1, 2, 3]], [9, 9]
    bins._sweep()
    assert sorted(bins.fill) == [8, 10] and sorted(map(sorted, bins.bins)) == [[0, 3], [1, 2]]
    many = packing.Bins(np.array([6] * 12), 10)
    many.sizes = [1] * 12
    monkeypatch.setattr(many, "_sweep", lambda: many.bins.pop() if len(many.bins) > 3 else None)
    many.improve()
    assert len(many.bins) == 3
