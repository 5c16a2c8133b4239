"""Substrings, chats, WARC packages, URLs, personal data and the pipeline."""

import base64
import gzip
import hashlib
import io
import random
import re
import struct
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, pii, queries, substrings, urls, warc
from graphloom.llm.common import table

from .test_text_operators import ODD, ODD_ROWS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


# Substrings


def plain_dedup(docs, n):
    out, seen = {}, set()
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_dedup_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op3_suffix_array_dedup(spark, SF).collect()}
    assert got == plain_dedup(docs, 100)


@pytest.mark.parametrize("shard_bytes,hot_least,per_shard,slices", [(2_000, 10_000, 4_000, 1 << 20), (1 << 20, 10_000, 3, 150), (2_000, 1, 5, 1 << 20), (2_000, 1, 50, 90)])
def test_dedup_of_repetitive_texts(spark, shard_bytes, hot_least, per_shard, slices, monkeypatch):
    r = random.Random(6)
    parts = ["".join(r.choice("ab ") for _ in range(r.randint(90, 300))) for _ in range(5)]
    docs = [(i, None if i == 3 else "".join(r.choice("abcdé") for _ in range(r.randint(0, 80))) + r.choice(parts) + "x" * r.choice([0, 0, 150, 400]) + r.choice(parts)[: r.randint(0, 200)]) for i in range(80)]
    sampled = substrings._hot_grams
    monkeypatch.setattr(substrings, "_hot_grams", lambda *a, **k: sampled(*a, **k, one_in=2))
    found = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shard_bytes=shard_bytes, hot_least=hot_least, per_shard=per_shard, slice_bytes=slices)
    got = {x["id"]: (len(x["text"]), len(x["text"]) - len(x["kept"]), len(x["spans"] or []), hashlib.sha256(x["kept"]).hexdigest()) for x in found.collect()}
    assert got == plain_dedup(docs, 100)


def test_dedup_of_odd_tables(spark, odd, empty):
    rows = [(x["id"], len(x["kept"])) for x in substrings.dedup(odd).collect()]
    assert sorted(rows, key=str) == sorted([(1, 0), (2, 0), (None, 10), (4, 9), (4, 9), (5, 4), (6, 1)], key=str)
    long = spark.createDataFrame([(1, "q" * 150), (1, "q" * 150), (None, "q" * 120)], "doc_id long, text string")
    assert sorted(len(x["kept"]) for x in substrings.dedup(long).collect()) == [0, 0, 1]
    assert substrings.dedup(empty).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(7)
    for _ in range(12):
        n = int(rng.integers(1, 900))
        text = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        if n > 400:
            text[200:350] = text[20:170]
        raw = text.tobytes()
        order, tied, word = substrings.suffix_array(text, 100)
        shared = substrings.common_prefixes(order, tied, word, 100)
        assert sorted(order.tolist()) == list(range(n))
        for k in range(1, n):
            a, b = raw[order[k - 1] :][:100], raw[order[k] :][:100]
            want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert a <= b and shared[k] == want


def test_shards_merge_as_one():
    rng = np.random.default_rng(8)
    word = lambda lo, hi: bytes(rng.integers(97, 99, int(rng.integers(lo, hi))).astype(np.uint8))
    for _ in range(40):
        base = [word(20, 60) for _ in range(3)]
        raws = [word(0, 10) + base[int(rng.integers(3))] + word(0, 10) for _ in range(12)]
        doc = rng.permutation(12)
        shards = [substrings.Contexts(raws[i : i + 4], doc[i : i + 4], np.zeros(4, np.int64), 20) for i in (0, 4, 8)]
        known, got = substrings.FirstPlaces(), set()
        for s in shards:
            c, w, (lead, first) = s.repeated()
            got |= set(zip(s.doc[c].tolist(), w.tolist()))
            keys = np.array([s.raws[i][j : j + 20] + b"\1" for i, j in zip(lead, first)])
            got |= {(d, j) for d, _, j in known.merge(keys, np.stack([s.doc[lead], s.doc[lead] * 0, first], 1)).tolist()}
        seen, want = set(), set()
        for d, j, w in sorted((int(doc[i]), j, raws[i][j : j + 20]) for i in range(12) for j in range(len(raws[i]) - 19)):
            if w in seen:
                want.add((d, j))
            seen.add(w)
        assert got == want


# Chats


def test_chats(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = con.execute(queries.oracle_sql()["op5_chat_formatting"])
    columns = [c[0] for c in want.description]
    got = queries.op5_chat_formatting(spark, SF)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_chat_masks_and_escapes(spark):
    texts = ["\\### Assistant: </turn> ok", "<turn>### user\nx</turn>\n", "a\\", "", "\\b\\l#<\n", "plain"]
    rows = [(1, k, ["user", "assistant", "sys\n#"][k % 3], t) for k, t in enumerate(texts)] + [(2, 0, "user", "alone"), (3, None, None, None), (4, 0, "assistant", "x"), (4, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("shown", F.lit(1))
    made = chat.format_chats(turns)
    read = made.select("conv_id", "example", "whole", "loss_start", "loss_end", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")).collect()
    one = sorted((r for r in read if r["conv_id"] == 1), key=lambda r: r["example"])
    assert [r["loss"] for r in one] == [texts[1], texts[4], ""] and [len(r["t"]) for r in one] == [2, 5, 6]
    assert [tuple(x) for x in one[-1]["t"]] == [(r, t or "") for _, _, r, t in rows[:6]]
    assert [(r["loss"], r["whole"]) for r in read if r["conv_id"] == 4] == [("x", False), ("x", True)]
    sums = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(made).collect()}
    assert sums == {1: (6, len(texts[1]) + len(texts[4])), 2: (1, 0), 3: (1, 0), 4: (2, 2)}
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


# WARC


def test_warc(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = con.execute(queries.oracle_sql()["op6_warc_packages"])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.op6_warc_packages(spark, SF).select(*columns).collect())) == sorted(want.fetchall())


def test_warc_round_trip(spark):
    big, small = "é" * 700, "small"
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", big), (4, "u", small), (5, "u", small), (None, "u", None), (7, "u", ""), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = warc.read_archives(warc.write_archives(pages, archive_bytes=300)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert [(by[i]["record_type"], by[i]["refers_to"]) for i in (1, 2, 3, 4, 5)] == [("revisit", 3), ("revisit", 3), ("response", None), ("response", None), ("response", None)]
    assert by[3]["payload"].decode() == big and by[1]["payload"] is None and by[1]["payload_bytes"] == 1400 and by[1]["url"] == "http://a/X: y"
    assert by[None]["payload"] == b"" and by[7]["payload_digest"] == hashlib.sha1(b"").hexdigest()
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def foreign(kind, block, http=False, **fields):
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{kind}>"), ("Content-Type", "application/http; msgtype=response" if http else "text/plain"), *fields.items(), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_packages_of_others(spark, tmp_path):
    body = b"<p>hello</p>" * 99
    b32 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    plain = [
        foreign("warcinfo", b"software: x\r\n"), foreign("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body, True, WARC_Target_URI="http://a/", WARC_Payload_Digest=f"sha1:{b32}"),
        foreign("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 1188\r\n\r\n", True, WARC_Target_URI="http://b/", WARC_Payload_Digest=f"sha1:{b32}", WARC_Refers_To="<urn:response>"),
    ]
    packed = [gzip.compress(foreign("resource", b"data", WARC_Target_URI="http://c/")), gzip.compress(foreign("metadata", b"m" * 200_000))]
    lines = [f'com,a)/{k} 20200101000000 {{"url": "u", "offset": "{sum(map(len, packed[:k]))}", "length": "{len(packed[k])}", "filename": "two.warc.gz"}}' for k in (1, 0)]
    for name, indexed in (("x.wacz", True), ("y.wacz", False)):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_STORED) as z:
            z.writestr("archive/one.warc", b"".join(plain))
            z.writestr("archive/two.warc.gz", b"".join(packed))
            if indexed:
                z.writestr("indexes/index.cdxj", "!meta {}\n" + "\n".join(lines) + "\n")
            z.writestr("datapackage.json", "{}", compress_type=zipfile.ZIP_DEFLATED)
        rows = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string"), slice_bytes=300).collect()
        by = {r["record_type"]: r for r in rows}
        assert sorted(by) == ["metadata", "resource", "response", "revisit", "warcinfo"] and len(rows) == 5
        assert bytes(by["response"]["payload"]) == body and by["response"]["payload_digest"] == hashlib.sha1(body).hexdigest() and by["response"]["page_id"] is None
        assert (by["revisit"]["payload"], by["revisit"]["payload_bytes"], by["revisit"]["refers_to_record"]) == (None, 1188, "<urn:response>")
        assert bytes(by["resource"]["payload"]) == b"data" and by["resource"]["url"] == "http://c/" and by["metadata"]["payload_bytes"] == 200_000
    with pytest.raises(ValueError):
        warc.read_record(foreign("resource", b"data", WARC_Payload_Digest=f"sha1:{b32}"))


def test_index_keys():
    assert warc.url_key("https://www.Example.org:80/A b?x=1") == "org,example,www)/a%20b?x=1" and " " not in warc.url_key("http://[x y") and warc.url_key("") == ")"


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_packages_of_zip64():
    out = Bytes()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("archive/data.warc.gz", "w", force_zip64=True) as f:
            f.write(b"payload")
        z.writestr("é.txt", b"text")
        z.writestr("packed", b"x" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05 not the end"
    p = warc.Package(out)
    assert [m.name for m in p.members] == ["archive/data.warc.gz", "é.txt", "packed"]
    assert p.read(p.data_at(p.members[0]), p.members[0].size) == b"payload"
    with pytest.raises(ValueError):
        p.data_at(p.members[2])
    # The same directory with its sizes and its end in ZIP64 fields.
    data = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 0) + b"a" + b"hello"
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    head = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(head), len(data))
    tail = b"PK\x06\x07" + struct.pack("<IQI", 0, len(data) + len(head), 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    p = warc.Package(Bytes(data + head + wide + tail))
    assert p.read(p.data_at(p.members[0]), p.members[0].size) == b"hello"
    with pytest.raises(ValueError):
        warc.Package(Bytes(b"no package"))


# URLs


def plain_url(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = None
    for said, rule in queries.RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[1])):
            best = (said, rule)
    return host, path, best


def test_urls(spark):
    extra = [None, "", "no scheme", "http://EXAMPLE.org/es/x", "http://a.example.org/en/12?x", "x://com/fr/", "x://fakecom/fr/", "http://org", "ftp://h#f", "a://b://c/d"]
    real = [r["url"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(extra + real)], "page_id long, url string, host string")
    model = urls.UrlModel.train(*urls.labelled(pages, queries.RULES))
    for r in urls.judge(pages, queries.RULES, model).collect():
        host, path, best = plain_url((extra + real)[r["id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")
    nothing = urls.UrlModel.train(*urls.labelled(pages.limit(0), queries.RULES))
    assert nothing.trees is None and urls.judge(pages.limit(0), queries.RULES, nothing).count() == 0


def test_url_trees_on_held_out_urls(spark):
    names, hosts, paths, y = urls.labelled(table(spark, "/root/testdata/sf0.1", "pages"), queries.RULES)
    part = np.arange(len(y)) % 4 > 0
    take = lambda x, m: [v for v, k in zip(x, m, strict=True) if k]
    model = urls.UrlModel.train(take(names, part), take(hosts, part), take(paths, part), y[part])
    said = model.allows(take(names, ~part), take(hosts, ~part), take(paths, ~part))
    assert (said == (y[~part] == 1)).mean() >= max(0.9, y[~part].mean() + 0.02)


def test_urls_of_unseen_suffixes(spark):
    r = random.Random(13)
    names, hosts, paths, y = [], [], [], []
    for _ in range(3000):
        host = f"{r.choice(['www', 'shop', 'm'])}.{r.choice('abcdefgh')}{r.randrange(40)}.{r.choice(['aa', 'bb', 'cc', 'dd', 'ee', 'ff'])}"
        bad = r.random() < 0.4
        path = f"/{r.choice(['promo', 'x']) if bad else r.choice(['docs', 'news', 'x'])}/" + ("-".join(str(r.randrange(10**6)) for _ in range(3)) if bad else r.choice(["about", "story", "page"]))
        names.append(f"https://{host}{path}"), hosts.append(host), paths.append(path), y.append(0.0 if bad else 1.0)
    held = np.array([h.endswith(("ee", "ff")) for h in hosts])
    take = lambda x, m: [v for v, k in zip(x, m.tolist(), strict=True) if k]
    model = urls.UrlModel.train(take(names, ~held), take(hosts, ~held), take(paths, ~held), np.array(y)[~held])
    said = model.allows(take(names, held), take(hosts, held), take(paths, held))
    assert (said == (np.array(y)[held] == 1)).mean() > 0.97


def test_both_verdicts_where_no_rule_fits(spark):
    found = queries.op8_url_filters(spark, "/root/testdata/sf0.1").where("rule is null").groupBy("verdict").count()
    got = {r["verdict"]: r["count"] for r in found.collect()}
    assert min(got["allow"], got["block"]) > 0.1 * sum(got.values())


def test_labelled_urls_are_a_bounded_sample(spark):
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    whole, some = urls.labelled(pages, queries.RULES, 10**6), urls.labelled(pages.unionByName(pages), queries.RULES, 100)
    assert len(some[0]) == 100 and some[0] == whole[0][:100] and some[3].tolist() == whole[3][:100].tolist()


# Personal data

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_personal(t):
    out = []
    for rank, (kind, p) in enumerate(PLAIN):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}
            if good[kind]():
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_personal_equals_brute_force(spark):
    r = random.Random(9)
    texts = [None, "", "a@b.c_x@y.z 4111111111111111 1.2.3.4.5.6.7.8 +1 (017) 555-5036.", "1" * 20_000, "7 " * 3_000, " ".join(f"u{i}@x.org" for i in range(300)), "a" * 20_000]
    texts += ["".join(r.choice("ab@.+1234567890 -()é😀\n%") for _ in range(r.randint(0, 80))) for _ in range(1500)]
    texts += [x["text"] for x in table(spark, SF, "documents").collect()]
    found = pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {x["id"]: x["b"] for x in found.select("id", pii.spelled(F.col("base")).alias("b")).collect()}
    assert [got[k] for k in range(len(texts))] == [plain_personal(t) for t in texts]


def test_learned_identifiers(spark):
    rows = [(i, f"hello contact a{i}@x.org thanks") for i in range(20)] + [(100, "reach contact bob77812at here"), (101, "no bob77812at elsewhere"), (102, "version 20251 only"), (103, None)]
    found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x["id"]: x["l"] for x in found.select("id", pii.spelled(F.col("learned")).alias("l")).collect() if x["l"]}
    assert got == {100: "id:14:24", 101: "id:3:13"}


def test_words_before_identifiers_are_whole(spark):
    long = "w" * 200
    rows = [(i, f"hello contact a{i}@x.org and {long}z b{i}@x.org") for i in range(20)]
    rows += [(100, "reach contact" + " \n" * 100 + "bob77812at here"), (101, f"a {long}z 99881x0"), (102, f"a {'v' * 100}{long[100:]}z 99882x0"), (103, "contact bob12345at 55566x1")]
    found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x["id"]: x["l"] for x in found.select("id", pii.spelled(F.col("learned")).alias("l")).collect() if x["l"]}
    assert got == {100: "id:213:223", 101: "id:204:211", 103: "id:8:18"}


def test_many_matches_in_a_text(spark):
    r = random.Random(14)
    word = lambda i: r.choice([f"u{i}@x.org", f"{10000 + i}", f"10.0.{i % 256}.7", "word", "é😀", f"+1 (017) 555-{1000 + i % 9000}"])
    texts = [" ".join(word(i) for i in range(n)) for n in (0, 1, 2, 3, 10, 1000, 20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_personal(docs).select("id", pii.spelled(F.col("base")).alias("b"), pii.spelled(F.array_sort(F.concat("base", "learned"))).alias("all"))
    got = {x["id"]: (x["b"], x["all"]) for x in found.collect()}
    assert [got[k][0] for k in range(len(texts))] == [plain_personal(t) for t in texts]
    for row in pii.mask(docs).collect():
        text, out, at = texts[row["doc_id"]], [], 0
        for kind, s, e in (x.split(":") for x in got[row["doc_id"]][1].split(",") if x):
            if int(s) >= at:
                out.append(text[at : int(s)] + f"[{kind.upper()}]")
            at = max(at, int(e))
        assert row["text"] == "".join(out) + text[at:]


def test_few_labelled_urls_train():
    hosts = ["good.org", "bad.biz"] * 6
    paths = ["/a/b", "/x/y/z/q"] * 6
    found = [f"https://{h}{p}" for h, p in zip(hosts, paths, strict=True)]
    model = urls.UrlModel.train(found, hosts, paths, np.array([1.0, 0.0] * 6))
    assert model.allows(found, hosts, paths).tolist() == [True, False] * 6


def test_long_chains_are_learned(spark):
    tokens = [(f"p{k}", f"i{j:02}", j < 9) for k in range(8) for j in range(k, k + 10)]
    known = pii.learn(spark.createDataFrame(tokens, "pattern string, instance string, seed boolean"))
    assert sorted(r["instance"] for r in known.collect()) == [f"i{j:02}" for j in range(17)]


def test_masks(spark, odd, empty):
    rows = [(1, "w a@b.co, 10.0.0.1 x", 1), (None, "+1 (017) 555-5036", 2), (3, None, 3), (4, "clean", 4), (4, "clean", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in pii.mask(docs).collect())
    assert got == [("1", "w [EMAIL], [IP] x"), ("3", "None"), ("4", "clean"), ("4", "clean"), ("None", "[PHONE]")]
    assert pii.mask(odd).columns == odd.columns and sorted(map(str, pii.mask(odd).collect())) == sorted(map(str, odd.collect()))
    assert pii.mask(empty).count() == 0


# Pipeline


def shingle_set(text, words):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def components_of(sets, similarity):
    """The smallest id reachable from each over pairs of sets of at least the similarity, all pairs compared."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            shared = len(sets[i] & sets[j])
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in sets}


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        steps[name] = (before, docs)
        if name != "best-fit packing":
            assert docs.columns == before.columns
    rejected = {r["doc_id"] for r in queries.op7_quality_rules(spark, SF).collect() if not r["kept"]}
    before, after = steps["quality rules"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").distinct().collect()}
    assert ids(before) - ids(after) == rejected
    before, after = steps["SimHash near-dedup"]
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in before.collect()}
    assert ids(after) == set(components_of(sets, 0.8).values()) and len(ids(after)) < len(sets)
    assert after.count() == len(ids(after))
    before, after = steps["benchmark decontamination"]
    dirty = {r["doc_id"] for r in queries.op4_benchmark_decontamination(spark, SF).collect() if r["contaminated"]}
    assert ids(before) - ids(after) == ids(before) & dirty
    before, after = steps["PII"]
    assert ids(before) == ids(after) and not any(plain_personal(r["text"]) for r in after.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = steps["best-fit packing"]
    assert ids(before) == ids(after)
    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, after.collect()))


def test_odd_tables_pass_all_stages(spark, tmp_path):
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long, id long, row long"
    good = " ".join(f"word{i} and some more" for i in range(30))
    for k, rows in enumerate(([], [(None, None, None, None, None, None, None), (1, good, "en", None, 5, 1, 1), (1, good, "en", None, 5, 1, 1), (2, "", "en", "s", 0, 2, 2)])):
        at = str(tmp_path / str(k))
        spark.createDataFrame(rows, columns).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, at).collect()} == ({1} if rows else set())
