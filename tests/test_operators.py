"""Resolver, ledger, trust, graphs, contracts, sinks, streams and the command line."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.cli import main
from graphloom.functions.constants import ID_NAMESPACE
from graphloom.functions.identity import stable_uuid
from graphloom.operators import contracts, graph, ledger, resolve, trust
from graphloom.sources.documents import documents_of, parse_documents, tokens
from graphloom.sources.sinks import JsonBackend
from graphloom.streaming.stores import loss_windows, replay_stream

from .test_source import PLATE

Q = "query_id string, kind string, producer string, role string, signature map<string,string>, adjacent_to array<string>"
C = "identity string, kind string, producer string, role string, signature map<string,string>, adjacency array<string>"


def test_resolver(spark):
    base = ("face", "blank", "cap.end")
    asked = [("one", *base, {"normal": "+Z"}, []), ("near", *base, {"normal": "+Z"}, ["e1"]), ("none", *base, {"normal": "-Z"}, []), ("null", *base, {"area": None}, ["e2"]), ("all", *base, None, None)]
    have = [("b", *base, {"normal": "+Z"}, ["e1"]), ("a", *base, {"normal": "+Z", "more": "x"}, None), ("a", *base, {"normal": "+X"}, ["e2"]), ("z", "edge", "blank", "cap.end", {}, [])]
    found = resolve.resolve(spark.createDataFrame(asked, Q), spark.createDataFrame(have, C))
    rows = {r["query_id"]: (r["status"], r["n_candidates"], r["candidates"]) for r in found.collect()}
    assert rows == {"one": ("ambiguous", 2, ["a", "b"]), "near": ("unique", 1, ["b"]), "none": ("missing", 0, []), "null": ("unique", 1, ["a"]), "all": ("ambiguous", 3, ["a", "a", "b"])}
    assert resolve.entity_of(found, "near") == "b"
    for q in ("one", "none", "other"):
        with pytest.raises(LookupError):
            resolve.entity_of(found, q)
    empty = resolve.resolve(spark.createDataFrame(asked, Q), spark.createDataFrame([], C))
    assert {r["status"] for r in empty.collect()} == {"missing"}


def test_history():
    h = ledger.Ledger({"format": "test", "value": 1})
    t = h.begin()
    assert h.commit(t, "two", {"format": "test", "value": 2}).number == 1 and h.current.graph["value"] == 2 and len(h.current.graph["semantic_sha256"]) == 64
    assert "semantic_sha256" not in h.undo().graph and h.current.graph["value"] == 1
    assert h.redo().graph["value"] == 2
    with pytest.raises(ledger.LedgerError):
        h.redo()
    with pytest.raises(ledger.LedgerError):
        h.commit(t, "again")


def test_conflicts_and_validators():
    h = ledger.Ledger({"v": 0})
    one, two = h.begin(), h.begin()
    h.commit(one, "first")
    with pytest.raises(ledger.StaleBase):
        h.commit(two, "second")
    t = h.begin()

    def refuse(graph):
        raise ValueError("no")

    with pytest.raises(ValueError):
        h.commit(t, "x", checks=[refuse])
    assert h.current.number == 1 and t in h.store.drafts
    with pytest.raises(ledger.LedgerError):
        h.commit(t, "  ")
    h.rollback(t)
    with pytest.raises(ledger.LedgerError):
        h.commit(t, "late")


def test_same_number_other_revision():
    h = ledger.Ledger({"v": 0})
    h.commit(h.begin(), "one", {"v": 1})
    stale = h.begin()
    h.undo()
    h.commit(h.begin(), "other one", {"v": 2})
    with pytest.raises(ledger.StaleBase):
        h.commit(stale, "onto the abandoned")


EVENTS = [
    ("s", 1, None, "init", None, '{"v": 0}'), ("s", 2, "t1", "begin", None, None), ("s", 3, "t2", "begin", None, None), ("s", 4, "t1", "commit", "m", '{"v": 1}'),
    ("s", 5, "t2", "commit", "m", None), ("s", 6, None, "undo", None, None), ("s", 7, None, "undo", None, None), ("u", 1, "t", "begin", None, None),
]
E = "store_id string, seq long, txn_id string, action string, message string, graph_json string"
WANT = {("s", 1): "ok", ("s", 2): "ok", ("s", 3): "ok", ("s", 4): "ok", ("s", 5): "conflict", ("s", 6): "ok", ("s", 7): "error", ("u", 1): "error"}


def test_replay(spark):
    rows = ledger.replay(spark.createDataFrame(EVENTS[::-1], E)).collect()
    assert {(r["store_id"], r["seq"]): r["outcome"] for r in rows} == WANT
    h = ledger.Ledger({"v": 0})
    h.commit(h.begin(), "m")
    revisions = ledger.revisions_frame(spark, {"s": h})
    now = ledger.current_revisions(revisions, spark.createDataFrame([("s", 0)], "store_id string, cursor int")).collect()
    assert [(r["number"], r["message"]) for r in now] == [(0, "initial")]


def test_streams(spark, tmp_path):
    for k, part in enumerate((EVENTS[:3], EVENTS[3:])):
        spark.createDataFrame(part, E).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = replay_stream(spark.readStream.schema(E).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["store_id"], r["seq"]): r["outcome"] for r in rows} == WANT
    losses = spark.createDataFrame([("2024-01-01 00:10:00", "geometry", "error"), ("2024-01-01 00:50:00", "geometry", "info")], "ts string, category string, severity string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r["n"], r["n_blocking"]) for r in loss_windows(losses).collect()] == [(2, 1)]


def test_trust(spark):
    e = spark.createDataFrame([("a", "drawing", "a" * 64), ("b", "rumour", "A" * 64), ("c", "text", None)], "identity string, kind string, source_sha256 string")
    assert {r["identity"]: r["violations"] for r in trust.check_evidence(e).collect()} == {"a": [], "b": ["digest", "kind"], "c": ["digest"]}
    rows = [("ok", "accepted", ["a"], "0.99", "me"), ("bare", "accepted", [], "1", "me"), ("who", "accepted", ["a"], None, ""), ("low", "candidate", None, "-0.01", None), ("high", "rejected", [], "1.01", None), ("odd", "maybe", ["z"], "0", None)]
    d = spark.createDataFrame(rows, "identity string, status string, evidence_ids array<string>, confidence string, decided_by string").withColumn("confidence", F.col("confidence").cast("decimal(38,18)"))
    assert {r["identity"]: r["violations"] for r in trust.check_decisions(d).collect()} == {"ok": [], "bare": ["evidence"], "who": ["actor"], "low": ["confidence"], "high": ["confidence"], "odd": ["status"]}
    assert [(r[0], r[1]) for r in trust.dangling_evidence(d, e).collect()] == [("odd", "z")]


def test_losses(spark):
    regs = spark.createDataFrame([("r1", "export", "a", "b", True), ("r2", "export", "a", "b", True), ("r3", "export", "a", "b", False)], "register_id string, operation string, source_backend string, target_backend string, blocks_commit boolean")
    fields = "register_id string, ord int, code string, category string, severity string, subject string, message string, source_capability string, target_capability string, mitigation string, reversible boolean"
    recs = spark.createDataFrame([("r1", 0, "LOSS.X", "parametric_history", "error", "s", "m", None, None, None, False), ("r3", 0, "x", "geometry", "warning", "s", "m", None, None, None, True)], fields)
    rolled = {r["register_id"]: (r["n_records"], r["blocks_commit"], r["consistent"]) for r in trust.roll_up(regs, recs).collect()}
    assert rolled == {"r1": (1, True, True), "r2": (0, False, False), "r3": (1, False, True)}
    assert {r["register_id"]: r["violations"] for r in trust.check_losses(recs).collect()} == {"r1": [], "r3": ["code"]}
    text = {r["register_id"]: json.loads(r["json"]) for r in trust.register_json(regs, recs).collect()}
    assert text["r1"]["schema"] == "graphloom.loss-register/0.1" and text["r2"]["records"] == [] and text["r1"]["records"][0]["mitigation"] is None and text["r1"]["blocks_commit"]


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {(r[0], r[1]) for r in graph.closure(e).collect()} == {("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}
    assert {r["node"]: r["level"] for r in graph.levels(e).collect()} == {"c": 0, "b": 1, "d": 1, "a": 2}
    chain = spark.createDataFrame([(k, k + 1) for k in range(6)], "src int, dst int")
    assert sorted(r["level"] for r in graph.levels(chain, most_levels=7).collect()) == list(range(7)) and graph.closure(chain).count() == 21
    with pytest.raises(ValueError):
        graph.levels(chain, most_levels=6)
    assert graph.levels(spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")).count() == 0
    assert {r[0] for r in graph.affected(e, spark.createDataFrame([("b",)], "node string")).collect()} == {"a", "b"}


def test_uuid(spark):
    paths = ["local/m", "org.a/é/x@3:4", ""]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", stable_uuid(F.col("p")).alias("id")).collect()
    assert {r["p"]: r["id"] for r in rows} == {p: str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), p)) for p in paths}


def test_contracts(spark):
    parsed = parse_documents(documents_of(spark, {"p": PLATE}))
    assert contracts.check_graphs(parsed).first()["violations"] == []
    bad = spark.createDataFrame([('{"format": "x", "extra": 1}',)], "canonical_json string")
    assert contracts.check_graphs(bad).first()["violations"] == ["missing", "unknown", "version", "digest", "models", "contract", "shape"]
    regs = [('{"schema":"s","operation":"o","source_backend":"a","target_backend":"b","blocks_commit":false,"records":[{"code":"ABC","severity":"fatal"}]}',)]
    assert contracts.check_registers(spark.createDataFrame(regs, "json string")).first()["violations"] == ["shape", "records", "blocks"]
    full = {k: 1 for k in contracts.MANIFEST_FIELDS} | {"operations": [{"support": "fallback"}]}
    assert contracts.check_manifests(spark.createDataFrame([(json.dumps(full),)], "json string")).first()["violations"] == ["loss code"]


def test_tokens_table(spark):
    rows = tokens(documents_of(spark, {"a": "x = 1;", "b": '"open'})).collect()
    assert [(r["doc_id"], r["ord"], r["text"]) for r in rows] == [("a", 0, "x"), ("a", 1, "="), ("a", 2, "1"), ("a", 3, ";"), ("a", 4, "")]


def test_backend_and_command_line(spark, tmp_path, capsys):
    source = tmp_path / "plate.src"
    source.write_text(PLATE, encoding="utf-8")
    assert main(["validate", str(source)], spark) == 0 and "valid" in capsys.readouterr().out
    assert main(["compile", str(source), "-o", str(tmp_path / "o" / "g.json")], spark) == 0
    graph_json = (tmp_path / "o" / "g.json").read_text(encoding="utf-8")
    backend = JsonBackend(str(tmp_path / "graphs"))
    result = backend.run(parse_documents(documents_of(spark, {"p": PLATE})))
    written = spark.read.parquet(str(tmp_path / "graphs")).first()["value"]
    assert result.validation_properties["semantic_sha256"] == json.loads(graph_json)["semantic_sha256"] == json.loads(written)["semantic_sha256"]
    assert backend.describe().operations == ["serialization"] and result.losses == []
    both = backend.run(parse_documents(documents_of(spark, {"p": PLATE, "q": "lang 0.1; model q { }", "bad": "("})))
    again = JsonBackend(str(tmp_path / "more")).run(parse_documents(documents_of(spark, {"q": "lang 0.1; model q { }", "p": PLATE}).repartition(2)))
    assert both.validation_properties == again.validation_properties != result.validation_properties
    source.write_text("lang 0.1; model m { tolerance t = 1; }", encoding="utf-8")
    assert main(["validate", str(source), "--json"], spark) == 1
    assert main(["compile", str(source), "-o", str(tmp_path / "no.json")], spark) == 1 and not (tmp_path / "no.json").exists()
