"""Source documents as DataFrames: reading, parsing, and the flat tables of what was parsed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.constants import DECLARATIONS, PROFILES
from ..functions.partitions import spread
from ..functions.typing import infer, plain_type
from . import canonical
from .grammar import deep_calls, expressions, read_source, references
from .scanner import SourceError, Span, scan

_SPAN = "struct<line: int, column: int, end_line: int, end_column: int>"
TOKENS = f"doc_id string, ord int, kind string, text string, value string, span {_SPAN}"
PARSED = f"""doc_id string, error struct<code: string, message: string, span: {_SPAN}>, language string, version string, namespace string, span {_SPAN},
    imports array<struct<ord: int, source: string, alias: string, span: {_SPAN}>>,
    models array<struct<model: int, name: string, id: string, profile: string, dependency_order: array<string>, span: {_SPAN}>>,
    nodes array<struct<model: int, node: int, parent: int, ord: int, depth: int, kind: string, name: string, type: string, path: string, id: string, span: {_SPAN},
        locals: array<string>, value: string, attributes: map<string, string>, status: string, has_evidence: boolean, value_span: {_SPAN}, expected: string, actual: string, certain: boolean,
        is_select: boolean, cardinality: string, n_arguments: int, keywords: array<string>, declares: boolean, first: boolean, profile: string>>,
    refs array<struct<model: int, node: int, ref: int, path: string, root: string, n_parts: int, span: {_SPAN}, owner: string, symbol: boolean, local: boolean>>,
    cycles array<struct<model: int, ord: int, at: string, cycle: array<string>, span: {_SPAN}>>,
    canonical_json string, semantic_sha256 string"""
_FIELDS = ("doc_id", "error", "language", "version", "namespace", "span", "imports", "models", "nodes", "refs", "cycles", "canonical_json", "semantic_sha256")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, uri, source_text): each file under path, whole, as UTF-8. Reading errors are raised."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("source_text"))
    return files.select(F.sha2("uri", 256).alias("doc_id"), "uri", "source_text")


def documents_of(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """The same table from texts by their ids."""
    return spark.createDataFrame([(k, None, v) for k, v in texts.items()], "doc_id string, uri string, source_text string")


def _span(span: Span | None) -> dict | None:
    return None if span is None else dict(zip(("line", "column", "end_line", "end_column"), span, strict=True))


def _node_rows(tree: dict, m: int, model: dict) -> Iterator[dict]:
    """A model's nodes from top to bottom; only nodes of its own body get what the rules ask for."""
    known = canonical.declared(model)
    symbols = {name: node["type"] for name, node in known.items()}
    profile = canonical.literal_text(dict(model["attributes"]).get("profile"))
    profile = profile if profile in PROFILES else next(iter(PROFILES))
    space = tree["namespace"] or "local"
    stack = [(node, None, k, 0, f"{space}/{model['name']}") for k, node in reversed(list(enumerate(model["body"])))]
    number = 0
    while stack:
        node, parent, k, depth, above = stack.pop()
        path, attributes, value = f"{above}/{canonical.step_of(node)}", dict(node["attributes"]), node["value"]
        row = {"model": m, "node": number, "parent": parent, "ord": k, "depth": depth, "kind": node["kind"], "name": node["name"], "type": node["type"], "path": path, "id": canonical.identity(node, path), "span": _span(node["span"])}
        row |= {"value": value and canonical.spell(canonical.lowered(value))[:-1], "attributes": [(key, canonical.spell(canonical.lowered(e))[:-1]) for key, e in attributes.items()]}
        if depth == 0:
            row |= {"locals": sorted({n["name"] for n in node["body"] if n["name"]}), "status": canonical.literal_text(attributes.get("status")), "has_evidence": "evidence" in attributes}
            declares = node["kind"] in DECLARATIONS and bool(node["name"])
            row |= {"declares": declares, "first": declares and known[node["name"]] is node, "profile": profile}
            if value is not None:
                actual, certain = infer(value, symbols)
                select = value["kind"] == "call" and value["operation"] == "select"
                keywords = dict(value["keywords"]) if select else {}
                row |= {"value_span": _span(value["span"]), "expected": plain_type(node["type"]), "actual": actual, "certain": certain, "is_select": select}
                row |= {"cardinality": canonical.literal_text(keywords.get("cardinality")), "n_arguments": len(value["arguments"]) if select else 0, "keywords": sorted(keywords)}
        yield row
        stack.extend((part, number, j, depth + 1, path) for j, part in reversed(list(enumerate(node["body"]))))
        number += 1


def parse_text(doc_id: str, text: str | None) -> dict:
    """One document's row: its parts, or the error that ended reading it (a null text is empty)."""
    try:
        with deep_calls():
            return _parsed(doc_id, text)
    except SourceError as e:
        return dict.fromkeys(_FIELDS) | {"doc_id": doc_id, "imports": [], "models": [], "nodes": [], "refs": [], "cycles": [], "error": {"code": e.code, "message": e.message, "span": _span(e.span)}}


def _parsed(doc_id: str, text: str | None) -> dict:
    row: dict = dict.fromkeys(_FIELDS)
    row |= {"doc_id": doc_id, "imports": [], "models": [], "nodes": [], "refs": [], "cycles": []}
    tree = read_source(text or "")
    graph = canonical.graph_of(tree)
    row |= {"language": tree["language"], "version": tree["version"], "namespace": tree["namespace"], "span": _span(tree["span"])}
    row["imports"] = [{"ord": k, "source": i["source"], "alias": i["alias"], "span": _span(i["span"])} for k, i in enumerate(tree["imports"])]
    for m, model in enumerate(tree["models"]):
        profile = canonical.literal_text(dict(model["attributes"]).get("profile"))
        row["models"].append({"model": m, "name": model["name"], "id": graph["models"][m]["id"], "profile": profile or "P1", "dependency_order": graph["models"][m]["dependency_order"], "span": _span(model["span"])})
        nodes = list(_node_rows(tree, m, model))
        row["nodes"] += nodes
        known, links = canonical.declared(model), {}
        tops = [n["node"] for n in nodes if n["depth"] == 0]
        for number, node in zip(tops, model["body"], strict=True):
            owner = node["name"] if known.get(node["name"]) is node else None
            local = {part["name"] for part in node["body"]}
            for k, r in enumerate(r for e in expressions(node) for r in references(e)):
                root = r["path"].split(".")[0]
                row["refs"].append({"model": m, "node": number, "ref": k, "path": r["path"], "root": root, "n_parts": r["path"].count(".") + 1, "span": _span(r["span"]), "owner": owner, "symbol": root in known, "local": root in local})
                if owner is not None and root in known:
                    links.setdefault(owner, set()).add(root)
        row["cycles"] += [{"model": m, "ord": k, "at": at, "cycle": path, "span": _span(known[at]["span"])} for k, (at, path) in enumerate(canonical.find_cycles(links))]
    return row | {"canonical_json": canonical.spell(graph, 2), "semantic_sha256": graph["semantic_sha256"]}


def _rows(docs: DataFrame, ddl: str, of) -> DataFrame:
    schema = T._parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("source_text").to_pylist(), strict=True) for r in of(i, t)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spread(docs.select("doc_id", "source_text")).mapInArrow(run, schema)


def parse_documents(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, source_text) with what was parsed in nested columns; no shuffle, but for inputs of few files.

    The parser is the one opaque step: one pass in Arrow batches. Persist the result before several
    tables are taken from it.
    """
    return _rows(docs, PARSED, lambda i, t: [parse_text(i, t)])


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, text, value, span): tokens of each document; none of a text that can't be scanned."""

    def of(doc_id: str, text: str | None) -> list[dict]:
        try:
            found = scan(text or "")
        except SourceError:
            return []
        return [{"doc_id": doc_id, "ord": k, "kind": t.kind, "text": t.text, "value": t.value, "span": _span(t.span)} for k, t in enumerate(found)]

    return _rows(docs, TOKENS, of)


def part(parsed: DataFrame, name: str) -> DataFrame:
    """The rows of one nested column: imports, models, nodes or refs, each with its doc_id."""
    return parsed.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")
