"""Sinks: canonical graphs, diagnostics as text and JSON, and the backend that writes graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a backend says of itself, and what it returns, by name and type.
BACKEND_FIELDS = "name string, version string, profiles array<string>, operations array<string>, exact_brep boolean, pmi boolean, deterministic_mode boolean, license string"
RESULT_FIELDS = "success boolean, artifact_uri string, validation_properties map<string, string>, losses array<string>, diagnostics array<string>"


def _record(fields: str, **values) -> T.Row:
    """A row of these fields, each of which must be given and of its type."""
    schema = T._parse_datatype_string(fields)
    row = T.Row(*schema.names)(*(values.pop(c) for c in schema.names))
    if values:
        raise TypeError(f"unknown fields {sorted(values)}")
    T._make_type_verifier(schema)(row)
    return row


def write_graphs(parsed: DataFrame, path: str, files: int | None = None) -> None:
    """(doc_id, semantic_sha256, value): the canonical JSON of each document that has one, as Parquet; replaces what is
    there. Documents are a column, not folders, so that their number does not matter; `files` deals them out by doc_id."""
    graphs = parsed.where("canonical_json is not null").select("doc_id", "semantic_sha256", F.regexp_replace("canonical_json", "\n$", "").alias("value"))
    graphs = graphs.repartition(files, "doc_id").sortWithinPartitions("doc_id") if files else graphs
    graphs.write.mode("overwrite").parquet(path)


def diagnostic_lines(found: DataFrame, uri: Column) -> DataFrame:
    """found with `line_text`: uri:line:column: severity CODE: message; the hint, if any, below it."""
    place = F.when(F.col("span").isNotNull(), F.format_string(":%d:%d", "span.line", "span.column")).otherwise("")
    head = F.concat(uri, place, F.lit(": "), F.col("severity"), F.lit(" "), F.col("code"), F.lit(": "), F.col("message"))
    return found.withColumn("line_text", F.concat(head, F.when(F.col("hint").isNotNull(), F.concat(F.lit("\n  hint: "), "hint")).otherwise("")))


def diagnostic_json(found: DataFrame) -> DataFrame:
    """found with `json`: an object without the fields that are null."""
    return found.withColumn("json", F.to_json(F.struct("code", "severity", "message", F.col("span").alias("location"), "hint")))


def table_digest(graphs: DataFrame) -> str | None:
    """A digest of a table's semantic digests in any order: that of one document itself; else that of the sums of their
    32-bit words and their number, so that one row comes to the driver. None without documents."""
    word = lambda k: F.sum(F.conv(F.substring("semantic_sha256", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    row = graphs.agg(F.count("*").cast("string").alias("n"), F.min("semantic_sha256").alias("one"), F.sha2(F.concat_ws(",", F.count("*").cast("string"), *(word(k) for k in range(8))), 256).alias("all")).first()
    return None if row["n"] == "0" else row["one"] if row["n"] == "1" else row["all"]


class JsonBackend:
    """Writes canonical graphs; loses nothing. Other backends offer the same two: `describe` and `run`."""

    def __init__(self, path: str):
        self.path = path

    def describe(self) -> T.Row:
        """A row of BACKEND_FIELDS."""
        return _record(
            BACKEND_FIELDS, name="canonical-json", version="0.1", profiles=["P1", "P2", "P3", "P4"], operations=["serialization"],
            exact_brep=False, pmi=True, deterministic_mode=True, license="that of this repository",
        )

    def run(self, parsed: DataFrame) -> T.Row:
        """A row of RESULT_FIELDS. Documents are parsed once: the digest is read from what was written."""
        write_graphs(parsed, self.path)
        whole = table_digest(parsed.sparkSession.read.parquet(self.path))
        return _record(RESULT_FIELDS, success=whole is not None, artifact_uri=self.path, validation_properties={"semantic_sha256": whole} if whole else {}, losses=[], diagnostics=[])
