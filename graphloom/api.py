"""The library's front door: texts and files in, checked documents and canonical graphs out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators.rules import diagnostics, validity
from .sources import canonical
from .sources.canonical import digest as semantic_hash
from .sources.canonical import graph_of as compile_tree
from .sources.canonical import spell as canonical_json
from .sources.documents import documents_of, parse_documents, read_documents
from .sources.grammar import read_source as parse

__all__ = ["Checked", "canonical", "canonical_json", "check", "compile_tree", "parse", "semantic_hash", "validate_files", "validate_texts"]


@dataclass
class Checked:
    """Parsed documents, their diagnostics and whether each is valid, as DataFrames."""

    documents: DataFrame
    parsed: DataFrame
    diagnostics: DataFrame
    validity: DataFrame


def check(documents: DataFrame) -> Checked:
    """Checks (doc_id, uri, source_text); the parsed table is persisted, as every rule reads it."""
    parsed = parse_documents(documents).persist()
    found = diagnostics(parsed).orderBy("doc_id", "model", "phase", "symbol", "rule", "ref")
    return Checked(documents, parsed, found, validity(parsed))


def validate_files(spark: SparkSession, path: str) -> Checked:
    return check(read_documents(spark, path))


def validate_texts(spark: SparkSession, texts: dict[str, str]) -> Checked:
    return check(documents_of(spark, texts))
