"""Command line: validate SOURCE [--json]; compile SOURCE -o OUT. Exit 0 if valid, 1 if not."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .api import Checked, validate_files
from .sources.sinks import diagnostic_json, diagnostic_lines


def _report(source: str, checked: Checked, ok: bool, as_json: bool) -> None:
    found: DataFrame = checked.diagnostics
    if as_json:
        rows = [json.loads(r["json"]) for r in diagnostic_json(found).collect()]
        print(json.dumps({"file": source, "valid": ok, "diagnostics": rows}, ensure_ascii=False, indent=2))
        return
    rows = diagnostic_lines(found, F.lit(source)).collect()
    if not rows:
        print(f"{source}: valid")
    for r in rows:
        head, _, hint = r["line_text"].partition("\n")
        print(head, file=sys.stderr if r["severity"] == "error" else sys.stdout)
        if hint:
            print(hint)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description="Checks source documents and writes their canonical graphs.")
    parser.add_argument("--version", action="version", version=f"graphloom {__version__}")
    commands = parser.add_subparsers(dest="command", required=True)
    validate = commands.add_parser("validate")
    validate.add_argument("source")
    validate.add_argument("--json", action="store_true")
    build = commands.add_parser("compile")
    build.add_argument("source")
    build.add_argument("-o", "--output", required=True)
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    checked = validate_files(spark, given.source)
    try:
        return _run(given, checked)
    finally:
        checked.parsed.unpersist()


def _run(given: argparse.Namespace, checked: Checked) -> int:
    ok = checked.validity.where("not ok").isEmpty()
    _report(given.source, checked, ok, given.command == "validate" and given.json)
    if not ok:
        return 1
    if given.command == "compile":
        row = checked.parsed.select("canonical_json", "semantic_sha256").first()
        out = Path(given.output)
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(row["canonical_json"], encoding="utf-8")
        print(f"wrote {out} ({row['semantic_sha256']})")
    return 0
