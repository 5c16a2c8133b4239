"""Gates beyond the reference: calibration, domains, verdicts, limits."""

import pytest

from graphloom.operators import quality
from graphloom.sources.documents import documents_of, parse_documents


def test_calibration(spark):
    rows = [(0.95, True)] * 9 + [(0.95, False)] + [(0.15, False)] * 4 + [(1.0, True)]
    r = quality.calibration_error(spark.createDataFrame(rows, "confidence double, correct boolean")).first()
    # bin 9: ten at 0.95 and one at 1.0, of which ten are right; bin 1: four at 0.15, none right
    want = (11 * abs(10.5 / 11 - 10 / 11) + 4 * 0.15) / 15
    assert r["n"] == 15 and r["ece"] == pytest.approx(want)


def test_domains(spark):
    text = "lang 0.1; model m { parameter a: length = 5 cm [max = 40 mm]; parameter b: length = 1 in [min = 25 mm, max = 26 mm]; parameter c: length = 5 mm [min = 3 kg]; parameter d: length = a [max = 1 mm]; parameter e: scalar = 1.5 [min = 2]; }"
    rows = {r["name"]: (r["value"], r["low"], r["high"]) for r in quality.out_of_domain(parse_documents(documents_of(spark, {"d": text}))).collect()}
    assert set(rows) == {"a", "e"} and float(rows["a"][0]) == 0.05 and float(rows["a"][2]) == 0.04


def test_verdicts(spark):
    rows = [("a", "pass", True), ("a", "skipped", False), ("b", "skipped", True), ("c", "warning", None), ("d", "not_applicable", True), ("e", "fail", False), ("e", "pass", True)]
    got = {r["report_id"]: r["verdict"] for r in quality.verdicts(spark.createDataFrame(rows, "report_id string, outcome string, mandatory boolean")).collect()}
    assert got == {"a": "pass", "b": "fail", "c": "warning", "d": "not_applicable", "e": "fail"}


def test_limits(spark):
    docs = documents_of(spark, {"long": "x" * 50, "short": "x"})
    assert [r["doc_id"] for r in quality.too_large(docs, 10).collect()] == ["long"]
