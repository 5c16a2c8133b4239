"""Evaluation with units, and scenarios."""

from decimal import Decimal

import pytest

from graphloom.operators.scenarios import run_scenarios, values
from graphloom.sources.documents import documents_of

TEXT = """lang 0.1; model m {
  parameter w: length = 80 mm; parameter h: length = w / 2 + 1 cm; parameter area = w * h; constant bad = w + 3 deg; parameter loop = loop + 1;
  let ratio = w / h; constant f = 2 kg * 3 m / (1 s)^2; parameter ok: boolean = not (f < 5 N) and w ~= 8 cm; parameter none = select(a); parameter zero = w / 0; parameter text = "a";
  validate { assert h > 4 cm; assert manifold(m);
    scenario Wide { set w = 100 mm; expect h == 60 mm; expect w < h; }
    scenario Odd { set q = 1; expect w > h; } }
}"""


@pytest.fixture(scope="module")
def docs(spark):
    return documents_of(spark, {"d": TEXT, "broken": "lang"})


def test_values(docs):
    got = {r["name"]: (r["value"], r["dimension"], r["error"]) for r in values(docs).collect()}
    assert got["w"] == ("0.08", "length", None) and got["h"] == ("0.05", "length", None) and got["area"] == ("0.004", "length^2", None)
    assert got["ratio"] == ("1.6", "1", None) and got["f"] == ("6", "length*mass*time^-2", None) and got["ok"] == ("true", "boolean", None) and got["text"] == ("a", "string", None)
    assert got["bad"][2] == "length + angle" and got["loop"][2] == "loop needs itself" and got["none"][2] == "a call has no value" and "DivisionByZero" in got["zero"][2]
    assert Decimal(got["h"][0]) == Decimal("0.05")


def test_scenarios(docs):
    got = [(r["scenario"], r["kind"], r["verdict"]) for r in run_scenarios(docs).collect()]
    assert got == [(None, "assert", "pass"), (None, "assert", "skipped"), ("Wide", "expect", "pass"), ("Wide", "expect", "fail"), ("Odd", "expect", "skipped")]
