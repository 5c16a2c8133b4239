"""Diagnostics: one positive and one negative case per rule."""

import pytest

from graphloom.api import validate_texts
from graphloom.operators.rules import edges
from graphloom.sources.canonical import find_cycles

from .test_source import PLATE

M = "lang 0.1; model m {{ {} }}".format
CASES = {
    "E000": ('lang 0.1; model m { a = "x\n; }', M("")),
    "E010": ("lang 0.1;", M("")),
    "E001": ("lang 0.2; model m { }", M("")),
    "E100": ('lang 0.1; model m [profile = "P0"] { }', 'lang 0.1; model m [profile = "P4"] { }'),
    "E101": (M("constant a = 1; datum a = 2;"), M("constant a = 1; let a = 2;")),
    "E102": (M("feature f: hole { x = missing.top; }"), M("feature f: hole { x = missing; y = world.xy; z = 3 * mm; part w { } v = w; }")),
    "E103": (M("parameter a: length = b; parameter b: length = a;"), M("parameter a: length = 1 mm; parameter b: length = a;")),
    "E110": (M("parameter a: length = 3 deg;"), M("parameter a: real = 3.0; parameter b: length = 3 parsec;")),
    "E120": (M("feature f: thread { }"), 'lang 0.1; model m [profile = "P3"] { feature f: std.thread { } }'),
    "E130": (M("reference r: face = 3;"), M('reference r: face = select(z, role = "a", area = 1, cardinality = one);')),
    "E131": (M('reference r: face = select(z, role = "a", area = 1);'), M('reference r: face = select(z, role = "a", area = 1, cardinality = "unique");')),
    "E132": (M('reference r: face = select(role = "a", area = 1, cardinality = one);'), M('reference r: face = select(z, role = "a", area = 1, cardinality = one);')),
    "E133": (M("reference r: face = select(z, area = 1, cardinality = one);"), M('reference r: face = select(z, role = "a", area = 1, cardinality = one);')),
    "E134": (M('reference r: face = select(z, role = "a", cardinality = one);'), M('reference r: face = select(z, role = "a", radius = 1, cardinality = one);')),
    "E140": (M("tolerance t = 1 mm;"), M("tolerance t: gdt_zone = 1 mm;")),
    "E150": (M("material a [status = inferred];"), M('material a [status = inferred, evidence = "d"]; material b [status = observed];')),
}


@pytest.fixture(scope="module")
def checked(spark):
    texts = {f"{code}+": bad for code, (bad, _) in CASES.items()} | {f"{code}-": good for code, (_, good) in CASES.items()}
    return validate_texts(spark, texts | {"plate": PLATE, "none": None})


def test_rules(checked):
    found = {}
    for r in checked.diagnostics.collect():
        found.setdefault(r["doc_id"], []).append(r["code"].split("-")[1])
    for code in CASES:
        assert code in found.get(f"{code}+", []), code
        assert code not in found.get(f"{code}-", []), code
    assert "plate" not in found and found["none"] == ["E010"]


def test_validity(checked):
    ok = {r["doc_id"]: r["ok"] for r in checked.validity.collect()}
    assert ok["plate"] and not ok["none"] and not any(ok[f"{c}+"] for c in CASES)


def test_cycle_message_and_order(spark):
    text = M("parameter a: length = b; parameter a: length = 1; parameter b: length = a + q.x; feature f: weld { x = q.y; }")
    rows = validate_texts(spark, {"d": text}).diagnostics.collect()
    assert [r["code"] for r in rows] == [f"LANG-{c}" for c in ("E101", "E102", "E102", "E120", "E103")]
    assert rows[-1]["message"].endswith("a -> b -> a")


def test_edges(spark):
    got = {(r["src"], r["dst"]) for r in edges(validate_texts(spark, {"d": PLATE}).parsed).collect()}
    assert got == {("height", "width"), ("outline", "base"), ("outline", "width"), ("outline", "height"), ("blank", "outline"), ("top", "blank")}


def test_find_cycles():
    assert find_cycles({"a": ["b"], "b": ["c", "a"], "c": ["a"]}) == [("b", ["a", "b", "a"]), ("c", ["a", "b", "c", "a"])]
    assert find_cycles({"a": ["a"]}) == [("a", ["a", "a"])] and find_cycles({"a": ["b"]}) == []
