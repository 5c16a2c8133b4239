"""The source language: tokens, trees, canonical graphs."""

import hashlib
import json
import uuid

import pytest

from graphloom.functions.constants import ID_NAMESPACE
from graphloom.sources import canonical
from graphloom.sources.grammar import read_source
from graphloom.sources.scanner import SourceError, scan

PLATE = """lang 0.1;
namespace org.sample;
import "lib/units" as u;
model Plate [profile = "P2", id = "plate-1"] {
  units { length = mm; }
  tolerance build: kernel_tolerance = 0.001 mm;
  parameter width: length = 80 mm [min = 40 mm, status = observed, evidence = "D1"];
  parameter height: length = width;
  datum base: plane = world.xy;
  sketch outline on base { profile outer = rectangle(width, height, centered = true); constraint level(outer.bottom); }
  feature blank: extrude { profile = outline.outer; distance = 6 mm; }
  reference top: face = select(blank.faces, role = "cap.end", normal = world.z, cardinality = unique);
  validate { assert manifold(blank); scenario Wide { set width = 100 mm; expect valid(blank); } }
}
"""


def expr(text):
    return read_source(f"lang 0.1; model m {{ let a = {text}; }}")["models"][0]["body"][0]["value"]


def shape(e):
    match e["kind"]:
        case "binary":
            return f"({shape(e['left'])}{e['operator']}{shape(e['right'])})"
        case "unary":
            return f"[{e['operator']}{shape(e['operand'])}]"
        case "reference":
            return e["path"]
    return str(e["value"])


def test_tokens_have_places():
    kinds = [(t.kind, t.value, t.span) for t in scan('a // x\n"b\\u00e9" /* y\n*/ 1.5e3 ->')]
    assert kinds == [("name", "a", (1, 1, 1, 2)), ("string", "bé", (2, 1, 2, 10)), ("number", "1.5e3", (3, 4, 3, 9)), ("mark", "->", (3, 10, 3, 12)), ("end", "", (3, 12, 3, 12))]


@pytest.mark.parametrize("text,values", [("1e", ["1", "e"]), (".5", [".5"]), ("1.", ["1."]), ("12e-3", ["12e-3"]), ("a<=b", ["a", "<=", "b"])])
def test_numbers_and_marks(text, values):
    assert [t.value for t in scan(text)[:-1]] == values


@pytest.mark.parametrize("text", ["/* open", '"a\n"', '"open', '"\\q"', "a ² b", "#", '"a\\\n"'])
def test_unreadable_tokens(text):
    with pytest.raises(SourceError) as e:
        scan(text)
    assert e.value.code == "E000"


@pytest.mark.parametrize(
    "text,want",
    [("1+2*3", "(1+(2*3))"), ("-2^2", "([-2]^2)"), ("2^3^2", "(2^(3^2))"), ("not a and b", "([nota]andb)"), ("- -x", "[-[-x]]"), ("(a+b)*c", "((a+b)*c)"), ("a==b<c", "((a==b)<c)"), ("1-2-3", "((1-2)-3)")],
)
def test_strengths(text, want):
    assert shape(expr(text)) == want


def test_calls_and_lists():
    e = expr("f(a, k = 1, b, k = 2)")
    assert [a["path"] for a in e["arguments"]] == ["a", "b"] and [k for k, _ in e["keywords"]] == ["k", "k"]
    assert len(expr("[1, [2], \"x\"]")["items"]) == 3 and expr("[]")["items"] == []
    assert expr('"not"')["value"] == "not"  # a string is never a keyword


@pytest.mark.parametrize("text", ["", "lang 0.1;", "lang 0.1; model m {", "lang 0.1; model m { a = 1 }", "lang 0.1; model m [a=1,] { }", "lang 0.1; model m { let a = f(1,); }", "lang 0.1; model m { occurrence left = instance(a); }", "lang 0.1; model m { let a = " + "(" * 1100 + "1" + ")" * 1100 + "; }"])
def test_broken_structure(text):
    with pytest.raises(SourceError) as e:
        read_source(text)
    assert e.value.code == "E010"


def test_generic_statements_and_assignments():
    body = read_source("lang 0.1; model m { weld part { profile = a.b; } weld a + b [x = 1]; }")["models"][0]["body"]
    assert [(n["kind"], n["name"]) for n in body] == [("weld", "part"), ("weld", None)]
    assert body[0]["body"][0]["kind"] == "assign"


def test_graph_is_canonical():
    graph = canonical.graph_of(read_source(PLATE))
    assert graph == canonical.graph_of(read_source(PLATE))
    bare = {k: v for k, v in graph.items() if k != "semantic_sha256"}
    want = json.dumps(bare, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert graph["semantic_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert graph["format"] == "lang.canonical-construction-graph" and graph["source_language"] == "lang/0.1"
    model = graph["models"][0]
    assert model["id"] == "plate-1" and "id" not in model["attributes"]
    assert model["dependency_order"] == ["base", "width", "height", "outline", "blank", "build", "top"]
    width = next(d for d in model["declarations"] if d.get("name") == "width")
    assert width["id"] == str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), "org.sample/Plate/width"))
    assert width["value"] == {"kind": "literal", "value": 80, "unit": "mm"} and "body" not in width
    tolerance = next(d for d in model["declarations"] if d["kind"] == "tolerance")
    assert tolerance["value"] == {"kind": "literal", "value": "0.001", "numeric_encoding": "decimal", "unit": "mm"}
    assert canonical.spell(graph, 2).endswith("}\n")


def test_numbers_keep_their_writing():
    assert expr("123456789012345678901234567890")["value"] == 123456789012345678901234567890
    assert canonical.lowered(expr("1e3"))["value"] == "1000" and canonical.lowered(expr("0.10"))["value"] == "0.10"


def test_deep_texts():
    from graphloom.sources.documents import parse_text

    read = lambda value: parse_text("d", "lang 0.1; model m { constant a = " + value + "; }")
    assert all(read(v)["error"] is None for v in ("(" * 990 + "1" + ")" * 990, "[" * 600 + "]" * 600, "-" * 900 + "1", "1+" * 3000 + "1"))
    assert all(read(v)["error"]["code"] == "E010" for v in ("(" * 1100 + "1" + ")" * 1100, "1+" * 60_000 + "1"))
