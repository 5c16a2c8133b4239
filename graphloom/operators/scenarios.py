"""Values of parameters, and scenarios: expectations under isolated changes (extensions)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..functions.evaluate import EVALUATED, EvaluationError, Evaluator, shown
from ..sources.documents import _rows
from ..sources.grammar import read_source
from ..sources.scanner import SourceError

_VALUES = "doc_id string, model int, name string, value string, dimension string, error string"
_VERDICTS = "doc_id string, model int, scenario string, ord int, kind string, verdict string, error string"


def _models(text: str | None) -> list[dict]:
    try:
        return read_source(text or "")["models"]
    except SourceError:
        return []


def values(docs: DataFrame) -> DataFrame:
    """(doc_id, model, name, value, dimension, error) of each parameter, constant and let with an expression.

    Values are exact decimals in base units. Documents that can't be read have none. No shuffle.
    """

    def of(doc_id: str, text: str | None) -> Iterator[dict]:
        for m, model in enumerate(_models(text)):
            evaluator = Evaluator(model)
            for name in evaluator.exprs:
                row = {"doc_id": doc_id, "model": m, "name": name}
                try:
                    value, dimension = shown(evaluator.name(name))
                    yield row | {"value": value, "dimension": dimension, "error": None}
                except EvaluationError as e:
                    yield row | {"value": None, "dimension": None, "error": str(e)}

    return _rows(docs, _VALUES, lambda i, t: list(of(i, t)))


def _parts(body: list[dict], kinds: tuple[str, ...]) -> Iterator[dict]:
    for node in body:
        if node["kind"] in kinds:
            yield node
        elif node["kind"] != "scenario":
            yield from _parts(node["body"], kinds)


def run_scenarios(docs: DataFrame) -> DataFrame:
    """(doc_id, model, scenario, ord, kind, verdict, error) of each assert and expect.

    A scenario's changes hold in it alone; assertions outside scenarios (scenario null) see the model as
    it is. pass and fail are booleans' verdicts; what has no value here, such as a geometric predicate or
    a change to a name without a value, is skipped, with the reason. No shuffle.
    """

    def judged(evaluator: Evaluator, node: dict) -> tuple[str, str | None]:
        try:
            found = evaluator.of(node["value"])
        except EvaluationError as e:
            return "skipped", str(e)
        return ("pass" if found else "fail", None) if isinstance(found, bool) else ("skipped", "a boolean expected")

    def of(doc_id: str, text: str | None) -> Iterator[dict]:
        for m, model in enumerate(_models(text)):
            groups = [(None, model["body"])] + [(s["name"], s["body"]) for s in _parts(model["body"], ("scenario",))]
            for name, body in groups:
                changes = {n["name"]: n["value"] for n in body if n["kind"] == "set"} if name else {}
                evaluator = Evaluator(model, changes)
                for k, node in enumerate(_parts(body, ("assert", "expect"))):
                    lost = sorted(set(changes) - {n["name"] for n in model["body"] if n["kind"] in EVALUATED})
                    verdict, error = ("skipped", f"{lost[0]} can't be set") if lost else judged(evaluator, node)
                    yield {"doc_id": doc_id, "model": m, "scenario": name, "ord": k, "kind": node["kind"], "verdict": verdict, "error": error}

    return _rows(docs, _VERDICTS, lambda i, t: list(of(i, t)))
