"""Types of expressions: what can be said of an expression without evaluating it."""

from __future__ import annotations

from collections.abc import Callable

from .constants import CALL_TYPES, COMPARISONS, TYPE_ALIASES, UNITS

#: What is said of an expression: its type, and whether that is certain.
Said = tuple[str, bool]
OPEN: Said = ("unknown", False)
#: The type of two plain numbers of different types.
WIDER = {frozenset(("integer", "scalar")): "scalar"}


def plain_type(name: str | None) -> str | None:
    return TYPE_ALIASES.get(name, name) if name is not None else None


def _looked_up(table: dict[str, str], key: str) -> Said:
    return (table[key], True) if key in table else OPEN


def _of_name(e: dict, declared: dict, parts: list[Said]) -> Said:
    root = e["path"].partition(".")[0]
    return (plain_type(declared[root]) or "unknown", True) if root in declared else OPEN


def _of_pair(e: dict, declared: dict, parts: list[Said]) -> Said:
    kinds = {kind for kind, _ in parts}
    if len(kinds) == 1:
        return parts[0][0], all(sure for _, sure in parts)
    wider = WIDER.get(frozenset(kinds))
    return (wider, True) if wider else OPEN


#: The first rule that fits an expression says its type from what is said of its parts.
RULES: tuple[tuple[Callable[[dict], bool], Callable[[dict, dict, list[Said]], Said]], ...] = (
    (lambda e: e["kind"] == "binary" and e["operator"] in COMPARISONS, lambda e, d, p: ("boolean", True)),
    (lambda e: e["kind"] == "binary", _of_pair),
    (lambda e: e["kind"] == "unary" and e["operator"] == "not", lambda e, d, p: ("boolean", True)),
    (lambda e: e["kind"] == "unary", lambda e, d, p: p[0]),
    (lambda e: e["kind"] == "list", lambda e, d, p: ("list", True)),
    (lambda e: e["kind"] == "call", lambda e, d, p: _looked_up(CALL_TYPES, e["operation"])),
    (lambda e: e["kind"] == "reference", _of_name),
    (lambda e: bool(e.get("unit")), lambda e, d, p: _looked_up(UNITS, e["unit"])),
    (lambda e: True, lambda e, d, p: (e["type"], True)),
)


def infer(expr: dict, declared: dict[str, str | None]) -> Said:
    """(type, certain) of an expression, given the declared types of its model's symbols.

    No dimension is computed: a length times a length is a length, and a mix of dimensions is unknown
    and uncertain. A declared symbol without a type is "unknown" with certainty. Parts are looked at before
    their whole, from a list: depth is bounded by memory only.
    """
    todo, order = [expr], []
    while todo:
        order.append(e := todo.pop())
        todo += _parts(e)
    said: dict[int, Said] = {}
    for e in reversed(order):
        said[id(e)] = next(rule(e, declared, [said[id(x)] for x in _parts(e)]) for fits, rule in RULES if fits(e))
    return said[id(expr)]


def _parts(e: dict) -> list[dict]:
    return [e["left"], e["right"]] if e["kind"] == "binary" else [e["operand"]] if e["kind"] == "unary" else []
