"""Source texts to trees of plain dicts. A statement's form is a row of SHAPES, a list of steps."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal
from itertools import chain

from ..functions.constants import STRENGTH
from .scanner import SourceError, Span, Token, scan

#: Blocks and expressions may be nested so deep, all in all.
DEEPEST = 1000
#: Calls that reading and lowering may be deep: over ten for each level of nesting, and some for each term of a long sum.
CALLS = 40_000

# Steps of each keyword's statement. "?" marks a step that may be left out.
_SIMPLE = ("name", "type?", "value?", "attributes", "block or end")
SHAPES: dict[str, tuple[str, ...]] = (
    {k: _SIMPLE for k in ("parameter", "constant", "datum", "reference", "material", "pmi", "tolerance")}
    | {k: ("name", "type?", "value", "attributes", "end") for k in ("profile", "dimension", "let", "output")}
    | {k: ("expression", "attributes", "end") for k in ("constraint", "assert", "expect")}
    | {k: ("attributes", "block") for k in ("units", "metadata", "validate")}
    | {k: ("name", "attributes", "block") for k in ("assembly", "scenario", "extension")}
    | {"sketch": ("name", "plane", "attributes", "block"), "feature": ("name", "type", "attributes", "block"), "set": ("path", "value", "end")}
)


def join(a: Span, b: Span) -> Span:
    return a[0], a[1], b[2], b[3]


class Reader:
    """Reads tokens left to right; the first error ends it (E010)."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    @property
    def next(self) -> Token:
        return self.tokens[self.at]

    def ahead(self) -> Token:
        return self.tokens[min(self.at + 1, len(self.tokens) - 1)]

    def take(self) -> Token:
        token = self.next
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return token

    def fail(self, message: str) -> SourceError:
        return SourceError("E010", message, self.next.span)

    def sees(self, text: str) -> bool:
        return self.next.text == text and self.next.kind in ("mark", "name")

    def accept(self, text: str) -> Token | None:
        return self.take() if self.sees(text) else None

    def need(self, text: str) -> Token:
        if not self.sees(text):
            raise self.fail(f"expected {text!r}, found {self.next.text!r}")
        return self.take()

    def name(self, what: str = "identifier") -> Token:
        if self.next.kind != "name":
            raise self.fail(f"expected {what}")
        return self.take()

    def path(self) -> tuple[str, Span]:
        first = last = self.name()
        parts = [first.text]
        while self.accept("."):
            last = self.name("identifier after '.'")
            parts.append(last.text)
        return ".".join(parts), join(first.span, last.span)

    def deeper(self, step: int) -> None:
        self.depth += step
        if self.depth > DEEPEST:
            raise self.fail(f"nested more than {DEEPEST} deep")

    # Structure

    def document(self) -> dict:
        head = self.name("the language's name")
        if self.next.kind not in ("number", "string", "name"):
            raise self.fail(f"no version of the language before {self.next.text!r}")
        out = {"language": head.text, "version": self.take().value, "namespace": None, "imports": [], "models": []}
        self.need(";")
        if self.accept("namespace"):
            out["namespace"] = self.path()[0]
            self.need(";")
        while start := self.accept("import"):
            if self.next.kind != "string":
                raise self.fail("what is imported must stand in quotes")
            found = {"source": self.take().value, "alias": self.name().text if self.accept("as") else None}
            out["imports"].append(found | {"span": join(start.span, self.need(";").span)})
        while self.next.kind != "end":
            start = self.need("model")
            model = {"name": self.name("model name").text, "attributes": self.attributes()}
            model["body"], end = self.block()
            out["models"].append(model | {"span": join(start.span, end)})
        if not out["models"]:
            raise self.fail("a document needs a model")
        return out | {"span": join(head.span, out["models"][-1]["span"])}

    def block(self) -> tuple[list[dict], Span]:
        self.need("{")
        self.deeper(1)
        body = []
        while not self.sees("}"):
            if self.next.kind == "end":
                raise self.fail("the text ends inside a block")
            body.append(self.statement())
        self.deeper(-1)
        return body, self.take().span

    def statement(self) -> dict:
        verb = self.name("declaration or statement")
        node = {"kind": verb.text, "name": None, "type": None, "value": None, "context": None, "attributes": [], "body": []}
        if self.sees("=") or self.sees("."):  # an assignment, even to a name that is a keyword
            parts = [verb.text]
            while self.accept("."):
                parts.append(self.name().text)
            node |= {"kind": "assign", "name": ".".join(parts)}
            steps: tuple[str, ...] = ("value", "end")
        elif verb.text in SHAPES:
            steps = SHAPES[verb.text]
        else:  # unknown verbs stay in the tree
            steps = ("name", "block") if self.next.kind == "name" and self.ahead().text == "{" and self.ahead().kind == "mark" else ("expression", "attributes", "end")
        end = verb.span
        for step in steps:
            end = self.step(step, node) or end
        return node | {"span": join(verb.span, end)}

    def step(self, step: str, node: dict) -> Span | None:
        match step:
            case "name":
                node["name"] = self.name(f"{node['kind']} name").text
            case "path":
                node["name"] = self.path()[0]
            case "type" | "type?":
                if step == "type" or self.sees(":"):
                    self.need(":")
                    node["type"] = self.path()[0]
            case "value" | "value?":
                if step == "value" or self.sees("="):
                    self.need("=")
                    node["value"] = self.expression()
            case "expression":
                node["value"] = self.expression()
            case "plane":
                self.need("on")
                node["context"] = self.expression()
            case "attributes":
                node["attributes"] = self.attributes()
            case "end":
                return self.need(";").span
            case _:
                if step == "block" or self.sees("{"):
                    node["body"], end = self.block()
                    return end
                return self.need(";").span
        return None

    def attributes(self) -> list[tuple[str, dict]]:
        return self.listed("]", self.pair) if self.accept("[") else []

    def pair(self) -> tuple[str, dict]:
        key = self.name("attribute name").text
        self.need("=")
        return key, self.expression()

    def listed(self, close: str, item) -> list:
        """Items with commas between them, up to the closing mark; none behind the last."""
        found: list = []
        while not (not found and self.accept(close)):
            found.append(item())
            if self.accept(close):
                break
            self.need(",")
        return found

    # Expressions

    def expression(self) -> dict:
        """Operands and operators on two stacks, folded by strength."""
        self.deeper(1)
        operands, operators = [self.operand()], []

        def fold() -> None:
            right, left, op = operands.pop(), operands.pop(), operators.pop()
            operands.append({"kind": "binary", "operator": op, "left": left, "right": right, "span": join(left["span"], right["span"])})

        while self.next.kind in ("mark", "name") and self.next.text in STRENGTH:
            op = self.take().text
            while operators and (STRENGTH[operators[-1]] > STRENGTH[op] or (STRENGTH[operators[-1]] == STRENGTH[op] and op != "^")):
                fold()
            operators.append(op)
            operands.append(self.operand())
        while operators:
            fold()
        self.deeper(-1)
        return operands[0]

    def operand(self) -> dict:
        signs = []
        while self.sees("+") or self.sees("-") or self.sees("not"):
            signs.append(self.take())
        found = self.primary()
        for sign in reversed(signs):  # a sign binds tighter than any operator between operands
            found = {"kind": "unary", "operator": sign.text, "operand": found, "span": join(sign.span, found["span"])}
        return found

    def primary(self) -> dict:
        token = self.next
        if token.kind == "number":
            self.take()
            whole = not set(token.text) & set(".eE")
            found = {"kind": "literal", "type": "integer" if whole else "scalar", "value": int(token.text) if whole else Decimal(token.text), "span": token.span}
            if self.next.kind == "name" and self.next.text not in ("and", "or"):
                unit = self.take()
                found |= {"unit": unit.text, "span": join(token.span, unit.span)}
            return found
        if token.kind == "string":
            return {"kind": "literal", "type": "string", "value": self.take().value, "span": token.span}
        if token.kind == "name":
            if token.text in ("true", "false", "null"):
                self.take()
                return {"kind": "literal", "type": "null" if token.text == "null" else "boolean", "value": {"true": True, "false": False, "null": None}[token.text], "span": token.span}
            path, span = self.path()
            return self.call(path, span) if self.accept("(") else {"kind": "reference", "path": path, "span": span}
        if self.accept("("):
            found = self.expression()
            end = self.need(")").span
            return found | {"span": join(token.span, end)} if found["kind"] == "reference" else found
        if self.accept("["):
            items = self.listed("]", self.expression)
            return {"kind": "list", "items": items, "span": join(token.span, self.tokens[self.at - 1].span)}
        raise self.fail(f"expected expression, found {token.text!r}")

    def call(self, path: str, span: Span) -> dict:
        def argument():
            if self.next.kind == "name" and self.ahead().text == "=" and self.ahead().kind == "mark":
                return self.pair()
            return None, self.expression()

        given = self.listed(")", argument)
        return {
            "kind": "call", "operation": path, "arguments": [e for k, e in given if k is None], "keywords": [(k, e) for k, e in given if k is not None],
            "span": join(span, self.tokens[self.at - 1].span),
        }


@contextmanager
def deep_calls() -> Iterator[None]:
    """Room for the calls of deep texts; E010 where it isn't enough, as for a sum of thousands of terms."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, CALLS))
    try:
        yield
    except RecursionError as e:
        raise SourceError("E010", "expressions are too long or too deep", (1, 1, 1, 1)) from e
    finally:
        sys.setrecursionlimit(limit)


def read_source(text: str) -> dict:
    """The tree of a source text; SourceError if it has none."""
    with deep_calls():
        return Reader(scan(text)).document()


def children(expr: dict) -> list[dict]:
    """Parts of an expression in which names may stand; a call's own name isn't one."""
    match expr["kind"]:
        case "call":
            return [*expr["arguments"], *(e for _, e in expr["keywords"])]
        case "unary":
            return [expr["operand"]]
        case "binary":
            return [expr["left"], expr["right"]]
        case "list":
            return expr["items"]
    return []


def references(expr: dict) -> list[dict]:
    """References of an expression from left to right."""
    found, stack = [], [expr]
    while stack:
        top = stack.pop()
        if top["kind"] == "reference":
            found.append(top)
        stack.extend(reversed(children(top)))
    return found


def expressions(node: dict) -> list[dict]:
    """A node's value, context and attributes, and those of its parts."""
    own = [e for e in (node["value"], node["context"]) if e is not None]
    return [*own, *(e for _, e in node["attributes"]), *chain.from_iterable(map(expressions, node["body"]))]
