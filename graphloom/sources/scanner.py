"""Tokens of a source text, by one pattern with a named group per kind."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from typing import NamedTuple

Span = tuple[int, int, int, int]  # line, column, end line, end column; from 1


class SourceError(ValueError):
    """A text that can't be read; code E000 for tokens, E010 for structure."""

    def __init__(self, code: str, message: str, span: Span):
        super().__init__(message)
        self.code, self.message, self.span = code, message, span


class Token(NamedTuple):
    kind: str  # name, number, string, mark or end
    text: str
    value: str
    span: Span


_PATTERN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<number>(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
      | (?P<string>"(?:[^"\\\n]|\\.)*")
      | (?P<mark>->|==|!=|<=|>=|~=|&&|\|\||[{}()\[\],:;.=+\-*/^<>@])""",
    re.X | re.S,
)


class Places:
    """Lines and columns of offsets in a text."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def span(self, start: int, end: int) -> Span:
        a, b = bisect_right(self.starts, start), bisect_right(self.starts, end)
        return a, start - self.starts[a - 1] + 1, b, end - self.starts[b - 1] + 1


def scan(text: str) -> list[Token]:
    """All tokens and an end; SourceError E000 at what begins no token. Blanks and comments are skipped.

    Digits are ASCII only; strings are read as JSON strings and end on their line.
    """
    places, tokens, at = Places(text), [], 0
    while at < len(text):
        m = _PATTERN.match(text, at)
        if m is None or (m.lastgroup == "mark" and text.startswith("/*", at)):
            raise _unreadable(text, at, places)
        kind, raw, at = m.lastgroup, m[0], m.end()
        if kind == "space":
            continue
        span, value = places.span(m.start(), at), raw
        if kind == "string":
            try:
                value = json.loads(raw)
            except ValueError as e:
                raise SourceError("E000", f"invalid string escape: {e}", span) from e
        tokens.append(Token(kind, raw, value, span))
    tokens.append(Token("end", "", "", places.span(at, at)))
    return tokens


def _unreadable(text: str, at: int, places: Places) -> SourceError:
    if text.startswith("/*", at):
        return SourceError("E000", "a comment has no end", places.span(at, at + 2))
    if text[at] == '"':
        stop = re.compile(r'(?:[^"\\\n]|\\.)*', re.S).match(text, at + 1).end()
        said = "a string ends on another line" if text[stop : stop + 1] == "\n" else "a string has no end"
        return SourceError("E000", said, places.span(at, stop))
    return SourceError("E000", f"no token begins with {text[at]!r}", places.span(at, at + 1))
