"""Tokens of the dialect. Offsets are half-open byte ranges of the UTF-8 text.

Spacing matters to the parser (`a-b` selects, `a - b` subtracts), so tokens keep their places. A string template is one
token; the parser reads its parts from the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Fixed spellings of the operators and their kinds.
OPERATORS = {
    "=>": "StaticArrow", "->": "Arrow", "<=": "LessEqual", "<>": "NotEqual", ">=": "GreaterEqual", "?=": "DownCast",
    "=": "Equal", "<": "Less", ">": "Greater", "+": "Plus", "-": "Minus", "*": "Star", "/": "Slash", "&": "Ampersand",
    "(": "LParen", ")": "RParen", "[": "LBracket", "]": "RBracket", "{": "LBrace", "}": "RBrace", ".": "Period", ",": "Comma",
    ":": "Colon", "@": "At", "#": "Hash", "~": "Tilde", "?": "Other",
}
_OPERATOR = re.compile("|".join(sorted(map(re.escape, OPERATORS), key=len, reverse=True)))
_IDENT = re.compile(r"[^\W\d]\w*(?:/[\w/]*)?|/[^\W\d]\w*/[\w/]+")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_BLANK = re.compile(r"\s+")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "Ident" else ""


def _template_end(src: str, at: int) -> int | None:
    """Position after the closing bar of the template that opens at `at`; embedded expressions may hold templates."""
    i, depth = at + 1, 0
    while i < len(src):
        ch = src[i]
        if depth == 0 and ch == "\\":
            i += 1
        elif ch == "{":
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
        elif ch == "|":
            if depth == 0:
                return i + 1
            inner = _template_end(src, i)
            if inner is None:
                return None
            i = inner
            continue
        elif ch == "'" and depth:
            close = src.find("'", i + 1)
            i = close if close > 0 else i
        i += 1
    return None


def tokenize(source: str | bytes) -> tuple[list[Token], list[tuple[int, int, str]]]:
    """All tokens, comments included, ending with EOF; and the lexical errors as (start, end, message)."""
    errors: list[tuple[int, int, str]] = []
    if isinstance(source, bytes):
        try:
            src = source.decode("utf-8")
        except UnicodeDecodeError as e:
            errors.append((e.start, e.end, "invalid UTF-8"))
            src = source.decode("utf-8", "replace")
    else:
        src = source
    # Byte offset of every character; ASCII text needs no table.
    if src.isascii():
        place = range(len(src) + 1)
    else:
        place = [0]
        for ch in src:
            place.append(place[-1] + len(ch.encode("utf-8", "replace")))
    out: list[Token] = []

    def emit(kind: str, a: int, b: int) -> int:
        out.append(Token(kind, src[a:b], place[a], place[b]))
        return b

    i, n = 0, len(src)
    while i < n:
        ch = src[i]
        if ch == "﻿":
            if i:
                errors.append((place[i], place[i + 1], "byte order mark inside the text"))
            i += 1
        elif ch == "\0":
            errors.append((place[i], place[i + 1], "NUL character"))
            i += 1
        elif ch.isspace():
            i = _BLANK.match(src, i).end()
        elif ch == '"' or (ch == "*" and (i == 0 or src[i - 1] == "\n")) or src.startswith("##", i):
            if src.startswith("##", i):
                j = i + 2
                while j < n and (src[j].isalnum() or src[j] in "_["):
                    j += 1
            else:
                j = src.find("\n", i)
                j = n if j < 0 else j
            i = emit("Comment", i, j)
        elif ch in "'`":
            j = src.find(ch, i + 1)
            line = src.find("\n", i)
            if j < 0 or 0 <= line < j:
                j = n - 1 if line < 0 else line - 1
                errors.append((place[i], place[j + 1], "string is not closed on its line"))
            i = emit("String", i, j + 1)
        elif ch == "|":
            j = _template_end(src, i)
            if j is None:
                j = n
                errors.append((place[i], place[n], "string template is not closed"))
            i = emit("StringTemplate", i, j)
        elif m := _NUMBER.match(src, i):
            i = emit("Number", i, m.end())
        elif m := _IDENT.match(src, i):
            i = emit("Ident", i, m.end())
        elif m := _OPERATOR.match(src, i):
            i = emit(OPERATORS[m[0]], i, m.end())
        else:
            errors.append((place[i], place[i + 1], f"unexpected character {ch!r}"))
            i = emit("Bad", i, i + 1)
    out.append(Token("EOF", "", place[n], place[n]))
    return out, errors
