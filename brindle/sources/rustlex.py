"""A lexer of Rust source: tokens with places, comments dropped (doc comments too)."""

from __future__ import annotations

import re
from typing import NamedTuple

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Tok(NamedTuple):
    kind: str  # ident, life, str, num, char, punct, open, close
    text: str
    line: int
    col: int
    joint: bool  # a punctuation mark directly before another one


class LexError(ValueError):
    pass


_SPACE = re.compile(r"[ \t\r\n\f\v\u0085‎‏  ]+")
_IDENT = re.compile(r"(?:r#)?[^\W\d]\w*")
_RAW = re.compile(r'(?:b|c)?r(#*)"')
_STR = re.compile(r'(?:b|c)?"(?:[^"\\]|\\.)*"', re.S)
_CHAR = re.compile(r"b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]*\}|x[0-9a-fA-F]{2}|.))'", re.S)
_LIFE = re.compile(r"'[^\W\d]\w*")
_NUM = re.compile(r"0[xX][0-9a-fA-F_]+\w*|0[oO][0-7_]+\w*|0[bB][01_]+\w*|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?(?:[iuf][0-9]\w*|usize|isize)?")


def lex(text: str) -> list[Tok]:
    out: list[Tok] = []
    i, n, line, begin = 0, len(text), 1, 0
    if text.startswith("﻿"):
        i = begin = 1
    if text.startswith("#!", i) and not re.match(r"#!\s*\[", text[i:]):
        i = text.find("\n", i)
        i = n if i < 0 else i

    def step(j: int) -> None:
        nonlocal i, line, begin
        k = text.count("\n", i, j)
        if k:
            line, begin = line + k, text.rfind("\n", i, j) + 1
        i = j

    def add(kind: str, j: int, joint: bool = False) -> None:
        out.append(Tok(kind, text[i:j], line, i - begin + 1, joint))
        step(j)

    while i < n:
        c = text[i]
        if m := _SPACE.match(text, i):
            step(m.end())
        elif text.startswith("//", i):
            j = text.find("\n", i)
            step(n if j < 0 else j)
        elif text.startswith("/*", i):
            depth, j = 1, i + 2
            while depth:
                a, b = text.find("/*", j), text.find("*/", j)
                if b < 0:
                    raise LexError("comment without an end")
                depth, j = (depth + 1, a + 2) if 0 <= a < b else (depth - 1, b + 2)
            step(j)
        elif m := _RAW.match(text, i):
            j = text.find('"' + m.group(1), m.end())
            if j < 0:
                raise LexError("raw string without an end")
            add("str", j + 1 + len(m.group(1)))
        elif c == '"' or (c in "bc" and text.startswith('"', i + 1)):
            m = _STR.match(text, i)
            if not m:
                raise LexError("string without an end")
            add("str", m.end())
        elif m := _CHAR.match(text, i):
            add("char", m.end())
        elif m := _LIFE.match(text, i):
            add("life", m.end())
        elif m := _IDENT.match(text, i):
            add("ident", m.end())
        elif m := _NUM.match(text, i):
            add("num", m.end())
        elif c in OPEN:
            add("open", i + 1)
        elif c in CLOSE:
            add("close", i + 1)
        elif c in "+-*/%^!&|=<>@.,;:#$?~\\":
            add("punct", i + 1, i + 1 < n and text[i + 1] in "+-*/%^!&|=<>@.,;:#$?~")
        else:
            raise LexError(f"no token begins with {c!r}")
    return out


def match_groups(tokens: list[Tok]) -> dict[int, int]:
    """Places of opening delimiters to those of their closing ones; fails if they don't pair up."""
    pairs, stack = {}, []
    for k, t in enumerate(tokens):
        if t.kind == "open":
            stack.append(k)
        elif t.kind == "close":
            if not stack or tokens[stack[-1]].text != CLOSE[t.text]:
                raise LexError("delimiters don't pair up")
            pairs[stack.pop()] = k
    if stack:
        raise LexError("a delimiter isn't closed")
    return pairs
