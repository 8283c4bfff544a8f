"""Tokens of brace languages, without comments."""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"""
    r"""|(?P<str>\"\"\".*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"""
    r"""|(?P<id>[^\W\d]\w*|\$\w+)|(?P<num>\d[\w.]*)|(?P<op>=>|->|::|\?\.|!!|&&|\|\||[<>=!]=|.)""",
    re.S,
)


class Token(NamedTuple):
    kind: str
    text: str
    line: int

    @property
    def value(self) -> str:
        """What a string literal holds."""
        n = 3 if self.text.startswith('"""') else 1
        return self.text[n:-n] if len(self.text) >= 2 * n else self.text[n:]


def lex(source: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(source):
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
    return out


_OPEN = {"(": ")", "[": "]", "{": "}"}


def closing(tokens: list[Token], i: int, end: int | None = None) -> int:
    """The place of the bracket that closes the one at i (or the end)."""
    depth, end = 0, len(tokens) if end is None else end
    for k in range(i, end):
        if tokens[k].kind == "op":
            if tokens[k].text in _OPEN:
                depth += 1
            elif tokens[k].text in ")]}":
                depth -= 1
                if depth == 0:
                    return k
    return end - 1


def after_generics(tokens: list[Token], i: int) -> int:
    """The place after <...> at i, or i."""
    if i >= len(tokens) or tokens[i].text != "<":
        return i
    depth = 0
    for k in range(i, len(tokens)):
        t = tokens[k].text
        depth += (t == "<") - (t == ">")
        if depth == 0:
            return k + 1
        if t in "{};":
            return i
    return i


def split_commas(tokens: list[Token]) -> list[list[Token]]:
    """Parts between top-level commas, generics included."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "op":
            depth += (t.text in "([{<") - (t.text in ")]}>")
            if t.text == "," and depth == 0:
                out.append([])
                continue
        out[-1].append(t)
    return [x for x in out if x]
