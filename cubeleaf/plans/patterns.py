"""Patterns as Java regular expressions.

``.`` and ``%`` stop at a line feed only, hence the flag d.  SQL patterns, globs and f/../ match a whole string;
m/../ matches anywhere.
"""

from __future__ import annotations

import re


def _glob(body: str) -> str:
    out, i, depth = [], 0, 0
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            i += 1
            out.append(re.escape(body[i]))
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = body.find("]", i + 2)
            if end < 0:
                out.append(r"\[")
            else:
                inner = body[i + 1 : end]
                inner = "^" + inner[1:] if inner[0] in "!^" else inner
                out.append("[" + inner.replace("\\", "\\\\") + "]")
                i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def _sql(body: str) -> str:
    return "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in body)


def regex_of(kind: str, body: str, fold: bool = False) -> str:
    """kind: s (SQL), p (glob), f (regular, whole string), m (regular, anywhere)."""
    inner = {"s": _sql, "p": _glob}.get(kind, lambda x: x)(body)
    flags = "(?di)" if fold else "(?d)"
    return flags + (inner if kind == "m" else rf"\A(?:{inner})\z")
