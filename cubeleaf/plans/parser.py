"""Tokens and expressions of the command language.

Trees are tuples, the first item naming the node:

    ("lit", value)  ("col", name)  ("kw", column or None, name)  ("call", name, args)  ("array", items)
    ("bin", op, a, b)  ("un", op, a)  ("in", a, items, negated)  ("between", a, lo, hi, negated)
    ("match", a, regex text, negated)  ("sub", a, subscripts)  ("range", lo, hi, step)  ("query", select)
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from . import patterns


class LanguageError(ValueError):
    """A command that cannot be understood, or operands of the wrong types."""


@dataclass(frozen=True)
class Token:
    kind: str  # num, str, name, op, pattern, quantity, date, angle, end
    text: str
    value: object
    at: int


_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_TIME = r"(?:[/ T-](\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?"
_DATE = re.compile(r"(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?![\d.])" + _TIME)
_NAMED_DATE = re.compile(r"(\d{1,2})-?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*-?(\d{4})" + _TIME, re.I)
_ANGLE = re.compile(r"([+-]?)(\d+)([hd])(\d+)m(?:(\d+(?:\.\d*)?)s?)?", re.I)
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"(?:\\.|[A-Za-z_])(?:\\.|\w)*(?:\.(?:\\.|[A-Za-z_])(?:\\.|\w)*)*")
_PATTERN = re.compile(r"!?~\s*([pmf])([/%@])(.*?)\2(i?)", re.S)
_OPS = ["!~=", "&&", "||", "**", "//", "==", "!=", "<>", "<=", ">=", "~=", "::", "=", "<", ">", "+", "-", "*", "/", "%", "&", "|", "^", "~", "!", "(", ")", "[", "]", ",", ":", ";", "$"]

#: Unit name to (kind, factor to the base unit of the kind).
UNITS = {
    "Hz": ("frequency", 1.0), "kHz": ("frequency", 1e3), "MHz": ("frequency", 1e6), "GHz": ("frequency", 1e9), "THz": ("frequency", 1e12),
    "m": ("length", 1.0), "cm": ("length", 1e-2), "mm": ("length", 1e-3), "um": ("length", 1e-6), "nm": ("length", 1e-9), "km": ("length", 1e3),
    "s": ("time", 1.0), "ms": ("time", 1e-3), "us": ("time", 1e-6), "ns": ("time", 1e-9), "min": ("time", 60.0), "h": ("time", 3600.0), "d": ("time", 86400.0),
    "rad": ("angle", 1.0), "deg": ("angle", math.pi / 180), "arcmin": ("angle", math.pi / 10800), "arcsec": ("angle", math.pi / 648000), "mas": ("angle", math.pi / 648000000),
    "Jy": ("flux", 1.0), "mJy": ("flux", 1e-3), "K": ("temperature", 1.0), "Pa": ("pressure", 1.0), "hPa": ("pressure", 100.0), "g": ("mass", 1e-3), "kg": ("mass", 1.0),
}


def mjd(year: int, month: int, day: int, seconds: float = 0.0) -> float:
    """Modified Julian day of a Gregorian date."""
    from datetime import date

    return float((date(year, month, day) - date(1858, 11, 17)).days) + seconds / 86400.0


def _clock(h: str | None, m: str | None, s: str | None) -> float:
    return (int(h) * 3600 + int(m) * 60 + float(s or 0)) if h else 0.0


def date_value(text: str) -> float | None:
    """MJD days of a date as text, if it is one."""
    text = text.strip()
    if m := _DATE.fullmatch(text):
        return mjd(int(m[1]), int(m[3]), int(m[4]), _clock(*m.group(5, 6, 7)))
    if m := _NAMED_DATE.fullmatch(text):
        return mjd(int(m[3]), _MONTHS.index(m[2][:3].lower()) + 1, int(m[1]), _clock(*m.group(4, 5, 6)))
    return None


def angle_value(text: str) -> float | None:
    """Radians of 10h30m15s or 45d51m16s."""
    m = _ANGLE.fullmatch(text.strip())
    if not m:
        return None
    value = int(m[2]) + int(m[4]) / 60 + float(m[5] or 0) / 3600
    return math.radians(value * (15 if m[3].lower() == "h" else 1)) * (-1 if m[1] == "-" else 1)


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c == "#":
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif c in "'\"":
            end = text.find(c, i + 1)
            if end < 0:
                raise LanguageError(f"string without end at {i}: {text[i:i + 20]!r}")
            if out and out[-1].kind == "str" and out[-1].at == i:  # adjacent strings are one
                out[-1] = Token("str", out[-1].text, out[-1].value + text[i + 1 : end], end + 1)
            else:
                out.append(Token("str", text[i : end + 1], text[i + 1 : end], end + 1))
            i = end + 1
        elif c in "~!" and (m := _PATTERN.match(text, i)):
            out.append(Token("pattern", m[0], (m[0][0] == "!", m[1], m[3], bool(m[4])), i))
            i = m.end()
        elif c.isdigit() or c == "." and text[i + 1 : i + 2].isdigit():
            if m := _DATE.match(text, i) or _NAMED_DATE.match(text, i):
                out.append(Token("date", m[0], date_value(m[0]), i))
            elif m := _ANGLE.match(text, i):
                out.append(Token("angle", m[0], angle_value(m[0]), i))
            else:
                m = _NUMBER.match(text, i)
                unit = re.compile(r"\s*([A-Za-z]+)\b(?!\s*\()").match(text, m.end())
                raw = m[0]
                whole = not re.search(r"[.eE]", raw) or raw[:2].lower() == "0x"
                value = min(int(raw, 0 if raw[:2].lower() == "0x" else 10), 2**63 - 1) if whole else float(raw)
                if unit and unit[1] in UNITS:
                    out.append(Token("quantity", text[i : unit.end()], (float(value), unit[1]), i))
                    i = unit.end()
                    continue
                out.append(Token("num", raw, value, i))
            i = m.end()
        elif m := _NAME.match(text, i):
            out.append(Token("name", m[0].replace("\\", ""), m[0].replace("\\", ""), i))
            i = m.end()
        else:
            op = next((o for o in _OPS if text.startswith(o, i)), None)
            if op is None:
                raise LanguageError(f"unexpected {c!r} at {i}")
            out.append(Token("op", op, op, i))
            i += len(op)
    out.append(Token("end", "", None, len(text)))
    return out


class Parser:
    """Recursive descent; each method takes one level of precedence, loosest first."""

    def __init__(self, text: str, toks: list[Token] | None = None, subquery=None):
        self.text, self.toks, self.i, self.subquery = text, toks or tokens(text), 0, subquery

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def word(self, *words: str) -> bool:
        return self.tok.kind == "name" and self.tok.text.upper() in words

    def op(self, *ops: str) -> bool:
        return self.tok.kind == "op" and self.tok.text in ops

    def take(self, *ops: str) -> str | None:
        if self.op(*ops):
            self.i += 1
            return self.toks[self.i - 1].text
        return None

    def take_word(self, *words: str) -> bool:
        if self.word(*words):
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise LanguageError(f"expected {op!r} at {self.tok.at} in {self.text!r}, found {self.tok.text!r}")

    def whole(self):
        out = self.expression()
        if self.tok.kind != "end":
            raise LanguageError(f"unexpected {self.tok.text!r} at {self.tok.at} in {self.text!r}")
        return out

    def expression(self):
        left = self.conjunction()
        while self.take("||") or self.take_word("OR"):
            left = ("bin", "or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("&&") or self.take_word("AND"):
            left = ("bin", "and", left, self.negation())
        return left

    def negation(self):
        if self.take_word("NOT") or (self.op("!") and self.take("!")):
            if self.word("EXISTS"):
                return ("un", "not", self.comparison())
            return ("un", "not", self.negation())
        return self.comparison()

    def comparison(self):
        if self.take_word("EXISTS"):
            return ("exists", self._sub_select())
        left = self.bit_or()
        if op := self.take("==", "=", "!=", "<>", "<=", "<", ">=", ">", "~=", "!~="):
            right = self.bit_or()
            return ("bin", {"=": "==", "<>": "!="}.get(op, op), left, right)
        if self.tok.kind == "pattern":
            negated, kind, body, fold = self.tok.value
            self.i += 1
            return ("match", left, patterns.regex_of(kind, body, fold), negated)
        at = self.i
        negated = self.take_word("NOT")
        if self.take_word("IN"):
            return ("in", left, self._in_items(), negated)
        if self.take_word("BETWEEN"):
            low = self.bit_or()
            if not self.take_word("AND"):
                raise LanguageError("BETWEEN needs AND")
            return ("between", left, low, self.bit_or(), negated)
        if self.word("LIKE", "ILIKE"):
            fold = self.tok.text.upper() == "ILIKE"
            self.i += 1
            if self.tok.kind != "str":
                raise LanguageError("LIKE needs a literal pattern")
            body = self.tok.value
            self.i += 1
            return ("match", left, patterns.regex_of("s", body, fold), negated)
        self.i = at
        return left

    def _sub_select(self):
        close = {"(": ")", "[": "]"}[self.take("(", "[") or "("]
        out = self.subquery(self)
        self.need(close)
        return out

    def _in_items(self):
        if self.op("(", "[") and self.toks[self.i + 1].kind == "name" and self.toks[self.i + 1].text.upper() == "SELECT" and self.subquery:
            return ("query", self._sub_select())
        opened = self.take("(", "[")
        if not opened:
            return ("items", [self.bit_or()])
        close = {"(": ")", "[": "]"}[opened]
        items = []
        while not self.op(close):
            items.append(self._range_or_value())
            if not self.take(","):
                break
        self.need(close)
        return ("items", items)

    def _range_or_value(self):
        low = None if self.op(":") else self.expression()
        if not self.take(":"):
            return low
        high = None if self.op(":", ",", ")", "]") else self.expression()
        step = self.expression() if self.take(":") and not self.op(",", ")", "]") else None
        return ("range", low, high, step)

    def _binary(self, below, *ops: str):
        left = below()
        while op := self.take(*ops):
            left = ("bin", op, left, below())
        return left

    def bit_or(self):
        return self._binary(self.bit_xor, "|")

    def bit_xor(self):
        return self._binary(self.bit_and, "^")

    def bit_and(self):
        return self._binary(self.additive, "&")

    def additive(self):
        return self._binary(self.multiplicative, "+", "-")

    def multiplicative(self):
        return self._binary(self.unary, "*", "/", "%", "//")

    def unary(self):
        if op := self.take("-", "+", "~", "!"):
            inner = self.unary()
            return inner if op == "+" else ("un", {"!": "not"}.get(op, op), inner)
        return self.power()

    def power(self):
        base = self.postfix()
        return ("bin", "**", base, self.unary()) if self.take("**") else base

    def postfix(self):
        out = self.primary()
        while self.take("["):
            subs = []
            while not self.op("]"):
                subs.append(("range", None, None, None) if self.op(",") else self._range_or_value())
                if self.take(",") and self.op("]"):
                    subs.append(("range", None, None, None))
            self.need("]")
            out = ("sub", out, subs)
        return out

    def primary(self):
        t = self.tok
        self.i += 1
        if t.kind in ("num", "str", "date", "angle"):
            return ("lit", t.value) if t.kind != "date" else ("date", t.value)
        if t.kind == "quantity":
            return ("quantity", *t.value)
        if t.kind == "op" and t.text == "(":
            out = self.expression()
            self.need(")")
            return out
        if t.kind == "op" and t.text == "[":
            items = []
            while not self.op("]"):
                items.append(self.expression())
                if not self.take(","):
                    break
            self.need("]")
            return ("array", items)
        if t.kind == "op" and t.text == "::":
            name = self.tok.text
            self.i += 1
            return ("kw", None, name)
        if t.kind == "name":
            upper = t.text.upper()
            if self.take("::"):
                name = self.tok.text
                self.i += 1
                return ("kw", t.text, name)
            if self.op("(") and upper not in ("AND", "OR", "NOT", "IN"):
                self.i += 1
                args = []
                while not self.op(")"):
                    args.append(self.expression())
                    if not self.take(","):
                        break
                self.need(")")
                return ("call", t.text.lower(), args)
            if upper in ("T", "TRUE"):
                return ("lit", True)
            if upper in ("F", "FALSE"):
                return ("lit", False)
            if upper == "END":
                return ("end",)
            return ("col", t.text)
        raise LanguageError(f"unexpected {t.text!r} at {t.at} in {self.text!r}")


def parse(text: str, subquery=None):
    """The tree of an expression."""
    return Parser(text, subquery=subquery).whole()


def walk(tree):
    """All nodes of a tree."""
    if isinstance(tree, tuple):
        yield tree
        for x in tree[1:]:
            yield from walk(x)
    elif isinstance(tree, list):
        for x in tree:
            yield from walk(x)
