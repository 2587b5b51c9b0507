"""String functions.  Lengths and positions count bytes; case is that of ASCII letters only."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import patterns
from ..plans.parser import LanguageError
from ..plans.values import NUMBERS, Value, lift, need

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(f, type_: str = "string"):
    def g(v: Value) -> Value:
        need("string", "a string function", v)
        return lift(f, type_, v)

    return g


def _bytes_reversed(s: Column) -> Column:
    ascii_only = F.octet_length(s) == F.char_length(s)
    turned = F.concat_ws("", F.reverse(F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("(..)"))))
    return F.when(ascii_only, F.reverse(s)).otherwise(F.decode(F.unhex(turned), "UTF-8"))


def _capital(s: Column) -> Column:
    """The first letter of each run of letters and digits in upper case, the others in lower case."""
    lower = F.translate(s, _UPPER, _LOWER)
    parts = F.regexp_extract_all(lower, F.lit(r"([A-Za-z0-9]+|[^A-Za-z0-9]+)"))
    return F.concat_ws("", F.transform(parts, lambda w: F.concat(F.translate(F.substring(w, 1, 1), _LOWER, _UPPER), F.substr(w, F.lit(2)))))


def _substr(v: Value, start: Value, length: Value | None = None) -> Value:
    need("string", "substr", v)
    need(NUMBERS, "substr", start, *([length] if length is not None else []))

    def f(s: Column) -> Column:
        n = F.octet_length(s)
        at = start.col.cast("int")
        at = F.when(at < 0, F.greatest(F.lit(0), at + n)).otherwise(at)
        size = n if length is None else F.least(length.col.cast("bigint"), n.cast("bigint")).cast("int")
        ascii_only = n == F.char_length(s)
        cut = F.when(ascii_only, F.substr(s, at + 1, size)).otherwise(F.decode(F.substr(F.encode(s, "UTF-8"), at + 1, size), "UTF-8"))
        return F.when((size <= 0) | (at >= n), F.lit("")).otherwise(cut)

    return lift(f, "string", v)


def _replace(v: Value, what: Value, by: Value) -> Value:
    need("string", "replace", v, what, by)
    return lift(lambda s: F.when(what.col == "", s).otherwise(F.replace(s, what.col, by.col)), "string", v)


@F.pandas_udf(T.StringType())
def _shortest(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else "nan" if v != v else "inf" if v == float("inf") else "-inf" if v == float("-inf") else f"{v:g}")


def _string(v: Value, form: Value | None = None) -> Value:
    if form is not None:
        if not isinstance(form.literal, str):
            raise LanguageError("string needs a literal format")
        return lift(lambda x: F.format_string(form.literal, x), "string", v)
    if v.type == "bool":
        return lift(lambda x: F.when(x, F.lit("True ")).otherwise(F.lit("False")), "string", v)
    if v.type == "int":
        return lift(lambda x: x.cast("string"), "string", v)
    if v.type == "float":
        if v.is_array:
            raise LanguageError("string of a float array needs a format")
        return Value(_shortest(v.col), "string")
    need("string", "string", v)
    return v


def _bool(v: Value) -> Value:
    if v.type == "string":
        return lift(lambda s: ~F.lower(F.trim(s)).isin("", "0", "f", "false", "n", "no"), "bool", v)
    if v.type == "bool":
        return v
    need(NUMBERS, "bool", v)
    return lift(lambda x: x != 0, "bool", v)


def _pattern(kind: str):
    def g(v: Value) -> Value:
        if not isinstance(v.literal, str):
            raise LanguageError("a pattern must be a literal")
        return Value(F.lit(patterns.regex_of(kind, v.literal)), "string", pattern=True)

    return g


def _trim(chars: str, where: str):
    left, right = f"^[{re.escape(chars)}]+", f"[{re.escape(chars)}]+\\z"
    pattern = {"both": f"{left}|{right}", "left": left, "right": right}[where]
    return lambda s: F.regexp_replace(s, pattern, "")


_upper = _text(lambda s: F.translate(s, _LOWER, _UPPER))
_lower = _text(lambda s: F.translate(s, _UPPER, _LOWER))
_length = _text(lambda s: F.octet_length(s).cast("bigint"), "int")

FUNCTIONS = {
    **{n: (1, 1, _length) for n in ("strlength", "len")},
    **{n: (1, 1, _upper) for n in ("upcase", "upper", "toupper", "to_upper")},
    **{n: (1, 1, _lower) for n in ("downcase", "lower", "tolower", "to_lower")},
    "capitalize": (1, 1, _text(_capital)), "reversestring": (1, 1, _text(_bytes_reversed)), "sreverse": (1, 1, _text(_bytes_reversed)),
    "trim": (1, 1, _text(_trim(" \t\n\r", "both"))), "ltrim": (1, 1, _text(_trim(" \t", "left"))), "rtrim": (1, 1, _text(_trim(" \t", "right"))),
    "substr": (2, 3, _substr), "substring": (2, 3, _substr), "replace": (3, 3, _replace), "string": (1, 2, _string), "str": (1, 2, _string), "bool": (1, 1, _bool), "boolean": (1, 1, _bool),
    "regex": (1, 1, _pattern("f")), "pattern": (1, 1, _pattern("p")), "sqlpattern": (1, 1, _pattern("s")),
}
