"""Selections of an observation's main table as predicates, and what its dimension tables make of its columns.

``cubeleaf.plans.selection`` parses a selection to a tree; here the tree becomes a predicate over the main table's
columns, so that it is pushed down like any other filter.  What names, windows or positions mean is read once from
their dimension tables, which are small and are checked to be; it goes into the plan as literals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import selection as tree
from ..plans.lower import ROW, lower
from ..plans.parser import LanguageError
from ..plans.patterns import regex_of
from ..plans.values import Value
from ..table import Table
from . import polarisation
from .polarisation import PRODUCTS
from .scalar import C_LIGHT

#: A dimension table has at most so many rows; they are held on the driver.
MOST_NAMES = 100_000
#: Metres, and hertz, of a unit.
METRES = {"": 1.0, "m": 1.0, "km": 1e3}
WAVES = {"lambda": 1.0, "klambda": 1e3, "mlambda": 1e6}
HERTZ = {"hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9, "thz": 1e12}
#: Main column and dimension table of what is selected by ids alone.
BY_ID = {
    "scan": ("SCAN_NUMBER", None, None),
    "array": ("ARRAY_ID", None, None),
    "obs": ("OBSERVATION_ID", None, None),
    "field": ("FIELD_ID", "FIELD", "NAME"),
    "state": ("STATE_ID", "STATE", "OBS_MODE"),
}
_DAY, _EPOCH = 86400.0, datetime(1858, 11, 17)


def small_rows(t: Table, *columns: str) -> list:
    """The rows of a small table by row number; more than MOST_NAMES are an error."""
    rows = t.df.select(F.col(ROW).alias("i"), *columns).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise LanguageError(f"more than {MOST_NAMES} rows")
    return sorted(rows, key=lambda r: r["i"])


@dataclass(frozen=True)
class Names:
    """Names by id, and the ids that are flagged: names and open ranges leave those out."""

    names: tuple[str, ...] = ()
    flagged: frozenset[int] = frozenset()

    @classmethod
    def of(cls, t: Table | None, column: str = "NAME") -> Names:
        if t is None or column not in t.columns:
            return cls()
        flag = "FLAG_ROW" in t.columns
        rows = small_rows(t, column, *(["FLAG_ROW"] if flag else []))
        return cls(tuple(r[column] for r in rows), frozenset(r["i"] for r in rows if flag and r["FLAG_ROW"]))

    def matching(self, name: tree.Name) -> list[int]:
        pattern = {"name": re.escape(name.text), "regex": name.text}.get(name.kind)
        if pattern is None:
            pattern = regex_of("p", name.text).removeprefix("(?d)").replace(r"\z", r"\Z")
        test = re.compile(pattern).search if name.kind == "regex" else re.compile(pattern, re.S).fullmatch
        return [i for i, n in enumerate(self.names) if i not in self.flagged and test(n)]

    def contains(self, c: Column, term: tree.Range | tree.Name) -> Column:
        """Whether an id is meant by a term."""
        if isinstance(term, tree.Name):
            found = self.matching(term)
            return c.isin(*found) if found else F.lit(False)
        if not term.open:
            return c.between(term.low, term.high) if term.low != term.high else c == term.low
        test = within(c, term)
        return test & ~c.isin(*sorted(self.flagged)) if self.flagged else test

    def any_of(self, c: Column, terms: tuple) -> Column:
        return any_of(self.contains(c, t) for t in terms)


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def within(c: Column, r: tree.Range, scale: float = 1.0, share: float = 0.0) -> Column:
    """Whether a number lies in a range, whose ends are widened by a share."""
    tests = []
    if r.low is not None:
        low = r.low * scale * (1 - share)
        tests.append(c > low if r.strict else c >= low)
    if r.high is not None:
        high = r.high * scale * (1 + share)
        tests.append(c < high if r.strict else c <= high)
    return reduce(lambda a, b: a & b, tests)


def scale_of(unit: str, units: dict[str, float]) -> float:
    if unit.lower() not in units:
        raise LanguageError(f"unknown unit {unit!r}")
    return units[unit.lower()]


def pairs(a: Column, b: Column, text: str, names: Names, *, length: Column | None = None, alone_is_cross: bool = True) -> Column:
    """Pairs of ids: ``A & B`` between different ids, ``A && B`` with equal ones too, ``A &&& `` equal ones only.

    A list alone means all pairs with any of it, between different ids unless told otherwise; a list of lengths, pairs
    so far apart; one of regular expressions with an ampersand, pairs whose names joined by one match.  Items at
    semicolons add up in their order, and those with ``!`` take away.
    """
    inside = lambda c, terms: names.any_of(c, terms)

    def of_names(term: tree.Name) -> Column:
        out = term.text.startswith("^")
        name = lambda c: F.get(F.array(*(F.lit(n) for n in names.names)), c)
        found = F.concat(name(a), F.lit("&"), name(b)).rlike(rf"\A(?:{term.text.removeprefix('^')})\z")
        return F.coalesce(~found if out else found, F.lit(False))

    def is_length(term) -> bool:
        return isinstance(term, tree.Range) and (term.open or bool(term.unit))

    def test(item: tree.Pair) -> Column:
        if item.mark == "&&&":
            return (a == b) & inside(a, item.left)
        if item.mark:
            both = (inside(a, item.left) & inside(b, item.right)) | (inside(a, item.right) & inside(b, item.left))
            return both if item.mark == "&&" else (a != b) & both
        if item.left and all(isinstance(t, tree.Name) and t.kind == "regex" and "&" in t.text for t in item.left):
            return any_of(map(of_names, item.left))
        if length is not None and item.left and all(map(is_length, item.left)):
            # the ends of a length count
            return any_of(within(length, tree.Range(t.low, t.high), scale_of(t.unit, METRES)) for t in item.left)
        either = inside(a, item.left) | inside(b, item.left)
        return (a != b) & either if alone_is_cross else either

    out = None
    for item in tree.pairs(text):
        found = ~test(item) if item.negated else test(item)
        out = found if out is None else out & found if item.negated else out | found
    return F.lit(False) if out is None else out


def channel_mask(frequencies: list[float], channels: tuple[tree.Range, ...] | None) -> list[bool]:
    """Which channels of a window a list of ranges means."""
    n = len(frequencies)
    if channels is None:
        return [True] * n
    out = [False] * n
    for r in channels:
        if r.unit:
            scale = scale_of(r.unit, HERTZ)
            low, high = (float("-inf") if r.low is None else r.low * scale), (float("inf") if r.high is None else r.high * scale)
            hit = [low <= f <= high for f in frequencies]
        else:
            first = 0 if r.low is None else int(r.low) + r.strict
            last = n - 1 if r.high is None else min(n - 1, int(r.high) - r.strict * r.open)
            hit = [first <= i <= last and (i - first) % r.step == 0 for i in range(n)]
        out = [x or y for x, y in zip(out, hit, strict=True)]
    return out


class Selections:
    """Resolves ``mscal.<name>('...')`` for a main table whose dimension tables are given by name; MAIN is that table itself."""

    def __init__(self, tables: dict[str, Table]):
        self.tables, self._names = tables, {}

    def table(self, name: str, why: str) -> Table:
        if name not in self.tables:
            raise LanguageError(f"{why} needs the table {name}")
        return self.tables[name]

    def names(self, table: str | None, column: str | None = "NAME") -> Names:
        if table is None:
            return Names()
        if (table, column) not in self._names:
            self._names[table, column] = Names.of(self.tables.get(table), column)
        return self._names[table, column]

    def __call__(self, name: str, args: list, ctx) -> Value | None:
        space, _, what = name.partition(".")
        if space != "mscal":
            return None
        if what == "stokes":
            return self.stokes(args, ctx)
        if what in ("uvwwvl", "uvwwvls"):
            if args:
                raise LanguageError(f"{name} takes no arguments")
            return self.wavelengths(each=what == "uvwwvls")
        if len(args) != 1 or args[0][0] != "lit" or not isinstance(args[0][1], str):
            raise LanguageError(f"{name} takes one text")
        text = args[0][1]
        if what in BY_ID:
            column, table, of = BY_ID[what]
            return Value(self.names(table, of).any_of(F.col(column), tree.ids(text)), "bool")
        make = {"baseline": self.baseline, "feed": self.feed, "uvdist": self.uvdist, "spw": self.spw, "chan": self.chan, "corr": self.corr, "time": self.time}.get(what)
        if make is None:
            raise LanguageError(f"no function {name!r}")
        return make(text)

    def baseline(self, text: str) -> Value:
        return Value(pairs(F.col("ANTENNA1"), F.col("ANTENNA2"), text, self.names("ANTENNA"), length=self._length()), "bool")

    def feed(self, text: str) -> Value:
        return Value(pairs(F.col("FEED1"), F.col("FEED2"), text, Names(), alone_is_cross=False), "bool")

    def _length(self) -> Column | None:
        """The distance between the two antennas, from their positions as a literal."""
        t = self.tables.get("ANTENNA")
        if t is None or "POSITION" not in t.columns:
            return None
        at = F.array(*(F.array(*(F.lit(float(x)) for x in r["POSITION"])) for r in small_rows(t, "POSITION")))
        apart = F.zip_with(F.get(at, F.col("ANTENNA1")), F.get(at, F.col("ANTENNA2")), lambda p, q: (p - q) * (p - q))
        return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x))

    def uvdist(self, text: str) -> Value:
        """The length of the first two coordinates, in metres or wavelengths of the window's reference frequency."""
        ranges = tree.lengths(text)
        waves = {r.unit.lower() in WAVES for r, _ in ranges}
        if len(waves) > 1:
            raise LanguageError("metres and wavelengths in one selection")
        d = F.hypot(*(F.get(F.col("UVW"), F.lit(k)).cast("double") for k in (0, 1)))
        if waves == {True}:
            d = d * self._reference_frequency() / C_LIGHT
        units = WAVES if waves == {True} else METRES
        # ends count
        return Value(any_of(within(d, tree.Range(r.low, r.high), scale_of(r.unit, units), share) for r, share in ranges), "bool")

    def _windows_of_rows(self, why: str) -> Column:
        """The window of a row, through its data description."""
        rows = small_rows(self.table("DATA_DESCRIPTION", why), "SPECTRAL_WINDOW_ID")
        return F.get(F.array(*(F.lit(int(r["SPECTRAL_WINDOW_ID"])) for r in rows)), F.col("DATA_DESC_ID"))

    def _reference_frequency(self) -> Column:
        window = self._windows_of_rows("a length in wavelengths")
        rows = small_rows(self.table("SPECTRAL_WINDOW", "a length in wavelengths"), "REF_FREQUENCY")
        return F.get(F.array(*(F.lit(float(r["REF_FREQUENCY"])) for r in rows)), window)

    def _masks(self, text: str) -> list[list[bool]]:
        """The channels that a selection means, by window."""
        t = self.table("SPECTRAL_WINDOW", "a selection of channels")
        names = self.names("SPECTRAL_WINDOW")
        meant = []
        for w in tree.windows(text):
            (term,) = w.ids
            found = set(names.matching(term)) if isinstance(term, tree.Name) else None
            meant.append((term, found, w.channels))
        out = []
        for r in small_rows(t, "CHAN_FREQ"):
            frequencies = [float(x) for x in r["CHAN_FREQ"]]
            mask = [False] * len(frequencies)
            for term, found, channels in meant:
                if r["i"] in found if found is not None else _holds(term, r["i"], names):
                    mask = [x or y for x, y in zip(mask, channel_mask(frequencies, channels), strict=True)]
            out.append(mask)
        return out

    def spw(self, text: str) -> Value:
        window = self._windows_of_rows("spw")
        if ":" not in text:
            return Value(self.names("SPECTRAL_WINDOW").any_of(window, tree.ids(text)), "bool")
        good = [i for i, mask in enumerate(self._masks(text)) if any(mask)]
        return Value(window.isin(*good) if good else F.lit(False), "bool")

    def chan(self, text: str) -> Value:
        masks = self._masks(text)
        each = F.array(*(F.array(*(F.lit(x) for x in mask)).cast("array<boolean>") for mask in masks))
        return Value(F.get(each, self._windows_of_rows("chan")), "bool", 1)

    def stokes(self, args: list, ctx) -> Value:
        """Cells of products as other products; the first polarisation setup says what they are."""
        kinds = [str, bool]
        if not 1 <= len(args) <= 3 or any(a[0] != "lit" or not isinstance(a[1], k) for a, k in zip(args[1:], kinds, strict=False)):
            raise LanguageError("mscal.stokes takes a cell, a text of products and whether to rescale")
        setups = small_rows(self.table("POLARIZATION", "mscal.stokes"), "CORR_TYPE")
        if not setups:
            raise LanguageError("there is no polarisation setup")
        return polarisation.stokes(lower(args[0], ctx), [int(x) for x in setups[0]["CORR_TYPE"]], *(a[1] for a in args[1:]))

    def wavelengths(self, each: bool) -> Value:
        """The coordinates in wavelengths of the window's reference frequency, or of each of its channels."""
        uvw = F.col("UVW").cast("array<double>")
        if not each:
            per_metre = self._reference_frequency() / C_LIGHT
            return Value(F.transform(uvw, lambda x: x * per_metre), "float", 1)
        rows = small_rows(self.table("SPECTRAL_WINDOW", "lengths in wavelengths"), "CHAN_FREQ")
        all_windows = F.array(*(F.array(*(F.lit(float(x) / C_LIGHT) for x in r["CHAN_FREQ"])).cast("array<double>") for r in rows))
        window = F.get(all_windows, self._windows_of_rows("lengths in wavelengths"))
        return Value(F.flatten(F.transform(window, lambda f: F.transform(uvw, lambda x: x * f))), "float", 2, F.array(F.lit(3), F.size(window)))

    def corr(self, text: str) -> Value:
        """Rows whose polarisation setup has one of the products."""
        wanted = set()
        for term in tree.ids(text):
            if isinstance(term, tree.Name) and term.text.upper() in PRODUCTS:
                wanted.add(PRODUCTS.index(term.text.upper()) + 1)
            elif isinstance(term, tree.Range) and term.low == term.high:
                wanted.add(int(term.low))
            else:
                raise LanguageError(f"{text!r} is no list of polarisation products")
        if not wanted:
            raise LanguageError("no polarisation product")
        good = {r["i"] for r in small_rows(self.table("POLARIZATION", "corr"), "CORR_TYPE") if wanted & set(r["CORR_TYPE"])}
        setups = small_rows(self.table("DATA_DESCRIPTION", "corr"), "POLARIZATION_ID")
        rows = [r["i"] for r in setups if r["POLARIZATION_ID"] in good]
        return Value(F.col("DATA_DESC_ID").isin(*rows) if rows else F.lit(False), "bool")

    def time(self, text: str) -> Value:
        """Times; what a calendar time leaves out is that of the first row that isn't flagged, and so is the tolerance."""
        main = self.table("MAIN", "time").df
        has = lambda c: c in main.columns
        exposure = F.col("EXPOSURE").cast("double") if has("EXPOSURE") else F.lit(0.1)
        flag = F.col("FLAG_ROW") if has("FLAG_ROW") else F.lit(False)
        # the smallest (flagged, row): one aggregation, without a sort
        first = main.agg(F.min(F.struct(flag.alias("f"), F.col(ROW).alias("i"), F.col("TIME").cast("double").alias("t"), exposure.alias("e"))).alias("r")).first()["r"]
        if first is None:
            return Value(F.lit(False), "bool")
        at, buffer = first["t"], first["e"] / 2
        c = F.col("TIME").cast("double")
        tests = []
        for r in tree.times(text):
            low = seconds_of(r.first, at)
            high = None if r.second is None else seconds_of(r.second, low if r.kind != "lasting" else 0.0)
            if r.kind == "at":
                tests.append(F.abs(c - low) <= buffer)
            elif r.kind == "within":
                near = buffer if r.buffer is None else r.buffer
                tests.append(((c > low) | (F.abs(c - low) < near)) & ((c < high) | (F.abs(c - high) < near)))
            elif r.kind == "after":
                tests.append(c >= low)
            elif r.kind == "before":
                tests.append(c <= low)
            else:
                tests.append(c.between(low, high if r.kind == "between" else low + high))
        return Value(any_of(tests), "bool")


def _holds(r: tree.Range, i: int, names: Names) -> bool:
    if r.open and i in names.flagged:
        return False
    low = r.low is None or (i > r.low if r.strict else i >= r.low)
    return low and (r.high is None or (i < r.high if r.strict else i <= r.high))


def seconds_of(t: tree.Time, default: float) -> float:
    """Seconds since the epoch of MJD; parts that are left out are those of the default."""
    if t.days is not None:
        return t.days * _DAY
    d = _EPOCH + timedelta(seconds=default)
    given = [x if x is not None else y for x, y in zip(t.parts, (d.year, d.month, d.day, d.hour, d.minute, d.second), strict=True)]
    try:
        day = datetime(*(int(x) for x in given[:5]))
    except ValueError as e:
        raise LanguageError(f"a time is out of range: {e}") from e
    return (day - _EPOCH) / timedelta(seconds=1) + given[5]
