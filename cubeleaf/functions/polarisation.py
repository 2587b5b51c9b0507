"""``mscal.stokes``: polarisation products of one frame as those of another, channel by channel.

Each frame's products give I, Q, U and V by a matrix of its own; that matrix times its conjugate is twice the identity,
so half the conjugate leads back.  What leads from one frame to another is a literal of the plan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.parser import LanguageError
from ..plans.values import Value, complex_of, to_float

#: Names of polarisation products, numbered from 1.
PRODUCTS = (
    "I Q U V RR RL LR LL XX XY YX YY RX RY LX LY XR XL YR YL PP PQ QP QQ "
    "RCIRCULAR LCIRCULAR LINEAR PTOTAL PLINEAR PFTOTAL PFLINEAR PANGLE"
).split()
#: Lists that have a name.
LISTS = {"IQUV": "I,Q,U,V", "STOKES": "I,Q,U,V", "CIRC": "RR,RL,LR,LL", "CIRCULAR": "RR,RL,LR,LL", "LIN": "XX,XY,YX,YY", "LINEAR": "XX,XY,YX,YY"}
#: I, Q, U and V (rows) of the products 1 to 4, 5 to 8 and 9 to 12.
TO_STOKES = (
    np.eye(4, dtype=complex),
    np.array([[1, 0, 0, 1], [0, 1, 1, 0], [0, -1j, 1j, 0], [1, 0, 0, -1]]),
    np.array([[1, 0, 0, 1], [1, 0, 0, -1], [0, 1, 1, 0], [0, -1j, 1j, 0]]),
)
#: Derived quantities of the polarised part.
DERIVED = ("PTOTAL", "PLINEAR", "PFTOTAL", "PFLINEAR", "PANGLE")


def outputs_of(text: str) -> list[str]:
    names = [n for n in (x.strip() for x in LISTS.get(text.strip().upper(), text).upper().split(",")) if n]
    for n in names:
        if n not in DERIVED and n not in PRODUCTS[:12]:
            raise LanguageError(f"no conversion to the polarisation {n!r}")
    if not names:
        raise LanguageError("no polarisation product")
    return names


def _place(code: int) -> tuple[int, int]:
    """The frame of a product, and its place there."""
    if not 1 <= code <= 12:
        raise LanguageError(f"no conversion of the polarisation product {code}")
    return divmod(code - 1, 4)


def stokes_rows(inputs: list[int], rescale: bool) -> np.ndarray:
    """I, Q, U and V as combinations of the inputs; rescaled, a product counts half."""
    places = [_place(c) for c in inputs]
    if len({frame for frame, _ in places}) != 1:
        raise LanguageError("the polarisation products are not those of one frame")
    frame = places[0][0]
    return TO_STOKES[frame][:, [k for _, k in places]] * (0.5 if rescale and frame else 1.0)


def conversion(inputs: list[int], names: list[str], rescale: bool) -> np.ndarray:
    """The outputs as combinations of the inputs; rows of derived quantities are zero."""
    stokes = stokes_rows(inputs, rescale)
    out = np.zeros((len(names), len(inputs)), complex)
    for row, name in zip(out, names, strict=True):
        if name not in DERIVED:
            frame, k = _place(PRODUCTS.index(name) + 1)
            back = TO_STOKES[frame].conj().T / 2 if frame else TO_STOKES[0]
            row[:] = back[k] @ stokes / (0.5 if rescale and frame else 1.0)
    return out


def _combined(row: np.ndarray, x: list[Column]) -> Column:
    """Zero coefficients count too, so that NaN stays visible."""
    re = sum((v["re"] * float(c.real) - v["im"] * float(c.imag) for c, v in zip(row, x, strict=True)), F.lit(0.0))
    im = sum((v["im"] * float(c.real) + v["re"] * float(c.imag) for c, v in zip(row, x, strict=True)), F.lit(0.0))
    return complex_of(re, im)


def _derived(name: str, stokes: list[Column]) -> Column:
    i, q, u, v = stokes
    if name == "PANGLE":
        return F.atan2(u["re"], q["re"]) * 0.5
    power = lambda z: z["re"] * z["re"] + z["im"] * z["im"]
    polarised = F.sqrt(power(q) + power(u) + power(v) if name in ("PTOTAL", "PFTOTAL") else power(q) + power(u))
    return F.when(power(i) == 0, F.lit(0.0)).otherwise(polarised / F.sqrt(power(i))) if name.startswith("PF") else polarised


def stokes(v: Value, inputs: list[int], text: str = "IQUV", rescale: bool = False) -> Value:
    """Products of the cells of v, (products, channels) or the products of one channel.

    Complex cells are visibilities.  A flag is set if one that its product is made of is.  Numbers are weights: of a
    product, the inverse of the variances' sum; a channel with a weight of 0 gives 0.
    """
    names = outputs_of(text)
    if not v.is_array or v.type not in ("complex", "bool", "int", "float"):
        raise LanguageError("mscal.stokes needs cells of visibilities, flags or weights")
    if v.mask is not None:
        raise LanguageError("mscal.stokes takes no masked cells: mask what it gives")
    if v.type != "complex" and any(n in DERIVED for n in names):
        raise LanguageError("derived polarisations need visibilities")
    n, rows, to_iquv = len(inputs), conversion(inputs, names, rescale), stokes_rows(inputs, rescale)

    def of_channel(x: list[Column]) -> list[Column]:
        if v.type == "complex":
            iquv = [_combined(r, x) for r in to_iquv]
            return [complex_of(_derived(name, iquv), F.lit(0.0)) if name in DERIVED else _combined(r, x) for name, r in zip(names, rows, strict=True)]
        if v.type == "bool":
            return [_any([f for f, c in zip(x, r, strict=True) if c]) for r in rows]
        out = []
        for r in rows:
            total = sum((F.lit(float(abs(c)) ** 2) / w for w, c in zip(x, r, strict=True)), F.lit(0.0))
            zero = _any([w == 0 for w in x])
            out.append(F.when(zero, F.lit(0.0)).when(total == 0, F.lit(0.0)).otherwise(F.lit(1.0) / total))
        return out

    flat = (v if v.type in ("complex", "bool") else to_float(v)).col

    def of_cell(cell: Column) -> Column:
        channels = (F.size(cell) / n).cast("int")
        numbers = F.when(channels > 0, F.sequence(F.lit(0), channels - 1)).otherwise(F.array().cast("array<int>"))
        each = F.transform(numbers, lambda k: F.array(*of_channel([F.get(cell, k * n + j) for j in range(n)])))
        fits = F.size(cell) % n == 0 if v.shape is None else F.get(v.shape, F.lit(0)) == n
        return F.when(~fits, F.raise_error(F.lit(f"mscal.stokes: the cell does not hold {n} products"))).otherwise(F.flatten(each))

    # the cell is bound once: in a lambda its expression would run again for every channel
    out = F.when(flat.isNotNull(), F.get(F.transform(F.array(flat), of_cell), F.lit(0)))
    kind = v.type if v.type in ("complex", "bool") else "float"
    if v.shape is None:
        return Value(out, kind, 1)
    return Value(out, kind, 2, F.array(F.lit(len(names)), F.get(v.shape, F.lit(1))))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
