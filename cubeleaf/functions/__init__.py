"""The function library: names to typed columns."""

from __future__ import annotations

from ..plans.parser import LanguageError
from ..plans.values import Value
from . import aggregates, angles, arrays, dates, doppler, frames, scalar, strings, windows

TABLE: dict[str, tuple[int, int, object]] = {}
for _m in (scalar, strings, arrays, windows, dates, angles, frames):
    TABLE.update(_m.FUNCTIONS)


def call(ctx, name: str, args: list) -> Value:
    """The value of a function call; names are matched without case."""
    name = name.lower()
    if name in aggregates.NAMES:
        return aggregates.call(ctx, name, args)
    if name.startswith("meas.doppler") or name in doppler.NAMES:
        return doppler.call(ctx, name, args)
    if name not in TABLE:
        if ctx.resolve is not None and (found := ctx.resolve(name, args, ctx)) is not None:
            return found
        raise LanguageError(f"no function {name!r}")
    least, most, f = TABLE[name]
    if not least <= len(args) <= most:
        raise LanguageError(f"{name} takes {least} to {most} arguments, not {len(args)}")
    return f(ctx, *args) if getattr(f, "raw", False) else f(*(_lower(a, ctx) for a in args))


def _lower(tree, ctx) -> Value:
    from ..plans.lower import lower

    return lower(tree, ctx)
