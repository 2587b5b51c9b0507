"""Streaming over sorted partitions: which rows share their key with another, in memory bounded by a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def shared_keys(batches: Iterator[pa.RecordBatch], keys: list[str], out: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by keys, the out columns of those whose keys occur on two rows or more."""
    held: dict[str, np.ndarray] | None = None  # the last row so far, not yet given out
    last: list | None = None  # its keys, whether given out or not
    names = list(dict.fromkeys([*keys, *out]))
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: _column(batch, n) for n in names}
        same = np.ones(batch.num_rows - 1, bool)
        for k in keys:
            same &= cols[k][1:] == cols[k][:-1]
        joins_last = last is not None and all(cols[k][0] == v for k, v in zip(keys, last, strict=True))
        shared = np.zeros(batch.num_rows, bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= joins_last
        if held is not None and joins_last:
            yield pa.RecordBatch.from_arrays([pa.array(held[n]) for n in out], names=out)
        if shared.any():
            yield pa.RecordBatch.from_arrays([pa.array(cols[n][shared]) for n in out], names=out)
        last = [cols[k][-1] for k in keys]
        held = None if shared[-1] else {n: cols[n][-1:] for n in out}


def later_rows(batches: Iterator[pa.RecordBatch], keys: list[str], start: list[str], out: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by keys and then start, the out columns of those whose start differs from their key's first."""
    first: tuple | None = None  # keys and start of the run that is still open
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = {c: _column(batch, c) for c in dict.fromkeys([*keys, *start, *out])}
        opens = np.ones(n, bool)
        opens[1:] = False
        for k in keys:
            opens[1:] |= cols[k][1:] != cols[k][:-1]
        goes_on = first is not None and all(cols[k][0] == v for k, v in zip(keys, first[0], strict=True))
        at = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        later = np.zeros(n, bool)
        for c in start:
            later |= cols[c] != cols[c][at]
        if goes_on:
            ends = int(np.argmax(opens[1:])) + 1 if opens[1:].any() else n
            later[:ends] = False
            for c, v in zip(start, first[1], strict=True):
                later[:ends] |= cols[c][:ends] != v
        if later.any():
            yield pa.RecordBatch.from_arrays([pa.array(cols[c][later]) for c in out], names=out)
        if not (goes_on and not opens[1:].any()):
            first = ([cols[k][-1] for k in keys], [cols[c][at[-1]] for c in start])
