"""Vectorised text primitives: words, word hashes and rolling windows over Arrow batches.

A word is a maximal run of bytes other than space and U+0009..U+000D.  All loops run in Arrow or numpy; Python
never touches single words.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at once: this bounds the temporary arrays of a Python worker.
CHUNK_BYTES = 4 << 20
#: Bytes of strings that are hashed at once.
HASH_BYTES = 1 << 19

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..base**(n-1) and their inverses, modulo 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())

        def run(b: int) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        got = _POWERS[base] = (run(base), run(pow(base, -1, 1 << 64)))
    return got


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _B1) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] for every i, by prefix sums of values * base**position."""
    n = len(values)
    power, inverse = _powers(base, n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def hash_strings(strings: pa.Array, base: int = _B1) -> np.ndarray:
    """A 64-bit hash of the bytes of every string (no nulls)."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    strings = strings.cast(pa.large_binary()) if not pa.types.is_large_binary(strings.type) else strings
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    out = np.empty(len(strings), np.uint64)
    # some strings at once, so that neither the powers nor the copies of the bytes grow with the batch
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(at, at[first] + HASH_BYTES, "right")) - 1)
        some = flat[at[first] : at[last]].astype(np.uint64) + np.uint64(1)
        here = at[first : last + 1] - at[first]
        out[first:last] = mix(rolling(some, here[:-1], here[1:], base) + np.diff(here).astype(np.uint64))
        first = last
    return out


class Words:
    """The words of a chunk of texts: ``codes`` index ``vocab``; text i has codes[starts[i]:starts[i+1]]."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        starts = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values[starts[0] : starts[-1]] if len(lists) else pa.array([], pa.string())
        starts = starts - starts[0] if len(starts) else np.zeros(1, np.int64)
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        if not full.all():
            flat = flat.filter(pa.array(full))
            starts = np.concatenate([[0], np.cumsum(full)])[starts]
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.vocab = coded.dictionary
        self.starts = starts
        self.lengths = np.diff(starts)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def hashes(self, base: int = _B1) -> np.ndarray:
        return hash_strings(self.vocab, base)[self.codes]

    def window_starts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat starts of all windows of so many words that lie within one text, and the number by text."""
        counts = np.maximum(self.lengths - width + 1, 0)
        first = np.repeat(self.starts[:-1] - (np.cumsum(counts) - counts), counts)
        return first + np.arange(counts.sum()), counts


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; one text is never cut."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes.astype(np.int64)) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives the memory that it has freed back to the machine: it may idle for long."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def add_columns(
    docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], fields: list[T.StructField], text: str = "text"
) -> DataFrame:
    """docs with further columns, computed a chunk at a time where the rows lie (no shuffle).

    make() runs once in each task and returns the function of a chunk.  An input column with the name of a new
    one gives way to it.
    """
    bounded_batches(docs.sparkSession)
    new = {f.name for f in fields}
    kept = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for part in chunks(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *of(part)], names=[*names, *(f.name for f in fields)])

    # the text goes to the worker even where a new column replaces it
    return docs.mapInArrow(returning(run), T.StructType([*kept, *fields]))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def shared_folder(spark) -> str:
    """A new folder in the one that driver and executors share: spark.checkpoint.dir.

    Only where all tasks run on the driver's machine a temporary folder stands in for a setting that is missing.
    """
    import tempfile
    import uuid

    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{set_to.rstrip('/')}/cubeleaf-{uuid.uuid4().hex}"


#: Spark's own setting for the end of an execution: its shuffles go at once, not with the next garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in the shared folder that an operator drops once its result no longer needs them."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        """df, computed once and read from Parquet: its lineage ends there, and the shuffles behind it go."""
        path = shared_folder(self.spark)
        self.paths.append(path)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes all tables written so far."""
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


#: What results are read from: it has to stay as long as they may be used, and goes when the driver ends.
_RESULTS: list[Scratch] = []


def lasting(scratch: Scratch, df: DataFrame) -> DataFrame:
    """df, whose tables stay until the driver ends."""
    if not _RESULTS:
        atexit.register(_drop_results)
    _RESULTS.append(scratch)
    return df


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read from Parquet in the shared folder until the driver ends."""
    scratch = Scratch(df.sparkSession)
    return lasting(scratch, scratch.write(df))


def _drop_results() -> None:
    for x in _RESULTS:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            x.drop()


def rows_per_task(df: DataFrame) -> int:
    """Number of partitions to deal rows to: that of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark, limit: str = "16m") -> None:
    """Bounds the Arrow batches that go to Python by bytes too, not only by rows, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
        spark.conf.set(key, limit)
