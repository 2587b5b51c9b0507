"""Exact top-k search by term-at-a-time accumulation over blocks.

Components become integers floor(scale * x), so that scores are exact.  A term is a dimension; its postings are
the candidates of a block whose component is not zero.  For a block of queries and one of candidates, each term
scatters weight * posting into a dense array of scores; partition selection keeps k of each query, and a window
merges the blocks.  Blocks are formed where the rows lie and meet by an equi-join over slots, so memory is that
of one pair of blocks and the work is dealt evenly, whatever the ids.

Sums that may leave 64 bits are made with integers of any size, so ranks are exact for any finite components; a
score beyond the range of long is given as the end of that range.

Vectors that are null or hold null or non-finite components take no part, and rows without an id neither.  Vectors
of other lengths, empty ones too, count as filled with zeros.  Rows that share a query's id are not its candidates.
Ties go to the smaller id.  Rows repeated under one id are candidates each; repeated queries of one id share one
list.  An empty table gives an empty result.  Only vec_id and embedding are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import bounded_batches, rows_per_task
from ._vectors import matrix, usable

QUERY_BLOCK, CANDIDATE_BLOCK = 128, 2048


def _blocks(rows: DataFrame, size: int, scale: int, prefix: str) -> DataFrame:
    """Rows (ids, values, width) of at most size vectors each, ids ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column("vec_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                values = np.floor(matrix(part.column("embedding")) * scale)[order]
                largest = np.abs(values).max(initial=0)
                if not np.isfinite(largest):
                    raise ValueError("scale * component is beyond the range of double")
                # large doubles are integers already
                kind = "<i2" if largest < 1 << 15 else "<i8" if largest < 1 << 62 else "<f8"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[order].tobytes()], pa.binary()), pa.array([values.astype(kind).tobytes()], pa.binary()), pa.array([kind])],
                    names=[f"{prefix}_ids", f"{prefix}_values", f"{prefix}_kind"],
                )

    return rows.mapInArrow(run, f"{prefix}_ids binary, {prefix}_values binary, {prefix}_kind string")


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all queries against all candidates, one term after the other."""
    terms = min(queries.shape[1], candidates.shape[1])
    largest = [int(np.abs(x.astype(np.float64)).max(initial=0)) + 1 for x in (queries, candidates)]
    bound = 2 * terms * largest[0] * largest[1]
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    q, c = _integers(queries, kind), np.ascontiguousarray(_integers(candidates, kind).T)
    scores = np.zeros((len(q), candidates.shape[0]), kind)
    for t in range(terms):
        weights, postings = q[:, t], c[t]
        rows, docs = np.flatnonzero(weights), np.flatnonzero(postings)
        if len(rows) == len(weights) and len(docs) * 2 > len(postings):
            scores += weights[:, None] * postings
        elif len(rows) and len(docs):
            scores[np.ix_(rows, docs)] += weights[rows, None] * postings[docs]
    return scores if kind is object else scores.astype(np.int64)


def _integers(x: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers as integers of a kind; object: of any size."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape) if kind is object else x.astype(kind)


def as_long(scores: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Scores within the range of long; and for those at its ends the whole number, as bytes in its order."""
    if scores.dtype != object:
        return scores, [None] * len(scores)
    low, high = -(1 << 63), (1 << 63) - 1
    beyond = [None if low < v < high else (int(v) + (1 << 2399)).to_bytes(300, "big") for v in scores]
    return np.array([min(max(int(v), low), high) for v in scores], np.int64), beyond


def select(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row; own entries are out, ties go to the smaller column."""
    n = scores.shape[1]
    row, column = [], []
    for i, s in enumerate(scores):
        at = np.flatnonzero(~own[i])
        if len(at) > k:
            v = s[at]
            least = np.partition(v, len(v) - k)[len(v) - k]
            above, equal = at[v > least], at[v == least]
            at = np.concatenate([above, equal[: k - len(above)]])
        row.append(np.full(len(at), i))
        column.append(at)
    return (np.concatenate(row), np.concatenate(column)) if n and len(scores) else (np.zeros(0, int), np.zeros(0, int))


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, embedding) that is_query marks, against all rows."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding").where(usable() & F.col("vec_id").isNotNull())
    slots = rows_per_task(vectors)
    queries = _blocks(rows.where(is_query), QUERY_BLOCK, scale, "q").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    candidates = _blocks(rows, CANDIDATE_BLOCK, scale, "c").withColumn("slot", F.pmod(F.xxhash64("c_ids"), F.lit(slots)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, values = {}, {}
                for p in "qc":
                    ids[p] = np.frombuffer(batch.column(f"{p}_ids")[i].as_buffer(), np.int64)
                    flat = np.frombuffer(batch.column(f"{p}_values")[i].as_buffer(), batch.column(f"{p}_kind")[i].as_py())
                    values[p] = flat.reshape(len(ids[p]), -1) if len(flat) else np.zeros((len(ids[p]), 0), np.int64)
                scores = accumulate(values["q"], values["c"])
                row, column = select(scores, ids["q"][:, None] == ids["c"], k)
                score, beyond = as_long(scores[row, column])
                yield pa.RecordBatch.from_arrays([pa.array(ids["q"][row]), pa.array(ids["c"][column]), pa.array(score, pa.int64()), pa.array(beyond, pa.binary())], names=["query_id", "vec_id", "score", "beyond"])

    found = queries.join(candidates.hint("shuffle_hash"), "slot").drop("slot").mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
