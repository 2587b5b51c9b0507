"""Connected components of an edge table.

Each partition of at most ``LOCAL_EDGES`` edges is contracted where it lies: its components become stars.  If that
was all of them the stars are the answer.  Otherwise large-star and small-star steps alternate over the stars:
each round is a few joins and aggregations over edges, written to the shared folder, and neither labels nor
groups are ever gathered on one machine.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Scratch


#: Edges that one task contracts: 16 bytes each.
LOCAL_EDGES = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of every node that isn't the smallest itself."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for x in (i, j, label[i], label[j]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        u, v = np.concatenate([u, batch.column("u").to_numpy()]), np.concatenate([v, batch.column("v").to_numpy()])
        if len(u) > 2 * LOCAL_EDGES:  # more than a partition should hold: give stars out as edges
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], names=["u", "v"])
            u, v = u[:0], v[:0]
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], names=["u", "v"])


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, owner: Scratch) -> DataFrame:
    """(node, component) for every node of edges (u, v), a table of owner's; component is the smallest node reached."""
    scratch = Scratch(edges.sparkSession)
    e = scratch.write(edges.where(F.col("u") != F.col("v")).select("u", "v"))
    n = e.count()
    parts = -(-n // LOCAL_EDGES)
    if parts <= 1:
        e = scratch.write(e.coalesce(1).mapInArrow(_contract, "u long, v long"))
        return _result(e, scratch, owner)
    e = scratch.write(e.repartition(parts).mapInArrow(_contract, "u long, v long").distinct())
    before = _state(e)
    while before[0]:
        # large star: the larger neighbours of a node go to its smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large)
        # small star: the smaller neighbours of a node, and itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        done, scratch = scratch, Scratch(edges.sparkSession)
        e = scratch.write(small.where(F.col("u") != F.col("v")).distinct())
        done.drop()
        now = _state(e)
        if now == before:
            break
        before = now
    return _result(e, scratch, owner)


def _result(stars_: DataFrame, scratch: Scratch, owner: Scratch) -> DataFrame:
    roots = stars_.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = owner.write(stars_.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
    scratch.drop()
    return out
