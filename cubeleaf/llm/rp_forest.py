"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Each tree splits recursively by a random direction at the median of its sample; rows near the split go to both
sides.  The trees are fitted on a bounded sample (``sample_rows`` distinct vectors, those with the smallest hash
of id) and every row is routed through them.  Within a leaf all cosines are computed in double precision and the
pairs at or above the threshold are linked, so no false link appears.

Groups too dense for the trees, which would split them again and again, have hubs: sample vectors with half a leaf of
others within the threshold.  The rows within the threshold of a hub are its core.  By the triangle inequality all
that they link with lies within twice the angle of the hub; so the core is compared with these rows, which finds its
links exactly, and takes no part in the trees.  A pair is missed only if neither row is in a core and no tree puts it
into one leaf.

Equal vectors form a class that is routed once and counts with its size.  A leaf with more rows than ``block``
is dealt over pairs of blocks, so the memory of a task is that of two blocks however many near copies share a
leaf.  A pair that several leaves find counts in the smallest of them, which both rows' leaf lists tell; so link
counts are summed and spanning edges given out where the leaf is, and pairs are never shuffled.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and rows without an id
neither; shorter vectors count as filled with zeros.  Components may be floats or doubles; cosines are computed in
doubles.  Rows repeated under one id count as vectors each.  A cosine equal to the threshold links; of the ids that
tie for a component the smallest names it.  An empty table gives an empty result.  Only vec_id and embedding are
read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._text import Scratch, bounded_batches, written
from ._vectors import matrix, usable


@dataclass(frozen=True)
class Forest:
    """Trees as heaps: node i has the children 2 i + 1 and 2 i + 2; each node a direction and two limits."""

    depth: int
    width: int
    directions: np.ndarray  # trees x nodes x width
    low: np.ndarray  # rows with a projection above low go right too
    high: np.ndarray  # rows with a projection below high go left too

    @property
    def trees(self) -> int:
        return len(self.directions)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row reaches; leaves are numbered over all trees."""
        rows, leaves = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", x[row], self.directions[t][node])
                left, right = p < self.high[t][node], p > self.low[t][node]
                right |= ~left
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows.append(row)
            leaves.append(node - ((1 << self.depth) - 1) + (t << self.depth))
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def grow(sample: np.ndarray, rows: int, *, trees: int, leaf_rows: int, spill: float, seed: int) -> Forest:
    """Trees over unit vectors, so deep that rows / 2**depth is about leaf_rows and each leaf has 16 of the sample."""
    n, width = sample.shape
    depth = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf_rows)))) if rows else 0
    depth = min(depth, max(0, int(np.log2(max(n, 1) / 16))) if n >= 16 else 0)
    nodes = max(1, (1 << depth) - 1)
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, nodes, width)).astype(np.float32)
    low, high = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        at = {0: np.arange(n)}
        for node in range((1 << depth) - 1):
            rows_here = at.pop(node)
            p = sample[rows_here] @ directions[t, node].astype(np.float64)
            low[t, node], middle, high[t, node] = np.quantile(p, [0.5 - spill / 2, 0.5, 0.5 + spill / 2]) if len(p) else (0, 0, 0)
            at[2 * node + 1], at[2 * node + 2] = rows_here[p < middle], rows_here[p >= middle]
    return Forest(depth, width, directions, low, high)


def hubs_of(sample: np.ndarray, need: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(sample rows that are hubs, whether a row of the sample is in no core): the densest first, each with need rows at least that no earlier hub has."""
    x = sample.astype(np.float32)
    rest, hubs = np.ones(len(x), bool), []

    def near(rows: np.ndarray) -> np.ndarray:
        """For every row of the sample, how many of these rows are near."""
        out = np.zeros(len(x), np.int64)
        for at in range(0, len(rows), 512):
            out += (x @ x[rows[at : at + 512]].T >= threshold).sum(axis=1)
        return out

    degree = near(np.arange(len(x)))
    while rest.any():
        hub = int(np.where(rest, degree, -1).argmax())
        if degree[hub] < need:
            break
        core = rest & (x @ x[hub] >= threshold)
        core[hub] = True
        degree -= near(np.flatnonzero(core))
        rest &= ~core
        hubs.append(hub)
    return np.array(hubs, np.int64), rest


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of unit vectors whose cosine reaches the threshold; within one block each pair once."""
    out_i, out_j = [], []
    for at in range(0, len(left), 512):
        i, j = np.nonzero(left[at : at + 512] @ right.T >= threshold)
        i += at
        keep = i < j if same else np.ones(len(i), bool)
        out_i.append(i[keep])
        out_j.append(j[keep])
    return np.concatenate(out_i), np.concatenate(out_j)


def first_common(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether leaf is the smallest leaf that both rows have (leaf lists padded with -1)."""
    earlier = np.zeros(len(a), bool)
    for c in range(a.shape[1]):
        x = a[:, c : c + 1]
        earlier |= ((x == b) & (x >= 0) & (x < leaf)).any(axis=1)
    return ~earlier


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _padded(column: pa.Array) -> np.ndarray:
    """Integer lists as rows padded with -1."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    flat = column.values[offsets[0] : offsets[-1]].to_numpy()
    out = np.full((len(sizes), int(sizes.max(initial=1))), -1, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def near_duplicates(
    vectors: DataFrame, *, threshold: float = 0.9, trees: int = 8, leaf_rows: int = 1024, block: int = 2048, spill: float = 0.16, sample_rows: int = 16384, seed: int = 7
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select("vec_id", "embedding")
    nonzero = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = usable() & nonzero & F.col("vec_id").isNotNull()
    valid = rows.where(good)
    scratch = Scratch(spark)
    classes = scratch.write(valid.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size")))
    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    width = shape["width"] or 0
    # at most 8 million numbers
    most = max(16, min(sample_rows, (8 << 20) // max(width, 1)))
    picked = classes.orderBy(F.xxhash64("node"), "node").limit(most).select("node", "embedding").toArrow()
    sample = matrix(picked["embedding"].combine_chunks(), width) if picked.num_rows else np.zeros((0, width))
    sample = _unit(sample[np.argsort(picked["node"].to_numpy())]) if len(sample) else sample
    n = shape["n"]
    # one leaf needs no hubs
    hubs, rest = hubs_of(sample, max(8, leaf_rows * len(sample) // (2 * n)), threshold) if n > leaf_rows else (np.zeros(0, np.int64), np.ones(len(sample), bool))
    forest = grow(sample[rest], -(-n * int(rest.sum()) // max(len(sample), 1)), trees=trees, leaf_rows=leaf_rows, spill=spill, seed=seed)
    first_hub = trees << forest.depth  # the leaf of the first hub
    far = np.cos(min(np.pi, 2 * np.arccos(np.clip(threshold, -1, 1)))) - 1e-6
    shared = spark.sparkContext.broadcast((forest, sample[hubs]))  # at most sample_rows / 16 leaves a tree and sample_rows / 8 hubs

    def place(forest: Forest, hubs: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf) for the leaves of trees and hubs, and each row's hub or -1."""
        cosine = x @ hubs.T
        core = np.where((cosine >= threshold).any(axis=1), (cosine >= threshold).argmax(axis=1), -1) if len(hubs) else np.full(len(x), -1)
        outside = np.flatnonzero(core < 0)
        row, leaf = forest.route(x[outside])
        # a pair of two cores meets at the earlier hub
        at, hub = np.nonzero((cosine >= far) & ((core < 0)[:, None] | (np.arange(len(hubs)) <= core[:, None])))
        row, leaf = np.concatenate([outside[row], at]), np.concatenate([leaf, first_hub + hub])
        order = np.lexsort((leaf, row))
        return row[order], leaf[order], core

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_here, hubs_here = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                row, leaf, core = place(trees_here, hubs_here, _unit(matrix(part.column("embedding"), trees_here.width)))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("size"), part.column("embedding"), pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf.astype(np.int32))), pa.array(core.astype(np.int32))], names=["node", "size", "embedding", "leaves", "core"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    routed = scratch.write(classes.select("node", "size", "embedding").mapInArrow(route, f"node long, size long, embedding {kind}, leaves array<int>, core int"))
    # blocks of each leaf: a row for each leaf of the bounded forest and for each hub; what is no core of a hub meets only the core
    inner = (F.col("leaf") < first_hub) | (F.col("leaf") == F.col("core") + first_hub)
    leaves = routed.withColumn("leaf", F.explode("leaves")).withColumn("inner", inner)
    sizes = leaves.groupBy("leaf").agg(*(F.ceil(F.count_if(c) / block).cast("int").alias(name) for name, c in (("inside", F.col("inner")), ("outside", ~F.col("inner")))))
    placed = leaves.join(F.broadcast(sizes.where("inside > 0")), "leaf")
    mine = F.when(F.col("inner"), F.pmod(F.xxhash64("node"), F.col("inside"))).otherwise(F.col("inside") + F.pmod(F.xxhash64("node"), F.greatest("outside", F.lit(1)))).cast("int")
    last = F.when(F.col("inner"), F.col("inside") + F.col("outside")).otherwise(F.col("inside")) - 1
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    placed = placed.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")}).drop("other", "inside", "outside", "inner", "core")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        leaf, x, y = (table[c][0].as_py() for c in ("leaf", "x", "y"))
        node = table["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        table, node = table.take(pa.array(order)).combine_chunks(), node[order]
        size, mine = table["size"].to_numpy(), table["mine"].to_numpy()
        unit = _unit(matrix(table["embedding"].chunk(0), width))
        lists = _padded(table["leaves"].chunk(0))
        left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        i, j = linked(unit[left], unit[right], x == y, threshold)
        i, j = left[i], right[j]
        if leaf >= first_hub:
            once = np.ones(len(i), bool)
        else:
            once = np.concatenate([first_common(lists[i[a : a + 100_000]], lists[j[a : a + 100_000]], leaf) for a in range(0, len(i), 100_000)] or [np.zeros(0, bool)])
        links = np.bincount(i[once], size[j[once]], len(node)) + np.bincount(j[once], size[i[once]], len(node))
        root = _roots(len(node), i, j)
        some = (links > 0) | (root != np.arange(len(node)))
        return pa.table({"node": node[some], "links": links[some].astype(np.int64), "root": node[root[some]]})

    found = scratch.write(placed.groupBy("leaf", "x", "y").applyInArrow(compare, "node long, links long, root long"))
    labels = components(found.where(F.col("node") != F.col("root")).select(F.col("node").alias("u"), F.col("root").alias("v")), scratch)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = classes.join(counts, "node", "left").join(labels, "node", "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    by_class = written(by_class)
    scratch.drop()
    # a merge join, whose large partitions Spark splits: one vector may be that of a third of all rows
    inside = valid.join(by_class.hint("merge"), "embedding").select("vec_id", "n_links", "component_id")
    outside = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
