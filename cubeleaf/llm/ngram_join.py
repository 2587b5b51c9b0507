"""N-gram Jaccard join, size-aware: small sets by fixed-size subsets, large sets by inverted lists.

A document's set is that of its distinct five-word shingles (ASCII lower-cased; fewer words: the whole sequence
as one).  Documents with equal sets form a class; classes are joined, copies are not expanded.

*Small sets* (at most ``boundary`` shingles) emit a key for each subset of the size that a partner must share:
two small sets that link share such a subset.  *Large sets* scan inverted lists: shingles stand in one global
order and any two sets that link share one of the first n - ceil(0.8 n) + 1 shingles of both.  Small sets that may
link with large ones do so too.  Any order is right; this one puts shingles last that a counting sketch of fixed
size shows to be common.  The boundary is where the estimated cost of both is smallest, from the exact sizes of
small sets and the sketch's second moment.

Lists are streamed from sorted partitions.  Candidates come in three rounds, each of which leaves out what the
links so far have joined: neighbours in the order of sizes, which is the same in all lists, so that copies meet the
same few partners everywhere; neighbours in an order of each list's own; and at last all pairs of a list whose
classes still lie in different components, long lists dealt over pairs of blocks.  A candidate whose parity bitmaps
rule a link out is dropped; all others are verified on their whole sets.  So a large group of near copies costs
about its size, and yet no link between components is lost.

Rows that share a doc_id count as one document: whatever one of them links with, all do.  Null ids are not shared
and count as the largest id, their component is null only where no row of it has an id.  Null, empty and blank
texts have an empty set and link with nothing.  Repeated rows are one class.  Texts are never cut; a batch holds
one text at least, however long.  An empty table gives an empty result.  Only doc_id and the text are read, so
columns of other names don't matter.  Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._runs import shared_keys
from ._text import Scratch, Words, bounded_batches, chunks, mix, returning, rolling, rows_per_task, written

NO_ID = (1 << 63) - 1
SKETCH_BITS = 20
_SKETCH_PART = 1 << 14  # counters of one row of the sketch
#: Sizes that may be treated as small; the boundary is chosen among them.
LARGEST_SMALL = 14
#: 64-bit words of a class's bitmap: bit i is the parity of its shingles with hash i, so two bitmaps differ in at
#: most as many bits as the sets differ in shingles, and a pair that differs in too many can't link.
BITMAP_WORDS = 8
_BITMAP = [f"b{i}" for i in range(BITMAP_WORDS)]
#: Bits of the filter that keeps texts without candidates out of the shuffle.
FILTER_BITS = 23
#: Classes that a task remembers, so as not to give them twice.
SEEN = 1 << 17
#: Rows of a list that are compared with each other at once, and of a list whose pairs are named before bitmaps are looked at.
BLOCK, SHORT = 2048, 8
#: Bits for each shingle of a class's long bitmap, at least.
LONG_BITS = 4


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    words = Words(texts, lower=True)
    counts = np.where(words.lengths >= width, words.lengths - width + 1, np.minimum(words.lengths, 1))
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = np.repeat(words.starts[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    ends = np.minimum(starts + width, words.starts[1:][doc])
    hashed = rolling(words.hashes(), starts, ends)
    at = np.concatenate([[0], np.cumsum(counts)]).tolist()
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        x = np.sort(hashed[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if b - a > 1 else x)
    return out


def needed(n: int, percent: int) -> int:
    """The smallest overlap of a set of n with any partner no smaller."""
    return -(-percent * n // 100)


def set_key(x: np.ndarray) -> int:
    """64-bit hash of a set, signed."""
    return int(np.sum(mix(x + np.uint64(len(x))), dtype=np.uint64).astype(np.int64)) if len(x) else 0


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """Sizes of the subsets that a small set of n emits: one for each size a partner may have."""
    return sorted({needed(m, percent) for m in range(n, min(boundary, n * 100 // percent) + 1)})


def _n_subsets(n: int, boundary: int, percent: int) -> int:
    from math import comb

    return sum(comb(n, c) for c in subset_sizes(n, boundary, percent) if c <= n)


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The boundary of smallest cost; sizes: number of sets by size up to LARGEST_SMALL."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            prefix = n - needed(n, percent) + 1
            if n <= boundary:
                total += count * _n_subsets(n, boundary, percent)
            if n > boundary or n * 100 >= percent * (boundary + 1):
                total += count * prefix * list_length
        return total

    return min(range(LARGEST_SMALL + 1), key=lambda b: (cost(b), b))


def keys_of(x: np.ndarray, counts: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """The keys under which a set looks for partners."""
    n = len(x)
    out = []
    if n <= boundary:
        mixed = mix(x)
        for c in subset_sizes(n, boundary, percent):
            if c <= n:
                pick = np.array(list(combinations(range(n), c)))
                out.append(mix(mixed[pick].sum(axis=1, dtype=np.uint64) + np.uint64(c)))
    if n > boundary or n * 100 >= percent * (boundary + 1):
        prefix = n - needed(n, percent) + 1
        level = np.minimum(np.log2(counts[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] + 1.0) * 4, 255).astype(np.uint64)
        ordered = (level << np.uint64(56)) | (mix(x) >> np.uint64(8))
        out.append(np.partition(ordered, prefix - 1)[:prefix] if prefix < n else ordered)
    return np.concatenate(out)


def _sets_and_sketch(docs: DataFrame, text: str) -> DataFrame:
    """Rows of documents (doc, n, key, bitmap), and rows of the sketch (part, counts), from one pass."""
    names = ["doc", "n", "key", *_BITMAP, "part", "counts"]
    types = [pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * BITMAP_WORDS, pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        seen = False
        for batch in batches:
            for part in chunks(batch, text):
                sets = shingle_sets(part.column(text))
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                counts += np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                seen = True
                rows = [part.column("doc"), pa.array([len(x) for x in sets], pa.int32()), pa.array([set_key(x) for x in sets], pa.int64())]
                maps = np.array([bitmap(x) for x in sets], np.int64).reshape(-1, BITMAP_WORDS)
                rows += [pa.array(maps[:, i]) for i in range(BITMAP_WORDS)]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(sets), t) for t in types[-2:])], names=names)
        if seen:
            blocks = counts.reshape(-1, _SKETCH_PART)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(blocks), t) for t in types[:-2]), pa.array(range(len(blocks)), pa.int32()), pa.array([b.astype("<i8").tobytes() for b in blocks], pa.binary())], names=names
            )

    maps = ", ".join(f"{b} long" for b in _BITMAP)
    return docs.select("doc", text).mapInArrow(returning(run), f"doc long, n int, key long, {maps}, part int, counts binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """The summed counters: 8 MB on the driver, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                x = np.frombuffer(data.as_buffer(), "<i8")
                total[part] = total[part] + x if part in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    # summed where the rows lie, then by part
    once = rows.select("part", "counts").mapInArrow(add, "part int, counts binary")
    parts = (1 << SKETCH_BITS) // _SKETCH_PART
    out = np.zeros((parts, _SKETCH_PART), np.int64)
    for r in once.repartition(rows_per_task(rows), "part").mapInArrow(add, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], "<i8")
    return out.ravel()


def _keys(docs: DataFrame, text: str, counts, boundary: int, percent: int) -> DataFrame:
    """Rows (token, n, key); a class is given once by each task, as a rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = counts.value
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, text):
                once = {k: x for x in shingle_sets(part.column(text)) if len(x) and (k := set_key(x)) not in seen}
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(once)
                tokens = [keys_of(x, levels, boundary, percent) for x in once.values()]
                sizes = [len(t) for t in tokens]
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat([len(x) for x in once.values()], sizes), pa.int32()), pa.array(np.repeat(np.array(list(once), np.int64), sizes))],
                        names=["token", "n", "key"],
                    )

    return docs.select(text).mapInArrow(returning(run), "token long, n int, key long")


def _neighbours(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, in lists of two classes or more: columns, and those but the token of the row before in the list (prev_)."""

    def distinct() -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            t, k = (batch.column(c).to_numpy() for c in ("token", "key"))
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            new[0] = last != (t[0], k[0])
            last = (t[-1], k[-1])
            yield batch.filter(pa.array(new))

    before: dict | None = None
    for batch in shared_keys(distinct(), ["token"], columns):
        rows = {c: batch.column(c).to_numpy() for c in columns}
        shifted = {c: np.concatenate([x[:1] if before is None else before[c], x[:-1]]) for c, x in rows.items()}
        none = shifted["token"] != rows["token"]
        none[0] |= before is None
        before = {c: x[-1:] for c, x in rows.items()}
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(shifted[c], mask=none) for c in columns[1:])], names=[*columns, *(f"prev_{c}" for c in columns[1:])])


def _lists(keys: DataFrame) -> DataFrame:
    """Rows (token, n, key, prev_n, prev_key) of tokens with several classes; prev: the neighbour before, if any."""
    columns = ["token", "n", "key"]
    dealt = keys.repartition(rows_per_task(keys), "token").sortWithinPartitions(*columns)
    return dealt.mapInArrow(lambda batches: _neighbours(batches, columns), "token long, n int, key long, prev_n int, prev_key long")


def _open_lists(lists: DataFrame, labels: DataFrame, keep) -> DataFrame:
    """Rows (token, n, key, component) of lists whose classes lie in several components."""
    apart = keep(lists.select("token", "n", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    several = keep(apart.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where(F.col("least") != F.col("most")).select("token"))
    return keep(apart.join(several, "token", "left_semi"))


def _mixed_neighbours(open_lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of neighbours from different components, in an order of each list's own."""
    columns = ["token", "n", "key", "component"]
    dealt = open_lists.repartition(rows_per_task(open_lists), "token").sortWithinPartitions("token", F.xxhash64("token", "key"), "key")
    found = dealt.mapInArrow(lambda batches: _neighbours(batches, columns), "token long, n int, key long, component long, prev_n int, prev_key long, prev_component long")
    return _pairs(found.where(F.col("component") != F.col("prev_component")), percent)


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (u, v), u < v, of rows and their neighbours, of sizes that may link."""
    near = F.least("n", "prev_n") * 100 >= F.greatest("n", "prev_n") * percent
    return rows.where(F.col("prev_key").isNotNull() & near).select(F.least("key", "prev_key").alias("u"), F.greatest("key", "prev_key").alias("v")).distinct()


def _all_pairs(open_lists: DataFrame, classes: DataFrame, percent: int, keep) -> tuple[DataFrame, DataFrame]:
    """Distinct (u, v) from different components of one list: of short lists, and of long ones where bitmaps leave a link possible.

    A short list is paired with itself, which costs a few ids for each row.  In a long one the bitmaps go along, so
    that only what passes them becomes a row; it is dealt over pairs of blocks, and a task holds two of them.
    """
    rows = keep(open_lists.join(open_lists.groupBy("token").agg(F.count(F.lit(1)).alias("rows")), "token"))
    short = rows.where(F.col("rows") <= SHORT).groupBy("token").agg(F.collect_list(F.struct("n", "key", "component")).alias("list"))
    short = short.select(F.explode("list").alias("x"), "list").select("x", F.explode("list").alias("y"))
    apart = (F.col("x.component") != F.col("y.component")) & (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    ends = [F.least("x.key", "y.key").alias("u"), F.greatest("x.key", "y.key").alias("v")]
    few = short.where(apart & (F.col("x.key") < F.col("y.key"))).select(*ends).distinct()

    rows = rows.where(F.col("rows") > SHORT).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).join(classes.drop("n", "least"), "key")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"a": F.least("mine", "other"), "b": F.greatest("mine", "other")})
    x, y = rows.where("mine = a").alias("x"), rows.where("mine = b").alias("y")
    once = (F.col("x.a") != F.col("x.b")) | (F.col("x.key") < F.col("y.key"))
    both = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")) & once & apart & _may_link(percent, "x", "y"))
    return few, both.select(*ends).distinct()


def _filter_of(classes: DataFrame) -> np.ndarray:
    """A bit for each hash bucket that holds the first document of a class; 1 MB whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_bucket(batch.column("least").to_numpy())] = True
        at = np.flatnonzero(np.packbits(bits)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.packbits(bits)[at].astype(np.int16))], names=["at", "byte"])

    rows = classes.select("least").mapInArrow(returning(run), "at int, byte short").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    out[rows["at"].to_numpy()] = rows["byte"].to_numpy().astype(np.uint8)
    return out


def _bucket(doc: np.ndarray) -> np.ndarray:
    return (mix(doc.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def bitmap(x: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set."""
    bits = np.bincount((mix(x) & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def long_bitmap(x: np.ndarray) -> bytes:
    """The parity bitmap of a set, of LONG_BITS bits a shingle or more: a power of two."""
    size = 1 << max(9, (LONG_BITS * len(x) - 1).bit_length())
    bits = np.bincount((mix(x) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two long bitmaps differ, once the longer is folded to the shorter; the sets differ in as many shingles at least."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _of_classes(docs: DataFrame, text: str, wanted: DataFrame, *, with_text: bool) -> DataFrame:
    """(key, value) of the first document of each wanted class (key, least): its text or its long bitmap; others stay out of the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            for part in chunks(batch, text):
                part = part.filter(pa.array(marked[_bucket(part.column("doc").to_numpy())]))
                sets = shingle_sets(part.column(text))
                keys = np.array([set_key(x) for x in sets], np.int64)
                first = np.unique(keys, return_index=True)[1]
                value = part.column(text).take(pa.array(first)) if with_text else pa.array([long_bitmap(sets[i]) for i in first], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys[first]), value], names=["key", "value"])

    found = docs.select("doc", text).mapInArrow(returning(run), "key long, value " + ("string" if with_text else "binary")).join(wanted.select("key"), "key", "left_semi")
    return found.groupBy("key").agg(F.min("value").alias("value"))


def _may_link(percent: int, x: str, y: str):
    """The bitmaps of x and y leave a link possible."""
    differ = F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0")))
    for b in _BITMAP[1:]:
        differ = differ + F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}")))
    return differ * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)


def _with_values(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs with the values tu and tv of both classes."""
    for end in "uv":
        pairs = pairs.join(values.select(F.col("key").alias(end), F.col("value").alias(f"t{end}")), end)
    return pairs


def _not_ruled_out(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v, nu, nv) whose long bitmaps leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("nu").to_numpy().astype(np.int64) + batch.column("nv").to_numpy()
            differ = np.array([differing_bits(a.as_py(), b.as_py()) for a, b in zip(batch.column("tu"), batch.column("tv"), strict=True)], np.int64)
            yield batch.select(["u", "v"]).filter(pa.array(differ * (100 + percent) <= n * (100 - percent)))

    return _with_values(pairs, maps).select("u", "v", "nu", "nv", "tu", "tv").mapInArrow(returning(run), "u long, v long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "tu"):
                left, right = shingle_sets(part.column("tu")), shingle_sets(part.column("tv"))
                good = []
                for x, y in zip(left, right, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return _with_values(pairs, texts).select("u", "v", "tu", "tv").mapInArrow(returning(run), "u long, v long")


def _links(tested: DataFrame, before: list[DataFrame], named: DataFrame, text: str, classes: DataFrame, percent: int, keep) -> tuple[DataFrame, DataFrame]:
    """(candidates (u, v) that the short bitmaps leave, those that link) of tested pairs; not the candidates from before."""
    x, y = (classes.select(F.col("key").alias(end), F.struct("n", *_BITMAP).alias(f"of_{end}")) for end in "uv")
    left = tested.join(x, "u").join(y, "v").where(_may_link(percent, "of_u", "of_v")).select("u", "v", F.col("of_u.n").alias("nu"), F.col("of_v.n").alias("nv"))
    for pairs in before:
        left = left.join(pairs, ["u", "v"], "left_anti")
    left = keep(left)
    values = lambda pairs, with_text: keep(_of_classes(named, text, keep(classes.select("key", "least").join(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "key", "left_semi")), with_text=with_text))
    # the short bitmaps of long texts are full of bits and tell little
    long = F.col("nu") + F.col("nv") > 64 * BITMAP_WORDS
    possible = keep(_not_ruled_out(left.where(long), values(left.where(long), False), percent).unionByName(left.where(~long).select("u", "v")))
    return left.select("u", "v"), keep(_verified(possible, values(possible, True), percent))


def _shared_ids(sets: DataFrame) -> DataFrame:
    """Edges between the sets of one id."""
    named = sets.where(F.col("doc") != NO_ID).select("doc", "node")
    several = named.groupBy("doc").agg(F.min("node").alias("u"), F.max("node").alias("most")).where(F.col("u") != F.col("most")).select("doc", "u")
    return named.join(several, "doc").where(F.col("u") != F.col("node")).select("u", F.col("node").alias("v")).distinct()


def groups(docs: DataFrame, *, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    keep = scratch.write
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text)
    first = keep(_sets_and_sketch(named, text))
    counts = _sketch(first.where(F.col("part").isNotNull()))
    small = {r["n"]: r["count"] for r in first.where(F.col("n").between(1, LARGEST_SMALL)).groupBy("n").count().collect()}
    total = max(1, int(counts.sum()))
    list_length = float(np.clip((counts.astype(np.float64) ** 2).sum() / total - total / len(counts), 1, 64))
    boundary = choose_boundary(small, list_length, percent)
    shared = spark.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
    classes = keep(first.where("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("doc").alias("least"), *(F.min(b).alias(b) for b in _BITMAP)))

    lists = keep(_lists(_keys(named, text, shared, boundary, percent)))
    first_pairs, links = _links(_pairs(lists, percent), [], named, text, classes, percent, keep)
    open_lists = _open_lists(lists, components(links, scratch), keep)
    more_pairs, more = _links(_mixed_neighbours(open_lists, percent), [first_pairs], named, text, classes, percent, keep)
    links = keep(links.unionByName(more))
    open_lists = _open_lists(open_lists, components(links, scratch), keep)
    few, many = _all_pairs(open_lists, classes, percent, keep)
    _, more = _links(keep(few.unionByName(many)).distinct(), [first_pairs, more_pairs], named, text, classes, percent, keep)

    # a document without words is a node of its own; one id makes one document of its rows
    sets = first.where(F.col("n").isNotNull()).select("doc", "n", F.when(F.col("n") > 0, F.col("key")).otherwise(F.xxhash64(F.lit("empty"), "doc")).alias("node"))
    labels = components(keep(links.unionByName(more).unionByName(_shared_ids(sets))), scratch)
    placed = keep(sets.groupBy("node").agg(F.min("doc").alias("least")).join(labels, "node", "left"))
    least = keep(placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("least").alias("group_doc")))
    # merge joins, whose large partitions Spark splits: one component or class may hold a third of all rows
    by_node = keep(placed.join(least.hint("merge"), "component", "left").select("node", F.coalesce("group_doc", "least").alias("component_id")))
    nothing = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = sets.join(by_node.hint("merge"), "node").select(nothing("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), nothing("component_id").alias("component_id"))
    result = written(out)
    scratch.drop()
    return result


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose document is the smallest of its group; rows without an id stay where their group has none."""
    kept = groups(docs, **how).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")
