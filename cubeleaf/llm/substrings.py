"""Exact substring deduplication with difference-cover anchors.

A window is ``width`` (20) consecutive words of one document.  A window whose words also start earlier (smaller
doc_id, or same document and earlier start) is repeated, and every word it covers goes; windows are judged on
the input.

{0, 1, 3, 9} is a difference cover modulo 13: for any two positions some shift below 13 takes both to cover
positions.  So two equal windows of 20 words contain, at one and the same shift, equal windows of 8 words that
start at cover positions.  Only those anchors (4 of 13 positions) are hashed and grouped; around anchors that
occur twice, the windows of 20 words are then compared by 96-bit hashes of their words.

Hot groups: a worker first settles what repeats within its own batch (there only one row of a hash goes on, the
earliest), so a hash has at most one row for each batch of text in the shuffle.  Groups are found by streaming
over sorted partitions and are never held in memory.

Null, empty and blank texts have no words; an empty table gives an empty result.  Texts are never cut: a batch holds
one at least, however long.  Null ids count as the largest.  Rows with the same doc_id are told apart and ordered
by a 32-bit hash of the text; rows equal in both are judged alike and are not earlier than each other.
Columns of docs named like the results give way to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runs import later_rows, shared_keys
from ._text import Scratch, Words, _B1, _B2, bounded_batches, chunks, returning, rolling, rows_per_task, written

PERIOD, COVER = 13, (0, 1, 3, 9)
#: Rows of a batch are settled among themselves in pieces of so much text.
BATCH_BYTES = 12 << 20


def _positions(words: Words, flat: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return flat - words.starts[doc]


def _anchors(part: pa.RecordBatch, text: str, width: int) -> pa.RecordBatch:
    """Rows (hash, doc, pos); hash is null where the batch itself holds the same words twice."""
    words = Words(part.column(text))
    inner = width - PERIOD + 1
    h = words.hashes()
    starts, counts = words.window_starts(inner)
    doc = np.repeat(np.arange(len(counts)), counts)
    long_enough = words.lengths[doc] >= width
    starts, doc = starts[long_enough], doc[long_enough]
    pos = _positions(words, starts, doc)
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    take = covered[pos % PERIOD]
    starts, doc, pos = starts[take], doc[take], pos[take]
    hashed = rolling(h, starts, starts + inner)
    order = np.argsort(hashed, kind="stable")
    ranked = hashed[order]
    again = np.zeros(len(ranked), bool)
    same = ranked[1:] == ranked[:-1]
    again[1:] = same
    known = again.copy()
    known[:-1] |= same
    # every member of a group of the batch is known to repeat; its first also stands for it outside
    member = order[known]
    alone = order[~again]
    ids = part.column("_doc").to_numpy()
    at = np.concatenate([alone, member])
    hashes = pa.array(np.concatenate([hashed[alone], hashed[member]]).view(np.int64), mask=np.arange(len(at)) >= len(alone))
    return pa.RecordBatch.from_arrays([hashes, pa.array(ids[doc[at]]), pa.array(pos[at].astype(np.int32))], names=["hash", "doc", "pos"])


def _covering(flags: pa.Array, lengths: np.ndarray, starts: np.ndarray, before: int, after: int, last: np.ndarray) -> np.ndarray:
    """Flat boolean over words: those from before words in front of a flagged position to after words behind it."""
    offsets = flags.offsets.to_numpy().astype(np.int64)
    pos = flags.values[offsets[0] : offsets[-1]].to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    doc = np.repeat(np.arange(len(lengths)), np.diff(offsets))
    low, high = np.maximum(pos - before, 0), np.minimum(pos + after, last[doc])
    good = high >= low
    n = int(lengths.sum())
    step = np.bincount(starts[doc[good]] + low[good], minlength=n + 1) - np.bincount(starts[doc[good]] + high[good] + 1, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def _candidates(part: pa.RecordBatch, text: str, width: int) -> pa.RecordBatch:
    """Rows (a, b, doc, tie, pos) of windows near repeated anchors; a is null where the batch settles them."""
    words = Words(part.column(text))
    lengths, starts = words.lengths, words.starts[:-1]
    near = _covering(part.column("_flags"), lengths, starts, PERIOD - 1, 0, lengths - width)
    flat = np.flatnonzero(near)
    doc = words.doc_of()[flat]
    a = rolling(words.hashes(_B1), flat, flat + width, _B1)
    b = (rolling(words.hashes(_B2), flat, flat + width, _B2) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    pos = _positions(words, flat, doc)
    ids, tie = (part.column(c).to_numpy()[doc] for c in ("_doc", "_tie"))
    order = np.lexsort((pos, tie, ids, b, a))
    x, y = a[order], b[order]
    opens = np.ones(len(order), bool)
    opens[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    first = order[at]
    later = (ids[order] != ids[first]) | (tie[order] != tie[first]) | (pos[order] != pos[first])
    alone, settled = order[opens], order[later]
    pick = np.concatenate([alone, settled])
    mask = np.arange(len(pick)) >= len(alone)
    return pa.RecordBatch.from_arrays(
        [pa.array(a[pick].view(np.int64), mask=mask), pa.array(b[pick]), pa.array(ids[pick]), pa.array(tie[pick]), pa.array(pos[pick].astype(np.int32))],
        names=["a", "b", "doc", "tie", "pos"],
    )


def _kept(part: pa.RecordBatch, text: str, width: int) -> list[pa.Array]:
    words = Words(part.column(text))
    lengths = words.lengths
    gone = _covering(part.column("_flags"), lengths, words.starts[:-1], 0, width - 1, lengths - 1)
    removed = np.bincount(words.doc_of()[gone], minlength=len(lengths))
    left = words.vocab.take(pa.array(words.codes[~gone]))
    ends = np.concatenate([[0], np.cumsum(lengths - removed)]).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), left), " ")
    digest = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts])
    return [pa.array(lengths), pa.array(removed), texts, digest]


def _split(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from chunks(batch, text, BATCH_BYTES)


def _after_settled(batches: Iterator[pa.RecordBatch], key: str, columns: list[str], rest: Callable) -> Iterator[pa.RecordBatch]:
    """Rows without a key, which come first, as they are; then what rest makes of the others."""
    for batch in batches:
        empty = batch.column(key).null_count
        if empty:
            yield batch.slice(0, empty).select(columns)
        if empty < batch.num_rows:
            yield from rest(chain([batch.slice(empty)], batches))


def deduplicate(docs: DataFrame, *, width: int = 20, text: str = "text") -> DataFrame:
    """docs with n_words, n_removed, kept_text (words joined by one space) and kept_sha256 of that text."""
    bounded_batches(docs.sparkSession)
    new = ("n_words", "n_removed", "kept_text", "kept_sha256", "_flags", "_doc", "_tie")
    base = docs.drop(*new)
    parts = rows_per_task(docs)
    tie = F.hash(F.coalesce(F.col(text), F.lit("")))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    keyed = base.withColumns({"_doc": doc, "_tie": tie})

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _split(batches, text):
            yield _anchors(part, text, width)

    found = keyed.select("_doc", text).mapInArrow(returning(anchors), "hash long, doc long, pos int")
    dealt = found.repartition(parts, F.coalesce("hash", F.xxhash64("doc", "pos"))).sortWithinPartitions("hash")

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _after_settled(batches, "hash", ["doc", "pos"], lambda rest: shared_keys(rest, ["hash"], ["doc", "pos"]))

    marked = dealt.mapInArrow(returning(repeats), "doc long, pos int")
    # written, so that the anchors' shuffle can go before texts are dealt
    scratch = Scratch(docs.sparkSession)
    flags = scratch.write(marked.groupBy("doc").agg(F.collect_set("pos").alias("_flags")))
    near = keyed.join(flags.withColumnRenamed("doc", "_doc"), "_doc").select("_doc", "_tie", text, "_flags")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _split(batches, text):
            yield _candidates(part, text, width)

    windows = near.mapInArrow(returning(candidates), "a long, b int, doc long, tie int, pos int")
    ranked = windows.repartition(parts, F.coalesce("a", F.xxhash64("doc", "pos"))).sortWithinPartitions("a", "b", "doc", "tie", "pos")

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _after_settled(batches, "a", ["doc", "tie", "pos"], lambda rest: later_rows(rest, ["a", "b"], ["doc", "tie", "pos"], ["doc", "tie", "pos"]))

    gone = written(ranked.mapInArrow(returning(repeated), "doc long, tie int, pos int").groupBy("doc", "tie").agg(F.collect_set("pos").alias("_flags")))
    scratch.drop()
    joined = keyed.join(gone.withColumnsRenamed({"doc": "_doc", "tie": "_tie"}), ["_doc", "_tie"], "left")
    joined = joined.withColumn("_flags", F.coalesce("_flags", F.array().cast("array<int>")))
    names = [f.name for f in base.schema.fields]
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *_kept(part, text, width)], names=schema.names)

    return joined.select(*names, "_flags").mapInArrow(returning(keep), schema)
