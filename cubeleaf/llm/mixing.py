"""Mixing sources to target weights by capped water-filling.

Sources, ordered by code point with null last, get weights in a repeating cycle and share the budget (all words)
in proportion.  A source's target stops at ``cap`` times its size; what is above goes to the others by weight
until no target is above its cap.  The level of that fixed point is the largest of the lines through the sources
ordered by cap per weight, so one window over the table of sources finds it.

A target of e times the source's size takes every document floor(e) times, and once more those that come first
in a seeded hash order until the fraction is met: a document is in if the middle of its words lies within.  The
order is that of md5(seed, doc_id), found by prefix sums over hash buckets, so a hot source is never sorted in
one task: its buckets are summed where the rows lie, and only the bucket that holds the threshold is ordered.

Null, empty and blank texts have size 0; an empty table gives an empty result.  Rows with the same doc_id share one place in the order and are taken alike.  Where all
sizes are 0 nothing is taken.  Columns named like the results give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import Scratch, written

_WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of the hash order by source: the last 36 of 48 bits stay within a bucket.
_SHIFT = 36
#: A table of sources of at most so many rows is sent to every executor; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def place_of(seed: int, doc_id: str = "doc_id") -> Column:
    """48 bits of md5: the document's place in the seeded order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def plan(sized: DataFrame, scratch: Scratch, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target, whole, threshold) from (source, place, size) rows.

    A document is taken whole times, and once more if its place is at most threshold (null: none).
    """
    buckets = sized.groupBy("source", F.shiftright("place", _SHIFT).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    buckets = scratch.write(buckets)
    totals = buckets.groupBy("source").agg(F.sum("in_bucket").alias("source_size"))
    every = Window.partitionBy()
    ranked = totals.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    by_ratio = every.orderBy(F.col("most") / F.col("weight"), "rank")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    line = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    levelled = ranked.withColumn("line", line).withColumn("level", F.max("line").over(every))
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    sources = levelled.withColumn("target", target).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    sources = sources.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"))
    # the bucket that holds the threshold of each source, and the words before it
    so_far = Window.partitionBy("source").orderBy("bucket")
    placed = buckets.withColumn("ahead", F.sum("in_bucket").over(so_far) - F.col("in_bucket"))
    placed = _join(placed, sources.select("source", "need")).where(F.col("ahead") < F.col("need"))
    last = placed.groupBy("source").agg(F.max(F.struct("bucket", "ahead", "need")).alias("last")).select("source", "last.*")
    inside = _join(sized.select("source", "place", "size"), last).where(F.shiftright("place", _SHIFT) == F.col("bucket"))
    alike = inside.groupBy("source", "place", "ahead", "need").agg(F.sum("size").alias("size"))
    run = F.col("ahead") + F.sum("size").over(Window.partitionBy("source").orderBy("place"))
    taken = alike.withColumn("in", run - F.col("size") / 2 <= F.col("need")).where("in")
    edge = taken.groupBy("source").agg(F.max("place").alias("edge"))
    floor = last.select("source", F.shiftleft(F.col("bucket"), _SHIFT).alias("below"))
    limits = floor.join(edge, floor["source"].eqNullSafe(edge["source"]), "left").select(
        floor["source"], F.coalesce("edge", F.col("below") - 1).alias("threshold")
    )
    return sources.join(limits, sources["source"].eqNullSafe(limits["source"]), "left").select(
        sources["source"], "source_size", "target", "whole", "threshold"
    )


def _join(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with what belongs to their source, null matching null; few sources travel, many are shuffled."""
    renamed = sources.withColumnRenamed("source", "_source")
    return rows.join(renamed, rows["source"].eqNullSafe(renamed["_source"])).drop("_source")


def mixed(docs: DataFrame, *, seed: int = 20, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, text: str = "text") -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes the document.

    The sizes are written once (narrow rows); texts are not shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.write(docs.select("source", place_of(seed).alias("place"), size_of(text).alias("size")))
    sources = written(plan(sized, scratch, weights=weights, cap=cap))
    scratch.drop()
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    base = docs.drop("size", "source_size", "target", "copies", "whole", "threshold")
    rows = base.withColumn("size", size_of(text)).withColumn("_place", place_of(seed))
    extra = F.coalesce(F.col("_place") <= F.col("threshold"), F.lit(False)).cast("long")
    return _join(rows, sources).withColumn("copies", F.col("whole") + extra).drop("whole", "threshold", "_place")


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed(docs, **how).withColumn("_copy", F.explode(copies)).select(*docs.columns)
