"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed unigrams, bigrams and one-word skip-grams of its words (ASCII
lower-cased, outer punctuation off).  Training runs per-coordinate FTRL-proximal with L1, so that most weights
are exactly zero; the few others are broadcast.  Scoring gathers weights for all n-grams of the whole text,
drops the zeros and counts each remaining feature once.

The model is fitted on a bounded sample of labelled rows: at most ``per_class`` documents of each label, those
with the smallest hash of doc_id.  What comes to the driver is each sampled document's distinct buckets: 4 bytes for each, and
2**20 at most, so the sample bounds it.

Null and empty texts have no features and get the score of the intercept.  Rows without an id are never in the
sample, but are scored.  An id labelled several times counts with its largest label, repeated rows of a sampled id
with the first text; repeated rows are scored each, alike, and equal scores are no matter.  Texts are never cut:
a batch holds one at least, however long.  Without labelled documents every score is 0.5; an empty table gives an
empty result.  Columns of docs named like the score give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Words, add_columns, hash_strings, mix

BITS = 20
_PUNCTUATION = ".,;:!?\"'()[]{}<>*#%&$|-_/\\"


@dataclass(frozen=True)
class ToxicityModel:
    """Sparse weights by bucket, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float


def ngrams(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each kind of n-gram the buckets and the text each belongs to."""
    words = Words(texts, lower=True)
    vocab = pc.utf8_trim(words.vocab, _PUNCTUATION)
    h = hash_strings(vocab)[words.codes]
    doc = words.doc_of()
    out = [(h, doc)]
    for kind, gap in ((1, 1), (2, 2)):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        if len(same):
            pair = mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(kind))
            out.append((pair[same], doc[gap:][same]))
    top = np.uint64(64 - BITS)
    return [((x >> top).astype(np.int32), d) for x, d in out], len(texts)


def _distinct(index: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc.astype(np.int64) << BITS) | index)
    return (key & ((1 << BITS) - 1)).astype(np.int32), key >> BITS


def _feature_lists(part: pa.RecordBatch, text: str) -> list[pa.Array]:
    grams, n = ngrams(part.column(text))
    index, doc = _distinct(np.concatenate([x for x, _ in grams]), np.concatenate([d for _, d in grams]))
    at = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(at), pa.array(index))]


def ftrl(samples: list[tuple[np.ndarray, int]], *, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, epochs: int = 3, seed: int = 7) -> ToxicityModel:
    """One pass after the other over (distinct buckets, label) in seeded order; the last bucket is the intercept."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs if samples else 0):
        for k in rng.permutation(len(samples)):
            index, label = samples[k]
            i = np.append(index, size - 1)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    every = np.arange(size)
    w = weights(every)
    used = np.flatnonzero(w[:-1]).astype(np.int32)
    return ToxicityModel(used, w[used].astype(np.float32), float(w[-1]))


def sample_of(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label): at most per_class ids of each label, those with the smallest hashes; repeated ids once."""
    one = labelled.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    parts = [one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", per_class: int = 5000, **how) -> ToxicityModel:
    """Learn from labels (doc_id, label) joined to docs.  The sample has 2 * per_class rows at most, whatever the input."""
    sample = sample_of(labels.select("doc_id", label), label, per_class)
    # at most 2 * per_class rows of two numbers: small enough for every executor
    picked = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id").where(F.col(text).isNotNull())
    lists = add_columns(picked, lambda: lambda part: _feature_lists(part, text), [T.StructField("features", T.ArrayType(T.IntegerType()))], text)
    got = lists.select("doc_id", "label", "features").toArrow().sort_by([("doc_id", "ascending")])
    rows: dict[int, tuple[np.ndarray, int]] = {}
    features = got["features"].combine_chunks()
    for i, (doc, y) in enumerate(zip(got["doc_id"].to_pylist(), got["label"].to_pylist(), strict=True)):
        rows.setdefault(doc, (features[i].values.to_numpy(), y))  # a repeated row counts once
    return ftrl(list(rows.values()), **how)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a score between 0 and 1; a map over the rows, without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.intercept))

    def make():
        index, weight, intercept = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[index] = weight

        def of(part: pa.RecordBatch) -> list[pa.Array]:
            grams, n = ngrams(part.column(text))
            hits = [(x[m], d[m]) for x, d in grams for m in [dense[x] != 0]]
            i, doc = _distinct(np.concatenate([x for x, _ in hits]), np.concatenate([d for _, d in hits]))
            total = intercept + np.bincount(doc, dense[i].astype(np.float64), n)
            return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))]

        return of

    return add_columns(docs, make, [T.StructField(column, T.DoubleType())], text)
