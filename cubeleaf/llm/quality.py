"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pairwise sum, by the sum-of-squares identity, is half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2):
linear in the number of features.  x holds the L2-normalised square roots of hashed word counts and the
standardised statistics of the text (letters, capitals, digits, signs, lines, repeated words and lines, length).

Fitted by AdaGrad on a bounded sample: at most ``per_class`` labelled documents of each class, those with the
smallest hash of doc_id, weighted back to the classes' shares.  Scoring reads whole texts in a map over the
rows.  What comes to the driver is the sampled documents' distinct buckets with their counts: 8 bytes for each, and
2**16 at most a document.

Null and empty texts have the statistics of an empty text and no words; null metadata counts as 0, and so does a
column that is missing.  Rows without an id are never in the sample, but are scored.  Repeated rows of a sampled id
count once in learning and are scored each, alike.  Texts are never cut: a batch holds one at least, however long.
Without labelled documents every score is 0.5; an empty table gives an empty result.  Columns of docs named like
the score give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Words, add_columns, bounded_batches, hash_strings
from .toxicity import sample_of

BITS = 16
#: Byte classes that are counted, as sets of byte values.
_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "high": range(128, 256), "bar": b"|", "stop": b".,;:", "loud": b"!?", "junk": b"#$%&*@^~<>={}[]\\/_+", "line": b"\n",
}


@dataclass(frozen=True)
class QualityModel:
    """Intercept, linear weights and factors; the last rows belong to the statistics, which mean and std scale."""

    intercept: float
    weight: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    std: np.ndarray


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive starts; 0 for empty ranges."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def statistics(texts: pa.Array, words: Words, distinct: np.ndarray) -> np.ndarray:
    """Structure of every text; distinct: number of different words."""
    filled = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    flat = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(filled) else np.zeros(0, np.uint8)
    starts = offsets - offsets[0]
    size = np.maximum(np.diff(starts), 1).astype(np.float64)
    out = []
    for values in _CLASSES.values():
        member = np.zeros(256, np.int32)
        member[list(values)] = 1
        out.append(_sums(member[flat], starts) / size)
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    at = lines.offsets.to_numpy().astype(np.int64)
    coded = lines.values[at[0] : at[-1]].dictionary_encode().indices.to_numpy().astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    n_lines = np.diff(at)
    line_doc = np.repeat(np.arange(len(n_lines)), n_lines)
    different = np.bincount(np.unique((line_doc << 32) | coded) >> 32, minlength=len(n_lines))
    n_words = np.maximum(words.lengths, 1).astype(np.float64)
    chars = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False).astype(np.float64)[words.codes]
    short = _sums((chars <= 2).astype(np.int32), words.starts) / n_words
    out += [np.log1p(size), np.log1p(words.lengths), size / n_words, distinct / n_words, different / np.maximum(n_lines, 1), np.log1p(n_words / np.maximum(n_lines, 1)), short, (words.lengths == 0).astype(np.float64)]
    return np.stack(out, axis=1)


def features(part: pa.RecordBatch, text: str, metadata: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, bucket, value) of the word features by text, and the statistics."""
    texts = part.column(text)
    words = Words(texts)
    n = len(words.lengths)
    doc = words.doc_of()
    pairs, counts = np.unique((doc << 32) | words.codes.astype(np.int64), return_counts=True)
    distinct = np.bincount(pairs >> 32, minlength=n)
    bucket = (hash_strings(words.vocab) >> np.uint64(64 - BITS)).astype(np.int64)[pairs & 0xFFFFFFFF]
    owner = pairs >> 32
    value = np.sqrt(counts)
    norm = np.sqrt(np.bincount(owner, value * value, n))
    absent = pa.array(np.zeros(part.num_rows))
    extra = [part.column(m).cast(pa.float64()) if m in part.schema.names else absent for m in metadata]
    extra = [np.log1p(np.maximum(pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False), 0)) for x in extra]
    stats = np.column_stack([statistics(texts, words, distinct), *extra])
    return np.searchsorted(owner, np.arange(n + 1)), bucket, value / np.maximum(norm[owner], 1e-9), stats


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, *, rank: int = 8, epochs: int = 6, rate: float = 0.08, decay: float = 1e-4, seed: int = 11) -> QualityModel:
    """AdaGrad over (bucket, value, statistics) rows in seeded order."""
    stats = np.array([r[2] for r in rows])
    mean, std = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    stats = np.clip((stats - mean) / std, -4, 4)
    k, size = stats.shape[1], 1 << BITS
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size + k), rng.normal(0, 0.02, (size + k, rank))
    gw, gv, w0, g0 = np.full(size + k, 1e-3), np.full((size + k, rank), 1e-3), 0.0, 1e-3
    own = np.arange(size, size + k)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = np.concatenate([rows[r][0], own])
            x = np.concatenate([rows[r][1], stats[r] / np.sqrt(k)])
            vi = v[i]
            total = x @ vi
            y = w0 + w[i] @ x + 0.5 * (total @ total - ((vi * x[:, None]) ** 2).sum())
            g = weights[r] * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[r])
            dw = g * x + decay * w[i]
            dv = g * (x[:, None] * total - vi * (x * x)[:, None]) + decay * vi
            # a bucket can occur twice in a text: adding up both keeps the gradient whole
            np.add.at(gw, i, dw * dw)
            np.add.at(w, i, -rate * dw / np.sqrt(gw[i]))
            np.add.at(gv, i, dv * dv)
            np.add.at(v, i, -rate * dv / np.sqrt(gv[i]))
            g0 += g * g
            w0 -= rate * g / np.sqrt(g0)
    return QualityModel(float(w0), w.astype(np.float32), v.astype(np.float32), mean, std)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", metadata: tuple[str, ...] = ("n_chars",), per_class: int = 4000, **how) -> QualityModel:
    """Learn from labels (doc_id, label) joined to docs, on 2 * per_class rows at most."""
    bounded_batches(docs.sparkSession)
    labels = labels.select("doc_id", label)
    sample = sample_of(labels, label, per_class)
    picked = docs.select("doc_id", text, *(m for m in metadata if m in docs.columns)).join(F.broadcast(sample), "doc_id").where(F.col(text).isNotNull())

    def of(part: pa.RecordBatch) -> list[pa.Array]:
        starts, bucket, value, stats = features(part, text, metadata)
        at = pa.array(starts.astype(np.int32))
        return [pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32))), pa.array(list(stats), pa.list_(pa.float64()))]

    fields = [T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType())), T.StructField("stats", T.ArrayType(T.DoubleType()))]
    got = add_columns(picked, lambda: of, fields, text).select("doc_id", "label", "bucket", "value", "stats").toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    rows, y, seen = [], [], set()
    bucket, value, stats = (got[c].combine_chunks() for c in ("bucket", "value", "stats"))
    for i, (doc, target) in enumerate(zip(got["doc_id"].to_pylist(), got["label"].to_pylist(), strict=True)):
        if doc not in seen:
            seen.add(doc)
            rows.append((bucket[i].values.to_numpy(), value[i].values.to_numpy().astype(np.float64), stats[i].values.to_numpy()))
            y.append(target)
    if not rows:
        return QualityModel(0.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, 1), np.float32), np.zeros(0), np.ones(0))
    share = {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    y = np.array(y)
    weight = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            weight[y == c] = share.get(c, 1) / (y == c).sum()
    return train(rows, y, weight / weight.mean(), **how)


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", metadata: tuple[str, ...] = ("n_chars",), column: str = "score") -> DataFrame:
    """docs with a score between 0 and 1."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 buckets of rank + 1 numbers
    def make():
        m = shared.value
        size = 1 << BITS

        def of(part: pa.RecordBatch) -> list[pa.Array]:
            starts, bucket, value, stats = features(part, text, metadata)
            y = m.intercept + _sums(m.weight[bucket] * value, starts)
            x = value[:, None].astype(np.float32) * m.factors[bucket]
            total, squares = _sums(x, starts), _sums(x * x, starts)
            if len(m.mean):
                s = np.clip((stats - m.mean) / m.std, -4, 4) / np.sqrt(len(m.mean))
                y = y + s @ m.weight[size:]
                total = total + s @ m.factors[size:]
                squares = squares + (s * s) @ (m.factors[size:].astype(np.float64) ** 2)
            y = y + 0.5 * (total * total - squares).sum(axis=1)
            return [pa.array(1 / (1 + np.exp(-np.clip(y, -35, 35))))]

        return of

    return add_columns(docs, make, [T.StructField(column, T.DoubleType())], text)
