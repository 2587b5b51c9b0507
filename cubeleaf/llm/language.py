"""Language identification as inference in a multilingual mixture.

Training counts hashed character n-grams (1 to 4, with word boundaries) of the distinct words of labelled
documents, by language; a word's log-likelihood under a language is the sum over its n-grams of smoothed log
probabilities.  A document is a mixture: each segment of ``segment`` consecutive words comes from one language,
and expectation-maximisation estimates the proportions from the segments' likelihoods.  Which languages belong
to the set is decided by penalised likelihood (half a log of the number of segments for each language): the
language of least weight is left out as long as the penalised likelihood does not fall.  The prediction is the
language with the largest proportion, and the score is that proportion.

The model is fitted on a bounded sample: at most ``per_language`` documents of each language, those with the
smallest hash of doc_id.  Every language that a row is labelled with is learnt; counts are held sparse, so a rare
language takes little memory.  All words of each text are scored, however long it is.

Null texts and texts without a letter, empty ones too, are ``und`` with score 0; so is everything if nothing was
learnt, as from an empty table.  A row labelled ``und`` teaches that name like any other.  Rows without an id are
ranked last in the sample.  Repeated rows are scored each, alike; in the sample, rows of one id and language come in
together.  Of languages with equal proportions the first by name is predicted.  Columns of docs named like the
results give way to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Words, add_columns, bounded_batches, mix, returning

BITS = 16
ORDERS = (1, 2, 3, 4)
#: Counts that are looked up at once, languages whose counts a task holds, and bytes of text times languages that are scored at once.
CHUNK, HELD, SCORED = 1 << 22, 64, 1 << 27
#: Parts that a language's rows are ranked in.
SALTS = 256


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities by order, bucket and language."""

    names: list[str]
    base: np.ndarray  # orders x languages: of a bucket without a count
    starts: np.ndarray  # of each order and bucket in what follows
    language: np.ndarray
    more: np.ndarray  # what a count adds to the base

    def words(self, vocab: pa.Array) -> np.ndarray:
        """Log-likelihoods of words x languages."""
        k = len(self.names)
        out = np.zeros(len(vocab) * k)
        for o, (bucket, word) in enumerate(word_grams(vocab)):
            out += (np.bincount(word, minlength=len(vocab))[:, None] * self.base[o]).ravel()
            at = self.starts[(o << BITS) + bucket]
            sizes = self.starts[(o << BITS) + bucket + 1] - at
            ends = np.cumsum(sizes)
            # about so many counts at once
            cuts = np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK)) if len(ends) else []
            for g in np.split(np.arange(len(bucket)), cuts):
                n = sizes[g]
                i = np.repeat(at[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out += np.bincount(np.repeat(word[g], n) * k + self.language[i], self.more[i], len(out))
        return out.reshape(len(vocab), k)


def word_grams(vocab: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, (bucket, word) of the character n-grams of every word, with a mark at both ends."""
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(vocab)], pa.int32()), pc.utf8_lower(vocab)), "\n")[0].as_py() if len(vocab) else ""
    points = np.frombuffer(f"\n{text}\n".encode("utf-32-le"), np.uint32).astype(np.uint64)
    mark = points == 10
    word = np.cumsum(mark) - 1
    out = []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        # the hash of points[i:i+n]
        h = mix(h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)) if len(points) >= n else h[:0]
        if n in ORDERS and len(h):
            # a gram has no mark inside, and is not made of marks only
            marks = np.concatenate([[0], np.cumsum(mark)])
            inside = marks[n - 1 :][: len(h)] - marks[1:][: len(h)] if n > 2 else 0
            ends = mark[: len(h)] if n == 1 else mark[: len(h)] & mark[n - 1 :] & (n == 2)
            good = (inside == 0) & ~ends
            bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
            out.append((bucket[good], word[: len(h)][good]))
        elif n in ORDERS:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = 2000, smoothing: float = 0.05) -> LanguageModel:
    """Learn from the rows of docs with a text and a language."""
    bounded_batches(docs.sparkSession)
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    names = sorted(r[lang] for r in labelled.select(lang).distinct().collect())
    if not names:
        return LanguageModel([], np.zeros((len(ORDERS), 0)), np.zeros((len(ORDERS) << BITS) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    ids = labelled.select("doc_id", F.col(lang).alias("_lang")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    # the first of each language are among the first of each salt, so that no task ranks a whole language
    for keys in (["_lang", "_salt"], ["_lang"]):
        first = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language)
    # at most per_language rows of an id and a name for each language
    ids = ids.select("doc_id", "_lang").distinct()
    picked = labelled.select("doc_id", text, lang).join(F.broadcast(ids) if len(names) <= HELD else ids, (labelled["doc_id"] == ids["doc_id"]) & (F.col(lang) == F.col("_lang"))).select("_lang", text)

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def rows():
            for name, total in held.items():
                order, bucket = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(((order << BITS) + bucket).astype(np.int32)), pa.array([name] * len(order), pa.string()), pa.array(total[order, bucket])], names=["at", "lang", "n"])
            held.clear()

        for batch in batches:
            for name in pc.unique(batch.column("_lang")).to_pylist():
                part = batch.filter(pc.equal(batch.column("_lang"), name))
                if name not in held:
                    if len(held) == HELD:
                        yield from rows()
                    held[name] = np.zeros((len(ORDERS), 1 << BITS))
                for at in range(0, part.num_rows, 200):
                    words = Words(part.column(text).slice(at, 200))
                    if not len(words.codes):
                        continue
                    weight = np.bincount(words.codes, minlength=len(words.vocab))
                    for o, (bucket, word) in enumerate(word_grams(words.vocab)):
                        held[name][o] += np.bincount(bucket, weight[word], 1 << BITS)
        yield from rows()

    number = F.array_position(F.lit(names), F.col("lang")).cast("int") - 1
    rows = picked.mapInArrow(returning(count), "at int, lang string, n double").groupBy("at", "lang").agg(F.sum("n").alias("n")).select("at", number.alias("k"), "n").toArrow()
    at, k, n = (rows[c].to_numpy() for c in ("at", "k", "n"))
    order = np.lexsort((k, at))
    at, k, n = at[order], k[order], n[order]
    total = np.zeros((len(ORDERS), len(names)))
    np.add.at(total, (at >> BITS, k), n)
    seen = np.bincount(np.unique(at) >> BITS, minlength=len(ORDERS))[:, None] + 1
    starts = np.searchsorted(at, np.arange((len(ORDERS) << BITS) + 1))
    return LanguageModel(names, np.log(smoothing / (total + smoothing * seen)), starts, k.astype(np.int32), np.log1p(n / smoothing).astype(np.float32))


def _segments(words: Words, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat starts of all segments, and the text of each."""
    counts = -(-words.lengths // segment)
    doc = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return words.starts[:-1][doc] + inner * segment, doc


def mixture(loglik: np.ndarray, doc: np.ndarray, n: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, whether a language belongs to the set) of n texts, from segments' log-likelihoods."""
    k = loglik.shape[1]
    top = loglik.max(axis=1, keepdims=True)
    lik = np.exp(np.maximum(loglik - top, -50.0))
    sizes = np.bincount(doc, minlength=n).astype(np.float64)
    at = np.searchsorted(doc, np.arange(n))
    some = sizes > 0

    def by_text(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, *x.shape[1:]))
        if len(x):
            out[some] = np.add.reduceat(x, at[some], axis=0)
        return out

    def em(active: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        theta = np.where(active, np.maximum(theta, 1e-6), 0.0)
        theta /= np.maximum(theta.sum(axis=1, keepdims=True), 1e-300)
        for _ in range(rounds):
            share = lik * theta[doc]
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            theta = by_text(share) / np.maximum(sizes, 1)[:, None]
        return theta, by_text(np.log(np.maximum((lik * theta[doc]).sum(axis=1), 1e-300)))

    active = np.ones((n, k), bool)
    theta, value = em(active, np.full((n, k), 1.0 / max(k, 1)))
    penalty = 0.5 * np.log(np.maximum(sizes, 2))
    open_ = some & (k > 1)
    while open_.any():
        least = np.where(active, theta, np.inf).argmin(axis=1)
        fewer = active.copy()
        fewer[np.flatnonzero(open_), least[open_]] = False
        theta2, value2 = em(fewer, theta)
        better = open_ & (value2 + penalty >= value)
        active[better], theta[better], value[better] = fewer[better], theta2[better], value2[better]
        open_ = better & (active.sum(axis=1) > 1)
    return theta, active


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", segment: int = 8) -> DataFrame:
    """docs with lang_pred, score and languages: the set, largest proportion first.  A map over the rows."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the counts that are not zero

    def make():
        here = shared.value
        k = len(here.names)
        names = np.array([*here.names, "und"], object)

        def of(part: pa.RecordBatch) -> list[pa.Array]:
            """In slices, so that the memory does not grow with the languages."""
            ends = np.cumsum(pc.fill_null(pc.binary_length(part.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            limit = max(1, SCORED // max(k, 1))
            cuts = [0]
            while cuts[-1] < part.num_rows:
                done = ends[cuts[-1] - 1] if cuts[-1] else 0
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + limit, "right"))))
            found = [scored(part.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])] or [scored(part)]
            return [pa.concat_arrays(c) for c in zip(*found)]

        def scored(part: pa.RecordBatch) -> list[pa.Array]:
            words = Words(part.column(text))
            n = len(words.lengths)
            letters = pc.fill_null(pc.match_substring_regex(part.column(text), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score = np.full(n, k), np.zeros(n)
            sets: list[list[str]] = [[] for _ in range(n)]
            if k and len(words.codes):
                by_word = here.words(words.vocab)
                starts, doc = _segments(words, segment)
                theta, active = mixture(np.add.reduceat(by_word[words.codes], starts, axis=0), doc, n)
                good = letters & (words.lengths > 0)
                pred[good], score[good] = theta[good].argmax(axis=1), np.clip(theta[good].max(axis=1), 0, 1)
                order = np.argsort(-theta, axis=1, kind="stable")
                for i in np.flatnonzero(good):
                    sets[i] = [here.names[j] for j in order[i] if active[i, j]]
            return [pa.array(names[pred], pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))]

        return of

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType()))]
    return add_columns(docs, make, fields, text)
