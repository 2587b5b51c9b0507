"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are ASCII lower-cased words and one end for each text.  Word counts cover all training documents.  The
``vocabulary`` most frequent tokens have embeddings of their own; all others are drawn in two steps, first one of
``CLASSES`` classes by the word's last letters, then the word within the class by its smoothed count.  So the
model gives a normalised distribution over every known token and, in each class, one unseen one.

The score of token w after token h is r_h . q_w + b_w.  Training maximises the NCE objective with noise shared by
a minibatch (matrix products in numpy): each partition trains on all of its training text from the same
parameters, and the results are averaged by their numbers of tokens, for ``rounds`` rounds.  Then one batched
product of all contexts with all targets gives the log normalisers, which are broadcast with the parameters
(their size is fixed by the vocabulary).

Counts: the ``HEAD`` most frequent words (a bound) go to every worker; the other words of a document are joined
to the table of counts by a shuffle, so nothing that grows with the corpus is broadcast.

Null, empty and blank texts are one end.  Rows are scored each for itself, repeated ones and those without an id
too.  Words that tie at the vocabulary's edge are taken in the order of their hashes.  Texts are never cut: a batch
holds one at least, however long.  Without training documents all counts are 0 and the model gives what its
untrained parameters give; an empty table to score gives an empty result.  Only doc_id, the text and what ``extra``
names are read, so columns named like the results don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import Words, bounded_batches, chunks, hash_strings, mix, returning, rows_per_task, written

CLASSES = 64
#: Words whose counts every worker gets: at most so many.
HEAD = 1 << 19
#: The hash that stands for the end of a text.
END = np.uint64(0x454E44)
_PARTS = 16


@dataclass
class LanguageModel:
    """Parameters by token id: the vocabulary, then the classes; contexts have one more, the start of a text."""

    vocab: np.ndarray  # sorted hashes
    ids: np.ndarray  # their token ids
    head: np.ndarray  # sorted hashes
    counts: np.ndarray
    known: int  # different training tokens
    total: int  # all training tokens
    class_mass: np.ndarray  # smoothed mass of all words of a class that are outside the vocabulary
    noise: np.ndarray  # unigram probabilities by token id
    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    log_z: np.ndarray | None = None

    @property
    def start(self) -> int:
        return len(self.noise)


def _lookup(keys: np.ndarray, values: np.ndarray, x: np.ndarray, missing: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), missing, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], missing)


def _classes(vocab: pa.Array) -> np.ndarray:
    return (hash_strings(pc.utf8_slice_codeunits(vocab, -2, None)) % np.uint64(CLASSES)).astype(np.int64) if len(vocab) else np.zeros(0, np.int64)


def _tokens(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, the hash and class of each vocabulary entry and of the end (last), and codes with ends."""
    words = Words(texts, lower=True)
    hashes = np.append(mix(hash_strings(words.vocab)), END)
    classes = np.append(_classes(words.vocab), 0)
    codes = np.full(len(words.codes) + len(words.lengths), len(words.vocab), np.int64)
    codes[np.arange(len(words.codes)) + words.doc_of()] = words.codes
    return words, hashes, classes, codes


def _counted(texts: DataFrame, text: str) -> DataFrame:
    """Rows (hash, class, n), summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, c[first], np.bincount(inverse, n).astype(np.int64)

        for batch in batches:
            for part in chunks(batch, text):
                _, hashes, classes, codes = _tokens(part.column(text))
                held.append((hashes, classes, np.bincount(codes, minlength=len(hashes))))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    held[:] = [summed()]
        if held:
            u, c, n = summed()
            u, c, n = u[n > 0], c[n > 0], n[n > 0]
            for at in range(0, len(u), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(u[s].view(np.int64)), pa.array(c[s]), pa.array(n[s])], names=["hash", "class", "n"])

    return texts.mapInArrow(returning(run), "hash long, class long, n long").groupBy("hash").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def _untrained(counts: DataFrame, vocabulary: int, width: int, seed: int) -> LanguageModel:
    level = F.floor(F.log2("n") * 8)
    levels = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)  # a few hundred rows
    least, so_far = None, 0
    for k, c in levels:
        if so_far + c > HEAD:
            break
        least, so_far = k, so_far + c
    totals = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    head = counts.where(level >= (least if least is not None else 1 << 30)).toArrow()
    h, n, c = head["hash"].to_numpy().view(np.uint64), head["n"].to_numpy(), head["class"].to_numpy()
    top = np.lexsort((h, -n))[:vocabulary]
    mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        mass[r["class"]], types[r["class"]] = r["n"], r["types"]
    mass -= np.bincount(c[top], n[top], CLASSES)
    types -= np.bincount(c[top], minlength=CLASSES)
    known, total = int(sum(r["types"] for r in totals)), int(sum(r["n"] for r in totals))
    noise = np.concatenate([n[top], mass]) + 0.1
    noise = noise / noise.sum()
    rng = np.random.default_rng(seed)
    size = len(noise)
    by_hash, all_hash = np.argsort(h[top]), np.argsort(h)
    return LanguageModel(
        h[top][by_hash], by_hash, h[all_hash], n[all_hash], known, total, mass + 0.1 * (types + 1), noise,
        rng.normal(0, 0.1, (size + 1, width)).astype(np.float32), rng.normal(0, 0.1, (size, width)).astype(np.float32), np.log(noise).astype(np.float32),
    )


def token_ids(model: LanguageModel, texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, hashes, codes with ends, token ids, context ids)."""
    words, hashes, classes, codes = _tokens(texts)
    own = _lookup(model.vocab, model.ids, hashes, -1)
    ids = np.where(own >= 0, own, len(model.ids) + classes)[codes]
    context = np.empty(len(ids), np.int64)
    context[1:] = ids[:-1]
    context[(words.starts + np.arange(len(words.starts)))[:-1]] = model.start
    return words, hashes, codes, ids, context


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, rows without repeats): repeated rows one after the other.  Short integers sort in linear time."""
    short = rows.astype(np.uint16) if len(rows) and rows.max() < 1 << 16 else rows
    order = np.argsort(short, kind="stable")
    ranked = rows[order]
    at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return order, at, ranked[at]


def _summed(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of runs of rows.  Two columns add up as one complex number: the same sums in half the calls."""
    if rows.ndim > 1 and rows.shape[1] % 2 == 0:
        return np.add.reduceat(rows.view(np.complex64), at, axis=0).view(np.float32)
    return np.add.reduceat(rows, at, axis=0)


def _add_rows(u: np.ndarray, g: np.ndarray, values: np.ndarray, squares: np.ndarray, rate: float) -> None:
    """An AdaGrad step with one rate for each row; u has no repeats."""
    new = squares.take(u) + (np.einsum("ij,ij->i", g, g) / g.shape[1] if g.ndim > 1 else g * g)
    squares[u] = new
    step = rate / np.sqrt(new)
    values[u] = values.take(u, axis=0) + (step[:, None] * g if g.ndim > 1 else step * g)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; large negative arguments give 0."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive training of one partition."""

    def __init__(self, model: LanguageModel, *, batch: int = 2048, noise: int = 128, rate: float = 0.15, seed: int = 3):
        self.m, self.batch, self.k, self.rate = model, batch, noise, rate
        self.r, self.q, self.b = model.r.copy(), model.q.copy(), model.b.copy()
        self.squares = [np.full(len(x), 1e-2, np.float32) for x in (self.r, self.q, self.b)]
        self.rng = np.random.default_rng(seed)
        self.cum = np.cumsum(model.noise)
        self.log_kp = np.log(noise * model.noise).astype(np.float32)
        self.tokens = 0

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        order = self.rng.permutation(len(target))
        for at in range(0, len(order), self.batch):
            i = order[at : at + self.batch]
            self._step(context.take(i), target.take(i))
        self.tokens += len(target)

    def _step(self, c: np.ndarray, t: np.ndarray) -> None:
        """The noise is shared, so its part depends on the context alone: it is computed once for each different one."""
        n = np.minimum(np.searchsorted(self.cum, self.rng.random(self.k)), len(self.cum) - 1)
        order, at, contexts = _grouped(c)
        t = t[order]  # all tokens by context from here on
        times = np.diff(np.append(at, len(t)))
        weight = times.astype(np.float32)
        hc, qt, qn = self.r.take(contexts, axis=0), self.q.take(t, axis=0), self.q.take(n, axis=0)
        h = np.repeat(hc, times, axis=0)
        gt = 1 - _sigmoid(np.einsum("ij,ij->i", h, qt) + self.b.take(t) - self.log_kp.take(t))
        s = hc @ qn.T
        s += self.b[n] - self.log_kp[n]
        gn = _sigmoid(s)  # the gradient is its negative
        bias = weight @ gn
        gn *= weight[:, None]
        qt *= gt[:, None]
        dh = _summed(qt, at)
        dh -= gn @ qn
        h *= gt[:, None]
        order, at, targets = _grouped(np.concatenate([t, n]))
        dq = _summed(np.concatenate([h, -(hc.T @ gn).T]).take(order, axis=0), at)
        db = _summed(np.concatenate([gt, -bias]).take(order), at)
        _add_rows(targets, dq, self.q, self.squares[1], self.rate)
        _add_rows(targets, db, self.b, self.squares[2], self.rate * 0.1)
        _add_rows(contexts, dh, self.r, self.squares[0], self.rate)


def _round(texts: DataFrame, model: LanguageModel, text: str, rate: float) -> None:
    """One round over all training text: every partition learns, and the parameters are averaged."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = "part int, weight double, data binary"
    names = ["part", "weight", "data"]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shared.value, rate=rate)
        for batch in batches:
            for part in chunks(batch, text):
                _, _, _, ids, context = token_ids(shared.value, part.column(text))
                trainer.learn(context, ids)
        if trainer.tokens:
            flat = np.concatenate([x.ravel() for x in (trainer.r, trainer.q, trainer.b)]).astype(np.float32) * np.float32(trainer.tokens)
            parts = np.array_split(flat, _PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([float(trainer.tokens)] * _PARTS), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for part, weight, data in zip(batch.column("part").to_pylist(), batch.column("weight").to_pylist(), batch.column("data"), strict=True):
                got = total.setdefault(part, [0.0, 0.0])
                got[0] += weight
                got[1] = got[1] + np.frombuffer(data.as_buffer(), np.float32).astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x[0] for x in total.values()]), pa.array([x[1].astype(np.float32).tobytes() for x in total.values()], pa.binary())], names=names)

    summed = texts.mapInArrow(returning(learn), schema).repartition(min(_PARTS, rows_per_task(texts)), "part").mapInArrow(add, schema)
    rows = {r["part"]: np.frombuffer(r["data"], np.float32) / np.float32(r["weight"]) for r in summed.collect()}  # the size of the parameters
    if rows:
        flat = np.concatenate([rows[i] for i in range(_PARTS)])
        a, b = model.r.size, model.r.size + model.q.size
        model.r, model.q, model.b = flat[:a].reshape(model.r.shape), flat[a:b].reshape(model.q.shape), flat[b:].copy()


def normalise(model: LanguageModel) -> None:
    """Log normalisers of all contexts, by products of blocks of contexts with all targets."""
    out = np.empty(len(model.r))
    for at in range(0, len(model.r), 512):
        s = (model.r[at : at + 512] @ model.q.T + model.b).astype(np.float32)
        top = s.max(axis=1, keepdims=True)
        out[at : at + 512] = top[:, 0] + np.log(np.exp(s - top).sum(axis=1, dtype=np.float64))
    model.log_z = out


def fit(docs: DataFrame, *, text: str = "text", vocabulary: int = 8192, width: int = 32, rounds: int = 2, seed: int = 5) -> tuple[LanguageModel, DataFrame]:
    """The model of all texts of docs, and the table of counts (hash, class, n)."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(text)
    counts = written(_counted(texts, text))
    model = _untrained(counts, vocabulary, width, seed)
    for k in range(rounds):
        _round(texts, model, text, 0.15 / (k + 1))
    normalise(model)
    return model, counts


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame, *, text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, further columns, n_tokens, n_known, train_tokens, base_score, score), one row for each of docs."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}
    rows = docs.select("doc_id", text, *(c.alias(n) for n, c in extra.items()))
    carried = [n for n in rows.columns if n != text]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*carried, "n_tokens", "head_known", "head_log", "model_log", "tail_hash", "tail_n"]
    schema = ", ".join([*(f"`{n}` {types[n]}" for n in carried), "n_tokens long, head_known long, head_log double, model_log double, tail_hash array<long>, tail_n array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        r, q, b, log_z = m.r, m.q, m.b, m.log_z
        log_mass = np.log10(m.class_mass)
        for batch in batches:
            for part in chunks(batch, text):
                words, hashes, codes, ids, context = token_ids(m, part.column(text))
                n = len(words.lengths)
                sizes = words.lengths + 1
                doc = np.repeat(np.arange(n), sizes)
                logp = np.empty(len(ids))
                for at in range(0, len(ids), 1 << 15):
                    c, w = context[at : at + (1 << 15)], ids[at : at + (1 << 15)]
                    logp[at : at + (1 << 15)] = np.einsum("ij,ij->i", r.take(c, axis=0), q.take(w, axis=0)) + b.take(w) - log_z.take(c)
                logp /= np.log(10)
                outside = ids >= len(m.ids)
                logp[outside] -= log_mass[ids[outside] - len(m.ids)]
                count = _lookup(m.head, m.counts, hashes, 0)[codes]
                smoothed = np.log10(count + 0.1)
                head = count > 0
                logp[outside & head] += smoothed[outside & head]
                key, tf = np.unique((doc[~head] << 32) | codes[~head], return_counts=True)
                ends = np.searchsorted(key >> 32, np.arange(n + 1)).astype(np.int32)
                tail = hashes[key & 0xFFFFFFFF].view(np.int64)
                arrays = [pa.array(sizes), pa.array(np.bincount(doc, head, n).astype(np.int64)), pa.array(np.bincount(doc, np.where(head, smoothed, 0.0), n)), pa.array(np.bincount(doc, logp, n))]
                arrays += [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (tail, tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *arrays], names=names)

    first = written(rows.mapInArrow(returning(run), schema)).withColumn("_row", F.monotonically_increasing_id())
    tail = first.select("_row", F.explode(F.arrays_zip("tail_hash", "tail_n")).alias("t")).select("_row", F.col("t.tail_hash").alias("hash"), F.col("t.tail_n").alias("tf"))
    met = tail.join(counts.select("hash", "n"), "hash", "left")
    by_row = met.groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("tail_known"), F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("tail_log")
    )
    total = float(np.log10(model.total + 0.1 * (model.known + 1)))
    all_log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    return first.join(by_row, "_row", "left").select(
        *carried,
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (all_log - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("model_log") + F.coalesce("tail_log", F.lit(0.0))).alias("score"),
    )
