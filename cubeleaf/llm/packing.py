"""Best-fit packing by the sum-of-squares rule.

Texts become token ids (plus an end id); what is longer than a sequence is cut into whole sequences and a rest.
Pieces are dealt over shards of about ``shard_rows``.  In a shard, longest first, each piece goes to the open
sequence after which the sum over residual gaps of (number of open sequences with that gap) squared is smallest;
ties go to the smallest gap, and a new sequence is opened only where none fits.  Sequences that stay emptier than
``good_fill`` are opened again and packed once more in wider shards, so that nearly all waste of the shards' ends is
gone.  Cost and memory of a task are those of a shard.

Null texts count as empty: they are one end id.  Rows are independent of each other: repeated rows and ids, and
rows without an id, are packed each for itself.  Pieces of one length go in the order of the rows.  An empty table
gives an empty result.  Columns of docs named like the results give way to them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Scratch, Words, bounded_batches, chunks, returning, written

#: Distinct words and parts whose ids a worker keeps at once.
CACHE_WORDS = 600_000

#: The tokenizer's own normalisers, splitting rule and mark of a word's end, and that rule for the
#: characters of the class below, in lower case.
_RULE = {
    "normalizers": ["NFC", r"\s+", "Lowercase"],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "end": "</w>",
}
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = r"^[!-~À-ÖØ-öø-ÿ]+$"
_LETTERS = r"^[a-zß-öø-ÿ]+$"


def _has_rule(described: dict) -> bool:
    """Whether a tokenizer file splits texts by _RULE."""
    norm = (described.get("normalizer") or {}).get("normalizers", [])
    pre = (described.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [n.get("pattern", {}).get("Regex", n["type"]) for n in norm] == _RULE["normalizers"]
        and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        and pre[0]["pattern"].get("Regex") == _RULE["split"]
        and (pre[0]["behavior"], pre[0]["invert"], pre[1]["add_prefix_space"]) == ("Removed", True, False)
        and described["model"].get("end_of_word_suffix") == _RULE["end"]
    )


class _Ragged:
    """Lists of ids by the number of their entry, in one growing array; entry 0 is the end of a text."""

    def __init__(self, end_id: int):
        self.known: dict[str, int] = {}
        self.flat = np.full(1 << 18, end_id, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.starts[1] = 1

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known) + 1
        while n + len(names) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
        while self.starts[n] + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.starts[n] : self.starts[n] + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(names)] = self.starts[n] + np.cumsum(sizes)
        self.known.update(zip(names, range(n, n + len(names)), strict=True))

    def numbers(self, names: Iterable[str], count: int) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, names), np.int64, count)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries one after the other, and where each begins (one more than entries)."""
        begin = self.starts[at]
        sizes = self.starts[at + 1] - begin
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])], ends


class WordTokenizer:
    """Token ids of texts, each distinct word and each distinct part of words encoded once.

    A tokenizer of the rule above splits at white space and then into runs of letters, digits or other signs, and
    the last token of each part ends with the mark of a word's end.  So a text's ids are those of its parts one after
    the other, and many parts can be encoded as one text.  Words with other characters are encoded by themselves.
    With a file of any other rule every text is encoded as a whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.by_words = _has_rule(json.loads(self.tokenizer.to_str()))
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(_RULE["end"])]] = True
        self.forget()

    def forget(self) -> None:
        self.words = _Ragged(self.end_id)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, sizes.sum()), sizes

    def _learn_parts(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 4000):
            some = parts[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(some) and ends[-1] == len(ids) - 1:
                self.words.add(some, ids, np.diff(ends, prepend=-1))
            else:
                self.words.add(some, *self._whole(some))

    def _learn(self, words: pa.Array, plain: pa.Array) -> None:
        """words: those not known yet, the plain ones in lower case."""
        letters = pc.match_substring_regex(words, _LETTERS)
        mixed = words.filter(pc.and_not(plain, letters)).to_pylist()
        split = [_PIECE.findall(w) for w in mixed]
        known = self.words.known
        parts = dict.fromkeys(words.filter(letters).to_pylist())
        parts.update(dict.fromkeys(p for p in chain.from_iterable(split) if p not in known))
        self._learn_parts(list(parts))
        several = [(w, s) for w, s in zip(mixed, split, strict=True) if w not in known]  # a word may be one part
        counts = np.fromiter((len(s) for _, s in several), np.int64, len(several))
        ids, ends = self.words.gather(self.words.numbers(chain.from_iterable(s for _, s in several), counts.sum()))
        self.words.add([w for w, _ in several], ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]))
        other = words.filter(pc.invert(plain)).to_pylist()
        if other:
            self.words.add(other, *self._whole(other))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id; and the start of every text (one more than texts)."""
        if not self.by_words:
            ids, sizes = self._whole(pc.fill_null(texts, "").to_pylist())
            first = np.concatenate([[0], np.cumsum(sizes + 1)])
            out = np.full(first[-1], self.end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
            return out, first
        words = Words(texts)
        # the tokenizer lower-cases; a special token's own string must not come about by that
        plain = pc.and_not(pc.match_substring_regex(words.vocab, _PLAIN), pc.match_substring(words.vocab, "<|"))
        vocab = pc.if_else(plain, pc.utf8_lower(words.vocab), words.vocab)
        names = vocab.to_pylist()
        if len(self.words.known) + len(names) > CACHE_WORDS:
            self.forget()
        known = self.words.known
        new = pa.array([w not in known for w in names], pa.bool_())
        fresh = pa.table({"word": vocab.filter(new), "plain": plain.filter(new)}).group_by("word", use_threads=False).aggregate([("plain", "min")])
        if len(fresh):
            self._learn(fresh["word"].combine_chunks(), fresh["plain_min"].combine_chunks())
        numbers = np.append(self.words.numbers(names, len(names)), 0)
        codes = np.full(len(words.codes) + len(words.lengths), len(names), np.int64)
        codes[np.arange(len(words.codes)) + words.doc_of()] = words.codes
        ids, ends = self.words.gather(numbers[codes])
        return ids, ends[words.starts + np.arange(len(words.starts))]


PIECE_FIELDS = [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))]


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: the columns of docs without the text, piece, start, length, ids_crc32
    and, if asked for, the ids themselves."""
    bounded_batches(docs.sparkSession)
    new = {"piece", "start", "length", "ids_crc32", "ids"}
    kept = [f for f in docs.schema.fields if f.name not in new and f.name != text]
    fields = PIECE_FIELDS + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    names = [*(f.name for f in kept), *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path, end_id)
        for batch in batches:
            for part in chunks(batch, text, 2 << 20):
                ids, first = tokenizer.encode(part.column(text))
                lengths = np.diff(first)
                counts = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), counts)
                piece = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(lengths[row] - start, capacity)
                at = first[:-1][row] + start
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4")).tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                arrays = [part.column(f.name).take(pa.array(row)) for f in kept]
                arrays += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + length[-1]) if len(at) else [0], pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*(f.name for f in kept), text).mapInArrow(returning(run), T.StructType([*kept, *fields]))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, offset in it, fill of each bin): longest first, where the sum of squares grows least."""
    order = np.argsort(-lengths, kind="stable")
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual gap
    count = np.zeros(capacity + 1, np.int64)
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for k in order:
        n = int(lengths[k])
        gaps = np.flatnonzero(count[n:capacity]) + n
        best = capacity
        if n < capacity and len(gaps):
            grows = np.where(gaps == n, 0, 2 * count[gaps - n] + 1) - 2 * count[gaps] + 1
            best = int(gaps[np.argmin(grows)])
        if best == capacity:
            b = len(fill)
            fill.append(0)
        else:
            b = open_at[best].pop()
            count[best] -= 1
        bins[k], offsets[k] = b, fill[b]
        fill[b] += n
        left = capacity - fill[b]
        if left:
            open_at[left].append(b)
            count[left] += 1
    return bins, offsets, np.array(fill, np.int64)


def _packed(rows: DataFrame, shards: int, capacity: int, base: int) -> DataFrame:
    """rows with sequence_id, offset and fill of the sequence; numbers start at base."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        shard = table["_shard"][0].as_py()
        bins, offsets, fill = sum_of_squares(table["length"].to_numpy(), capacity)
        ids = base + (shard << 32) + bins
        return pa.Table.from_arrays([*(table[n] for n in names), pa.array(ids), pa.array(offsets), pa.array(fill[bins] if len(bins) else bins)], schema=None, names=[*names, "sequence_id", "offset", "fill"])

    # the number of a row in the written table spreads repeated rows too
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(pack, schema)


def pack(cut: DataFrame, *, capacity: int = 2048, shard_rows: int = 8192, good_fill: float = 0.98) -> DataFrame:
    """Pieces (with a length column) plus sequence_id and offset."""
    scratch = Scratch(cut.sparkSession)
    cut = scratch.write(cut.drop("sequence_id", "offset", "fill", "_shard"))
    shards = max(1, -(-cut.count() // shard_rows))
    first = _packed(cut, shards, capacity, 0)
    if shards == 1:
        return first.drop("fill")
    first = written(first)
    columns = cut.columns
    scratch.drop()
    good = F.col("fill") >= good_fill * capacity
    again = _packed(written(first.where(~good).select(*columns)), max(1, shards // 8), capacity, 1 << 62)
    return first.where(good).drop("fill").unionByName(again.drop("fill"))
