"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared
folder and reads again for the next one.  All but the last return the columns of documents.

1. toxicity: documents that the model rejects (score of 0.7 or more) go; it learns from the labelled documents
   that are not held out.
2. ngram_join: one document of each group of near-duplicates stays, the one with the smallest id.
3. substrings: repeated windows of 20 words go; a document that loses nothing keeps its text as it is, and one
   that loses every word goes.
4. mixing: documents are repeated or left out, so that sources come near their target weights.
5. packing: sequences of at most 2048 tokens; one row per piece.

In every stage: null, empty and blank texts are documents without words (not toxic unless the model's intercept says
so, in a group of their own, nothing to remove, of size 0 and so taken as often as their source's target says, one
end id).  Texts are never cut before packing, however long.  Rows that share an id are one document for the second
stage, which keeps all of them or none, and rows each for the others; exact copies under different ids are one group.
Rows without an id are kept by the second stage only if their group has no id at all.  Ties go to the smaller id.
Further columns of documents are carried along, also those named like an operator's results; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeleaf.llm import mixing, ngram_join, packing, substrings, toxicity
from cubeleaf.llm._text import Scratch, crc_mod, lasting
from cubeleaf.llm.queries import tokenizer_path


def _own(docs: DataFrame, taken: set[str]) -> tuple[DataFrame, list]:
    """docs with other names for the columns that an operator names its results like; and the columns of docs again."""
    names = {c: f"_own_{c}" for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7."""
    train = crc_mod("doc_id", 3) != 1
    model = toxicity.fit(docs.where(train), spark.read.parquet(f"{sf_dir}/labels.parquet").where(train))
    return toxicity.score(docs, model, column="_toxicity").where(F.col("_toxicity") < 0.7).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return ngram_join.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows that start earlier too."""
    named, columns = _own(docs, {"n_words", "n_removed", "kept_text", "kept_sha256"})
    cut = substrings.deduplicate(named)
    left = cut.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumns({"text": text, "n_chars": chars}).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    named, columns = _own(docs, {"size", "source_size", "target", "copies", "whole", "threshold"})
    return mixing.repeated(named).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    packed = packing.pack(packing.pieces(docs.select("doc_id", "text"), tokenizer_path()))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL expresses neither the learnt filter nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = Scratch(spark)
    for _, stage in STAGES:
        following = Scratch(spark)
        docs = following.write(stage(spark, docs, sf_dir))
        done.drop()
        done = following
    return lasting(done, docs)
