"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lm, mixing, ngram_join, packing, quality, rp_forest, substrings, topk, toxicity
from ._text import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    train = crc_mod("doc_id", 3) != 1
    model = toxicity.fit(docs.where(train), _table(spark, sf_dir, "labels").where(train))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def tokenizer_path() -> str:
    """Place of the public tokenizer file that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(packing.pieces(docs, tokenizer_path(), capacity=2048))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a model of those that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    model, counts = lm.fit(docs.where(~held_out))
    return lm.score(docs, model, counts, extra={"held_out": held_out})


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for each vector whose id is divisible by 50."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5, scale=256)


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixing.mixed(docs)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same water-filling and the same seeded order as plain windows.
_MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS most FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line FROM w),
t AS (SELECT source, source_size, least(most::DOUBLE, (SELECT max(line) FROM l) * weight) AS target FROM l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT d.doc_id, d.size, n.source_size, n.target, n.whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place) AS run, sum(d.size) OVER (PARTITION BY d.source, d.place) AS alike
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN run - alike / 2 <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS taken
FROM c
"""


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated windows of 20 words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.deduplicate(docs, width=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors linked by a cosine of 0.9 or more."""
    return rp_forest.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose five-word shingles overlap by 80 percent or more."""
    return ngram_join.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(crc_mod("doc_id", 4) != 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    train = crc_mod("doc_id", 3) != 1
    model = quality.fit(docs.where(train), _table(spark, sf_dir, "labels").where(train))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_lm": op3_lm,
    "op4_topk": op4_topk,
    "op5_mixing": op5_mixing,
    "op6_substrings": op6_substrings,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {"op4_topk": _TOPK_SQL, "op5_mixing": _MIX_SQL}
