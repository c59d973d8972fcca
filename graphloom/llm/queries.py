"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, covertree, html, imatch, jaccard, langid, ngram_lm, packing, pii, substring
from graphloom.llm.common import prepare, remainder
from graphloom.llm.oracles import SQL

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the rules' spans), spans (with the tagger's)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pii.detect(docs, pii.train(docs), ["doc_id"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words in 13-word windows that a smaller doc_id holds too are removed."""
    return substring.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept: cosine 0.98 or more within a label."""
    return covertree.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return imatch.fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rest = remainder("doc_id", 7)
    return ngram_lm.score(docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(False))), None, None, ["doc_id", "held_out"], learns=rest != 2)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score. A null doc_id is neither held out nor learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rest = remainder("doc_id", 3)
    model = langid.train(docs, rest != 1)
    return langid.predict(docs.withColumn("held_out", F.coalesce(rest == 1, F.lit(False))), model, ["doc_id", "held_out"])


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER, ["doc_id"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: sequences of at most 4096 tokens."""
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER).withColumnRenamed("id", "doc_id")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: 5-word shingles, similarity 0.75 or more."""
    return jaccard.similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent to the workers first and Arrow batches of a size that suits whole texts."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: shipped(f) for f in (op1_pii, op2_substring_dedup, op3_embedding_dedup, op4_imatch, op5_ngram_lm, op6_html, op7_language_id, op8_bpe, op9_packing, op10_ngram_jaccard)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
