"""The corpus pipeline: documents to packed training sequences, in stages that each read all the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard, langid, packing, pii, substring
from graphloom.llm.common import prepare, remainder, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no recognisable language, and give the others the language predicted for them as lang.

    Rejected are null texts and texts without a letter. Rows of one id are treated one by one."""
    prepare(spark)
    model = langid.train(docs.select("doc_id", "text", "lang"), remainder("doc_id", 3) != 1)
    own = _shielded(docs)
    told = langid.predict(own, model, own.columns).where("lang_pred <> 'und'")
    return _restored(told, docs, {"lang": F.col("lang_pred")})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each component of similar documents; rows without doc_id stay."""
    prepare(spark)
    own = _shielded(docs)
    found = jaccard.similar_components(own)
    gone = found.where("component_id <> id").select(F.col("id").alias("gone_id")).distinct()
    return _restored(own.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti"), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that an earlier document holds; texts that lose nothing stay as they are, others are joined by
    single spaces. Null texts stay null, rows without doc_id lose nothing, and a text may end up empty."""
    prepare(spark)
    own = _shielded(docs)
    done = substring.remove_repeats(own, own.columns, kept_text=True)
    return _restored(done, docs, _new_text(docs, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets. Null texts stay null; every row stays."""
    prepare(spark)
    own = _shielded(docs)
    return _restored(pii.detect(own, pii.train(own), own.columns, redact=True), docs, _new_text(docs, F.col("redacted")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and the numbers of sequences. Null text is one end token."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def _shielded(docs: DataFrame) -> DataFrame:
    """doc_id and text, and every other column under a name that no operator uses, so that no extra column can clash. A
    text is there once: what travels to the workers with it is held there and in the JVM."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")])


def _restored(df: DataFrame, docs: DataFrame, new: dict[str, F.Column] | None = None) -> DataFrame:
    """The columns of docs again, with what is new in them."""
    new = new or {}
    own = {c: F.col(c if c in ("doc_id", "text") else f"own_{i}") for i, c in enumerate(docs.columns)}
    return df.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else own[c].alias(c) for c in docs.columns])


def _new_text(docs: DataFrame, text: F.Column) -> dict[str, F.Column]:
    """The new text and, where it has changed, its length."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        old = F.col(f"own_{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(text.eqNullSafe(F.col("text")), old).otherwise(F.char_length(text))
    return new


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("PII", private_data),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the models and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each stage's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, "stage-" + name.replace(" ", "-").lower())
    return docs
