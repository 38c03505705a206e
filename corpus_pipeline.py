"""Corpus pipeline over the documents table: quality, language, near-duplicates,
benchmark decontamination, tokens.

Each stage takes what its predecessor kept, written as Parquet and read again.  All but
the last return the columns of documents; the last returns each document's ids
(little-endian unsigned 32-bit integers), their count, and digests of the ids and of
the decoded bytes.

Models are fitted on the tables of ``sf_dir``: their labelled rows, without the held-out ones.
Rows are kept or dropped whole; NULL texts and empty texts are judged like any other:
they have no letter, so the language stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebase.llm import bpe, decontaminate, langid, quality, simhash
from casebase.llm.common import held_out, shared_folder

MIN_QUALITY = 0.7          # score from which a document is kept, as in the quality query
MIN_LANGUAGE = 0.5         # share of the best language from which a document is kept


BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20    # of texts that a task holds in Python at once


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python: bound what a task holds of them by bytes, too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    _small_batches(spark)
    labels = _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = quality.fit(_table(spark, sf_dir, "documents"), labels)
    return quality.accepted(docs, model, threshold=MIN_QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows."""
    _small_batches(spark)
    known = _table(spark, sf_dir, "documents").where(~held_out(F.col("doc_id")))
    return langid.accepted(docs, langid.fit(known), least=MIN_LANGUAGE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (of rows
    that repeat it, or of a group without ids, the first by text)."""
    _small_batches(spark)
    return simhash.one_of_each(docs, shingle=3, max_bits=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    _small_batches(spark)
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every kept document, and digests of the ids and of what they decode to."""
    _small_batches(spark)
    import public_tokenizers
    return bpe.roundtrip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                 public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_dedup", near_dedup_stage),
          ("decontamination", decontamination_stage), ("tokens", token_stage)]

# the models and the merges cannot be stated in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
