"""The registered queries of this package: thin forms over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, decontaminate, langid, lexical, packing, quality, sharding, simhash, trainorder, urlrules,
               warc, whitening)
from .common import held_out, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    found = quality.score(docs, model, threshold=0.7, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"),
                                        _table(spark, sf_dir, "benchmark"))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


URL_POLICY = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
              ("com/fr/", "allow"), ("com/de/", "block")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), URL_POLICY)


SEQUENCE = 256


def _encoder():
    """The encoder of a task: text -> ids."""
    import public_tokenizers
    import tiktoken

    from .bpe import read_ranks
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``documents`` as shards, read them back: a row a sequence, in training order."""
    shards = trainorder.materialise(_table(spark, sf_dir, "documents"), _encoder,
                                    shared_folder(spark, "training-order"), length=SEQUENCE, seed=11)
    rows = trainorder.read_shards(shards, SEQUENCE)
    return rows.select("slot", F.col("key").alias("doc_id"), "part", "n_tokens",
                       F.sha2("ids", 256).alias("ids_sha256"))


def op7_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    pages = warc.with_revisits(_table(spark, sf_dir, "pages"))
    members = warc.normalise(warc.write_archives(pages, folder + "/whole"), folder + "/members")
    if members.limit(1).count() == 0:
        return warc.read_archives(spark.createDataFrame([], warc.INDEX)).withColumnRenamed("key", "page_id")
    found = warc.read_archives(warc.read_index(spark, folder + "/members"))
    return found.withColumnRenamed("key", "page_id")


def op8_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(_table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source", "position")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe
    return bpe.roundtrip_digests(_table(spark, sf_dir, "documents"),
                                 public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                 public_tokenizers.PATTERN, remember=500_000)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = lexical.index(_table(spark, sf_dir, "documents"), shared_folder(spark, "lexical"))
    return lexical.search(blocks, _table(spark, sf_dir, "benchmark"), k=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, components=16, scale=64, shift=1_000_000)
    found = whitening.transform(vectors, model)
    of = [(e / model.trace) for e in model.values.tolist()]
    return (found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened",
                    F.element_at(F.array(*map(F.lit, of)).cast("array<double>"), F.col("at") + 1)
                    .alias("explained"), F.lit(model.identity_error).alias("identity_error")))


WINDOW = 2048


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.cut(_table(spark, sf_dir, "documents"), lambda: packing.word_encoder(path),
                         shared_folder(spark, "packing"), length=WINDOW, end_id=1)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), WINDOW).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        "sequence_id", "offset")


QUERIES = (op1_quality_gam, op2_simhash_near_dedup, op3_template_decontamination,
           op4_learned_partitions, op5_url_rules, op6_training_order, op7_warc_members,
           op8_stratified_interleave, op9_language_id, op10_byte_bpe, op11_lexical_search,
           op12_whitening, op13_packing)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import oracles
    return oracles.oracle_sql()
