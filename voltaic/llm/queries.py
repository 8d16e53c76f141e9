"""The corpus operators' queries over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from voltaic.llm import divergence, filter_audit, langid, mixing, packing, pieces, quality, simhash, substrings, tokens, topk, toxicity, webp
from voltaic.llm._common import crc_mod, cut, table

#: Paths of the public vocabularies; operators take any such path.
COUNTING = public_tokenizers.path("byte_bpe_50k.json")
PACKING = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as lossless WebP in a table of its own, and read back from there."""
    stored = cut(webp.store_payloads(table(spark, sf_dir, "documents")), "media")
    got = webp.read_payloads(stored)
    size = F.octet_length("pixels")
    return got.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "width", "height",
    )


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), COUNTING, public_tokenizers.PATTERN)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), PACKING)


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(crc_mod("doc_id", 5) != 0))
    return langid.predict(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1))
    held_out = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"), F.size("tox_passages").alias("n_passages"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 to 3: twice the quality label, and one more unless the toxic label is set. Rows whose crc32(doc_id) mod 5
    is 0 are held out; grade 2 or better counts as good."""
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 - F.coalesce("toxic", F.lit(0)) + 1).alias("grade"))
    model = quality.fit(docs, ratings.filter(crc_mod("doc_id", 5) != 0), levels=4)
    return quality.rate(docs, model, good=2).withColumn("held_out", crc_mod("doc_id", 5) == 0)


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts, told by their digests."""
    coded = pieces.encode(table(spark, sf_dir, "documents"), PIECES, decoded=True)
    numbers = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": media_columns,
    "op2_mix_sources": mix_sources,
    "op3_token_counts": token_counts,
    "op4_best_fit_packing": best_fit_packing,
    "op5_exact_top_k": exact_top_k,
    "op6_simhash_dedup": simhash_dedup,
    "op7_language_id": language_id,
    "op8_toxicity": toxicity_scores,
    "op9_substring_dedup": substring_dedup,
    "op10_quality_classifier": quality_classifier,
    "op11_filter_audit": filter_interactions,
    "op12_sentencepiece": sentencepiece_round_trip,
    "op13_source_divergence": source_divergence,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op2_mix_sources": mixing.SQL, "op5_exact_top_k": topk.SQL, "op11_filter_audit": filter_audit.SQL, "op13_source_divergence": divergence.SQL}
