"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import external_shuffle, html_lstm, image_copies, line_dedup, ngram_join, pii_surrogates, quality_rules, sentencepiece_paths, source_mixing, token_counts
from .common import documents
from .oracles import ORACLES as ORACLES

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"
KEY = b"replace this key in production"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sentencepiece_paths.encode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file(PIECES), decoded="decoded")
    return both.select("doc_id", F.size(F.coalesce("piece_ids", F.array().cast("array<int>"))).cast("long").alias("n_pieces"), "piece_ids", F.crc32("decoded").alias("decoded_crc32"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_deleted", "n_runs", F.char_length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.with_surrogates(documents(spark, sf_dir).select("doc_id", "text"), key=KEY)


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return image_copies.image_classes(image_copies.pictures(vectors)).withColumnRenamed("img", "vec_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file(WORDS), limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = html_lstm.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"), "n_blocks")


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.coalesce("text", F.lit(""))
    size = (F.octet_length(whole) + 1).cast("long")
    sharded = external_shuffle.shuffle_into_shards(documents(spark, sf_dir).select("doc_id", "text"), size)
    return sharded.select("doc_id", size.alias("size"), F.crc32(whole).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = source_mixing.drawn(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return dealt.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.size("mix_shards") * F.col("mix_size")).alias("taken"), F.col("mix_shards").alias("shards"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_line_dedup, op3_pii_surrogates, op4_image_copies, op5_token_counts, op6_quality_divergence, op7_html_lstm, op8_external_shuffle, op9_source_mixing, op10_ngram_join)}

