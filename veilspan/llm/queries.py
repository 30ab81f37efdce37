"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.llm import langid, mixing, mpegts, near_dups, oracles, packing, quality, sharding, syncmers, token_counts, urls
from veilspan.llm.common import spread, table


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(spread(table(spark, sf_dir, "documents")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents")))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op4_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(spread(table(spark, sf_dir, "documents")))


def op5_mpeg_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.media_digests(spread(table(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")))


def op8_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spread(table(spark, sf_dir, "documents")))


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


# --- what SQL can express of them, so that the operators' own rows are held against it ---


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1: lengths and edited texts."""
    return op1_closed_syncmers(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2: sizes and targets."""
    return op2_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def transport_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5: what is read back from the stored streams."""
    return op5_mpeg_transport(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6: parts of the urls, the rules that hold, and the rules' verdicts."""
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return op6_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", ruled.alias("ruled"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8: sizes and law."""
    return op8_label_propagation_shards(spark, sf_dir).select("doc_id", "size", "law", "grown_shard")


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8: rows of each shard, the fullest first, and whether their slots are 0 to n - 1."""
    counts = op8_label_propagation_shards(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("rows"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    shards = spark.range(sharding.SHARDS).select(F.col("id").cast("int").alias("shard")).join(counts, "shard", "left")
    gapless = F.coalesce((F.col("slots") == F.col("rows")) & (F.col("low") == 0) & (F.col("high") == F.col("rows") - 1), F.lit(True))
    nth = F.row_number().over(W.orderBy(F.desc_nulls_last("rows"), "shard")) - 1  # a row per shard
    return shards.select(nth.alias("nth"), F.coalesce("rows", F.lit(0)).alias("rows"), gapless.alias("gapless"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9: words."""
    return op9_trie_token_counts(spark, sf_dir).select("doc_id", "n_words")


QUERIES = {
    "op1_closed_syncmers": op1_closed_syncmers,
    "op2_source_mixing": op2_source_mixing,
    "op3_dart_minhash": op3_dart_minhash,
    "op4_byte_cnn_language": op4_byte_cnn_language,
    "op5_mpeg_transport": op5_mpeg_transport,
    "op6_url_filter": op6_url_filter,
    "op7_bin_slack_packing": op7_bin_slack_packing,
    "op8_label_propagation_shards": op8_label_propagation_shards,
    "op9_trie_token_counts": op9_trie_token_counts,
    "op10_subword_quality": op10_subword_quality,
    "edited_texts": edited_texts,
    "mixing_targets": mixing_targets,
    "transport_payloads": transport_payloads,
    "url_rules": url_rules,
    "shard_sizes": shard_sizes,
    "shard_counts": shard_counts,
    "word_counts": word_counts,
}

#: DuckDB SQL where SQL can express the operator, or a part of its columns.
ORACLES: dict[str, str] = {
    "op3_dart_minhash": oracles.CLASSES,
    "edited_texts": oracles.EDITED,
    "mixing_targets": oracles.TARGETS,
    "transport_payloads": oracles.PAYLOADS,
    "url_rules": oracles.URL_RULES,
    "shard_sizes": oracles.SHARD_SIZES,
    "shard_counts": oracles.SHARD_COUNTS,
    "word_counts": oracles.WORDS,
}
