"""The thin queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import centroids, language_id, lexical_search, main_text, near_dup, packing, piece_bpe, quality_classifier, quality_rules, secret_scan, token_codec, topk_search, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return piece_bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives, indexed, looked up and read back."""
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the cascade's verdict for every document."""
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents: shingles of four words, similarity of 0.8 or more."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors for every vector whose id is divisible by 20."""
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    return quality_classifier.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to token files and read back."""
    return token_codec.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return lexical_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding in one of 8 clusters after 10 rounds."""
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_topk_search": op8_topk_search,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_files": op10_token_files,
    "op11_lexical_search": op11_lexical_search,
    "op12_main_text": op12_main_text,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL = {
    "op5_warc": warc.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op8_topk_search": topk_search.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op13_centroid_clusters": centroids.ORACLE_SQL,
}
