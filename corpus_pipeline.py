"""The corpus pipeline: language, quality, near copies, secrets, packing.

Every stage works on all that the stage before kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwork.llm import language_id, near_dup, packing, quality_classifier, secret_scan
from brickwork.llm.common import free_name, written

#: A document goes if no language is predicted, or with a score that is not this part of the way from chance to certainty.
LANGUAGE_MARGIN = 0.05
#: A document goes if its quality score is lower.
MIN_QUALITY_SCORE = 0.3
#: So many ids at most are broadcast; more go through a shuffled join.
BROADCAST_IDS = 500_000


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a predicted language.

    Null and empty texts and texts without a letter go; where nothing can be
    learned, as no row has a language, all go. Repeated rows fare alike, null
    ids count as training rows, other columns pass through whatever their
    names. An empty table gives an empty table.
    """
    net = language_id.learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    chance = 1 / max(1, len(net.classes))
    seen = language_id.with_language(docs, net, "text", lang, score)
    return seen.where((F.col(lang) != "und") & (F.col(score) >= chance + LANGUAGE_MARGIN * (1 - chance))).select(*docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of low predicted quality.

    A null text scores like an empty one; a score of exactly the limit stays.
    Without labels all documents stay. Repeated rows fare alike, other columns
    pass through whatever their names. An empty table gives an empty table.
    """
    model = quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "quality_score")
    return quality_classifier.with_quality_score(docs, model, "text", score).where(F.col(score) >= MIN_QUALITY_SCORE).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near copies (five words, 0.8), once.

    Exactly repeated rows of a kept id become one; rows of one id that differ
    count as one document and stay together. Rows without an id are in no group
    and all stay, as do documents without words. An empty table gives an empty
    table.
    """
    groups = near_dup.near_duplicates(docs, width=5, percent=80)
    gone = written(groups.where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    left = docs.join(_small(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    again = _small(again)
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").distinct()).select(*docs.columns)


def _small(ids: DataFrame) -> DataFrame:
    """These ids for a broadcast up to a checked number, else as they are."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; n_chars follows the text.

    Null texts stay null; repeated rows, null ids and all other columns pass
    through. An empty table gives an empty table.
    """
    out = secret_scan.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens.

    A null or empty text is its end id alone; repeated rows are packed as often
    as they occur, null ids are carried. Other columns are not read. An empty
    table gives an empty table.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_known_language),
    ("quality classifier", keep_good_quality),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: The stages train models, so SQL can't express them; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
