"""From raw documents to token ids, in stages that each work on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.llm.byte_bpe import bpe_encode
from daymark.llm.common import discard, table, written
from daymark.llm.decontaminate import drop_contaminated
from daymark.llm.near_duplicates import drop_near_duplicates
from daymark.llm.quality import reject_low_quality, train_quality
from daymark.llm.substrings import drop_repeated


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return reject_low_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def first_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of documents that links of word 5-gram similarity 0.8 or more join."""
    return drop_near_duplicates(docs, words=5, num=80, den=100)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier string of 100 bytes covers; a document of which nothing stays goes.

    A character of which a part was covered goes as a whole.
    """
    cut = drop_repeated(docs, passed=("lang", "source"))
    own = cut.where("n_removed = 0 or length(kept) > 0").withColumn("text", F.col("kept_text"))
    return own.select("doc_id", "text", "lang", "source", F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage within edit similarity 0.8 of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of each text."""
    return bpe_encode(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", first_of_alike),
    ("substrings", without_repeats),
    ("decontaminate", uncontaminated),
    ("byte_bpe", token_ids),
]

#: SQL can't express the learned and the similarity stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage keeps is a table in the shared folder, computed once and read by the next."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, before, sf_dir), name)
        if hasattr(before, "kept_at"):
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
