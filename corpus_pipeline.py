"""The corpus pipeline: five operators one after the other, each on what its predecessor kept.

Stages only drop documents (the last one encodes them), so all but the last return the columns
of ``documents``, extra ones too. Where an operator says which documents go, those few ids are
taken off by an anti join; texts aren't grouped.

Null and empty texts: the language stage rejects them, as it does all texts without letters; no
later stage meets them. Null ids: such rows can be told from one another by their text only, so
the language and exact stages judge them as any row, the others keep them. Repeated rows and
equal texts: one stays. Ties: the largest id stays of equal texts, the smallest of near
duplicates; rows of one id with different texts are one document to the near-duplicate stage
and share what becomes of it. Empty tables give empty results. Texts are whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, exact_dedup, language_id, near_dup, sentencepiece_codec
from tallyspark.llm.common import durable, table

SHA = "sha2(cast(coalesce(d.text, '') AS binary), 256)"


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents but those of ``gone``, by an anti join: its rows are (doc_id), or (doc_id,
    text_sha256, again), where ``again`` tells that the rows only repeat one that stays.

    A bitmap tells which documents may be gone, and only these take part in the join: the texts
    of the others are never shuffled. Null ids are equal to each other.
    """
    gone = durable(gone.distinct(), "gone")
    packed = docs.select(F.struct(*docs.columns).alias("d"))  # columns of any name can't clash
    at = near_dup.Bitmap(gone, "doc_id").mark(packed, "hit", "d.doc_id")
    rest, some = at.filter("NOT hit").select("d"), at.filter("hit").select("d")
    same = some["d.doc_id"].eqNullSafe(gone["doc_id"])
    if "again" not in gone.columns:
        return rest.unionByName(some.join(gone, same, "left_anti")).select("d.*")
    some = some.withColumn("sha", F.expr(SHA))
    same &= some["sha"] == gone["text_sha256"]
    left = some.join(gone, same, "left_anti").select("d")
    # of rows that repeat an id and its text the least by all columns stays, by an aggregate that tasks begin
    again = gone.filter("again")
    one = some.join(again, same, "left_semi").groupBy("d.doc_id", "sha").agg(F.min_by("d", F.to_json("d")).alias("d")).select("d")
    return rest.unionByName(left).unionByName(one).select("d.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that language ID has learnt: noise, code, other languages and
    texts of hardly a letter go, by limits set from all rows."""
    model, habits = language_id.learn(docs.filter(language_id.remainder("doc_id", 4) != 2))
    return language_id.keep(docs, model, habits)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the largest id's."""
    gone = exact_dedup.exact_dedup(docs).filter("NOT kept")
    return without(docs, gone.select("doc_id", "text_sha256", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates, the one with the smallest id."""
    gone = near_dup.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id")
    return without(docs, gone)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that overlap with no benchmark item."""
    gone = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).filter("doc_id IS NOT NULL").select("doc_id")
    return without(docs, gone)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document, and tells whether decoding its ids gives the text back."""
    return sentencepiece_codec.round_trip(docs, sentencepiece_codec.share(spark))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_duplicates", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The first, fourth and last stage can't be put in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
