"""Operator 1 [native]: exact dedup by content-defined chunk recipes.

1. Each text is cut where its content says so: after at least ``min_chunk`` characters, at
   the next sentence or line end, or after ``max_chunk``. Equal passages of different
   documents so tend to give equal chunks.
2. Chunks are deduplicated: one shuffle, with map-side combining, moves each distinct chunk
   once and proves that each digest stands for one chunk text. Should a digest stand for
   two, its chunks carry their own text in the identifier, so identifiers stay exact.
3. A document becomes the ordered list of its chunk identifiers, its recipe. Only recipes
   (about 1/20 of the text) take part in the grouping and the join back.

A group is one key of the grouping, aggregated map-side; the join back has one row per
group on one side, so Spark's skew join can split a group of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_text, table

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """The content-defined chunks of a text; joined they are the text."""
    cut = rf"(?s).{{{min_chunk},{max_chunk}}}?(?<=[.!?\n])|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def digest(chunk: Column, digest_bytes: int = 32) -> Column:
    return F.substring(F.unhex(F.sha2(chunk.cast("binary"), 256)), 1, digest_bytes)


def chunk_dictionary(docs: DataFrame, digest_bytes: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct chunks of all texts: (digest, chunk)."""
    d = id_text(docs, id_col, text_col)
    each = d.select(F.explode(chunks(F.coalesce("text", F.lit("")))).alias("chunk"))
    return each.select(digest(F.col("chunk"), digest_bytes).alias("digest"), "chunk").distinct()


def shared_digests(docs: DataFrame, digest_bytes: int = 32, id_col: str = "doc_id", text_col: str = "text") -> list[bytes]:
    """Digests that stand for more than one chunk text: none, with SHA-256."""
    d = chunk_dictionary(docs, digest_bytes, id_col, text_col)
    return [bytes(r[0]) for r in d.groupBy("digest").count().filter("count > 1").select("digest").collect()]


def recipes(docs: DataFrame, digest_bytes: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, recipe): the ordered verified chunk identifiers of each document."""
    shared = shared_digests(docs, digest_bytes, id_col, text_col)

    def identifier(c: Column) -> Column:
        own = digest(c, digest_bytes)
        return F.when(own.isin(shared), F.concat(own, c.cast("binary"))).otherwise(own) if shared else own

    d = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return d.select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.transform(chunks(F.col("text")), identifier).alias("recipe"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, nothing normalised; a null text counts as empty. Of equal
    texts the largest doc_id stays. Ties: of rows that repeat a doc_id and its text one alone is
    ``kept``; each is counted in group_size. A null doc_id never wins over another; if a group
    has no other, keep_id is null and one of its rows is kept. No rows give no rows; other
    columns are ignored. Chunks are at most ``MAX_CHUNK`` characters, so a text of any length
    moves in small pieces.
    """
    r = durable(recipes(docs, digest_bytes, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "recipes")
    groups = r.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = durable(groups, "groups")  # read back, it has no partitioning that would keep the skew join from splitting
    return r.join(groups, "recipe").select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256"
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_dedup`` of all documents; nulls, ties, repeated rows and long texts: as stated there."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
