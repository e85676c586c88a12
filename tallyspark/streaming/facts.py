"""Streams: facts appended to a folder bring their keys up to date; windows over events.

A control fact may change any earlier fact, so a watermark would be wrong for the ledger: each
micro-batch finds the keys that it touches and recomputes them from all facts. Windows and
stateful counts over events are apart from that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import cash_projection
from ..sources.sinks import replace_keys

FACT_SCHEMA = "id string, seq long, kind string, portfolio_id long, ticker string, shares double, price double, amount double, target_id string, patch_ticker string, assigned_portfolio_id long"


def touched_keys(batch: DataFrame, facts: DataFrame) -> DataFrame:
    """Keys that new facts touch: their own, those of the facts they aim at, and the names and
    portfolios that they give."""
    own = batch.select("portfolio_id", "ticker")
    aimed = facts.join(batch.select(F.col("target_id").alias("id")).filter("id IS NOT NULL").distinct(), "id", "left_semi").select("portfolio_id", "ticker")
    renamed = batch.filter("patch_ticker IS NOT NULL").select("portfolio_id", F.col("patch_ticker").alias("ticker"))
    moved = batch.filter("assigned_portfolio_id IS NOT NULL").select(F.col("assigned_portfolio_id").alias("portfolio_id"), "ticker")
    return own.unionByName(aimed).unionByName(renamed).unionByName(moved).filter("portfolio_id IS NOT NULL").distinct()


def maintain(spark: SparkSession, facts_path: str, out_path: str, checkpoint: str, recompute: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str]):
    """A query that rewrites the touched keys' partitions of ``out_path`` after each batch.

    Rewriting a key from all facts is idempotent, so a batch that is repeated after a failure
    does no harm.
    """
    stream = spark.readStream.schema(FACT_SCHEMA).parquet(facts_path)

    def batch(df: DataFrame, _: int) -> None:
        facts = df.sparkSession.read.schema(FACT_SCHEMA).parquet(facts_path)
        replace_keys(recompute(facts, touched_keys(df, facts)), out_path, keys)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recompute_cash(facts: DataFrame, touched: DataFrame) -> DataFrame:
    return cash_projection(facts.join(touched.select("portfolio_id").distinct(), "portfolio_id", "left_semi"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
