"""Sinks: numbered appends, upserts, per-key replacement, pruning, versioned backups.

Plain Parquet has no transactions: replacing tables are written to a new folder next to the old
one, which the caller then swaps in; per-key replacement overwrites its partitions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import durable

SCHEMA_VERSION = 1
RETAIN_DAYS, RETAIN_EVENTS, RETAIN_CASES = 30, 5000, 200


def numbered(rows: DataFrame, last_seq: int, order: list) -> DataFrame:
    """Rows with seq going on from ``last_seq``, in the given order.

    Numbers come from each range partition's row count, so no task holds all rows. The sorted rows
    are written once and read for both, so counts and rows can't be of different partitions.
    """
    sort = durable(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    counts = sort.groupBy("_part").agg(F.count(F.lit(1)).alias("k"))
    before = counts.withColumn("_before", F.coalesce(F.sum("k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    n = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return sort.join(F.broadcast(before), "_part").withColumn("seq", (F.lit(last_seq) + F.col("_before") + n + 1).cast("bigint")).drop("_part", "_at", "_before")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def replace_keys(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions of the keys that ``rows`` holds, and no others."""
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy(*keys).mode("overwrite").parquet(path)


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def prune_events(events: DataFrame, now, order: str = "recorded_at") -> DataFrame:
    """Events of the last 30 days, 5,000 at most."""
    return newest(events.filter(F.col(order) >= F.date_sub(F.lit(now).cast("date"), RETAIN_DAYS)), order, RETAIN_EVENTS)


def export_ledger(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.withColumn("schemaVersion", F.lit(SCHEMA_VERSION)).write.mode("overwrite").json(f"{path}/{name}")


def import_ledger(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a backup; one of a newer version is refused."""
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(f"{schema}, schemaVersion int").json(f"{path}/{name}")
        newer = df.filter(f"schemaVersion > {SCHEMA_VERSION}").limit(1).collect()
        if newer:
            raise ValueError(f"{name} is of version {newer[0]['schemaVersion']}")
        out[name] = df.drop("schemaVersion")
    return out


def purge_ticker(facts: DataFrame, ticker: str) -> tuple[DataFrame, DataFrame]:
    """(facts left, cash to give back by portfolio). Control facts that aim at purged ones, and
    facts that supersede them, go too, over any number of steps."""
    aims = facts.select(F.col("target_id").alias("at"), "id")
    if "supersedes" in facts.columns:
        aims = aims.unionByName(facts.select(F.col("supersedes").alias("at"), "id"))
    aims = aims.filter("at IS NOT NULL")
    gone = fresh = durable(facts.filter(F.col("ticker") == ticker).select("id").distinct(), "gone")
    while fresh.limit(1).count():
        fresh = durable(aims.join(fresh.withColumnRenamed("id", "at"), "at").select("id").distinct().join(gone, "id", "left_anti"), "fresh")
        gone = durable(gone.unionByName(fresh), "gone")
    bought = facts.join(gone, "id", "left_semi").filter("kind = 'BuyExecution'")
    refund = bought.groupBy("portfolio_id").agg(F.sum(F.floor(F.col("shares") * F.col("price") * 1e6 + 0.5)).cast("bigint").alias("refund_micros"))
    return facts.join(gone, "id", "left_anti"), refund


def set_columns(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``table`` with the columns of ``patch`` where it has the key; a null there sets nothing."""
    new = [c for c in patch.columns if c != key]
    j = table.join(patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in new]), key, "left")
    return j.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in table.columns])


def purge_all(spark: SparkSession, paths: list[str]) -> None:
    """Empties tables, and keeps their schemas."""
    for path in paths:
        spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def commit_tables(tables: dict[str, DataFrame], path: str) -> str:
    """Writes several tables as one version: all of them into a new folder, then its name into the
    pointer that ``committed`` reads. A failure before that leaves the old version in force."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").json(f"{path}/pointer")
    return version


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the version that was committed last."""
    last = spark.read.schema("version string, at timestamp").json(f"{path}/pointer").orderBy(F.desc("at")).first()
    return spark.read.parquet(f"{path}/{last['version']}/{name}")


def quarantine(rows: DataFrame, positive: list[str], not_negative: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``fault``): values that must be above zero, or not below it; a
    null is a fault."""
    fault = F.array_join(F.array_compact(F.array(
        *[F.when(~F.coalesce(F.col(c) > 0, F.lit(False)), F.lit(f"{c} must be positive")) for c in positive], *[F.when(~F.coalesce(F.col(c) >= 0, F.lit(False)), F.lit(f"{c} must not be negative")) for c in not_negative],
    )), "; ")
    checked = rows.withColumn("fault", fault)
    return checked.filter("fault = ''").drop("fault"), checked.filter("fault <> ''")
