"""Convergence on the most authoritative facts: rows that a better twin supersedes are retracted,
and explicit allocations follow what they refer to.

Facts: id, seq, kind, ticker, execution_date, shares, price, minutes, source, retracted; explicit
allocations: id, sell_execution_id, allocations array<struct<lot_ref, shares>>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import authority, known_time
from ..scratch import durable

EXECUTION = ["ticker", "kind", "execution_date", "shares", "price"]


def _ranked(facts: DataFrame) -> DataFrame:
    return facts.withColumn("rank", F.coalesce(authority("source"), F.lit(-1))).withColumn("time", known_time("minutes"))


def superseded(facts: DataFrame, trades: DataFrame) -> DataFrame:
    """(id, winner): live executions below the highest authority of their content and price.

    A group with two known times isn't touched, nor are buys that the ledger's own trades claim
    twice (by number, else by time; only trades whose time may be the group's count): these are
    different executions. Ties stay: only rows below the winner, the first by seq of the highest
    rank, fall to it. ``trades``: ticker, execution_date, shares, price, minutes, number.
    """
    live = _ranked(facts.filter("NOT retracted AND kind IN ('BuyExecution', 'SellExecution')"))
    best = F.min_by("id", F.struct((-F.col("rank")).alias("r"), F.col("seq"), F.col("id")))
    g = live.groupBy(*EXECUTION).agg(best.alias("winner"), F.max("rank").alias("top"), F.min("rank").alias("low"), F.min("time").alias("time"), F.max("time").alias("last"))
    g = g.filter("top > low AND (time IS NULL OR time = last)").select(*EXECUTION, "winner", "top", "time")
    t = trades.select("ticker", "execution_date", "shares", "price", F.lit("BuyExecution").alias("kind"), known_time("minutes").alias("t_time"), F.when(F.col("number").isNotNull(), F.concat(F.lit("number:"), "number")).otherwise(F.concat(F.lit("time:"), F.coalesce(F.col("minutes").cast("string"), F.lit("unknown")))).alias("claim"))
    twice = g.join(t, EXECUTION).filter("time IS NULL OR t_time IS NULL OR time = t_time").groupBy(*EXECUTION).agg(F.count_distinct("claim").alias("k")).filter("k > 1")
    return live.join(g.drop("time").join(twice, EXECUTION, "left_anti"), EXECUTION).filter("rank < top").select("id", "winner")


def final_targets(pairs: DataFrame) -> DataFrame:
    """(id, final) of pairs (id, winner): where a chain of winners ends, by pointer jumping.

    Each round doubles the length that a pointer skips, so there are about as many as the longest
    chain has binary digits; each is written to the shared folder. An id with several winners
    takes the smallest; ids on a cycle, which no order of authority makes, are left out.
    """
    at = durable(pairs.groupBy("id").agg(F.min("winner").alias("final")).filter("id <> final"), "jump")
    for _ in range(64):
        step = at.select(F.col("id").alias("final"), F.col("final").alias("next"))
        new = durable(at.join(step, "final", "left").select("id", F.coalesce("next", "final").alias("final"), F.col("next").isNotNull().alias("moved")), "jump")
        at = new.select("id", "final")
        if new.filter("moved").isEmpty():
            return at
        if new.filter("moved AND id <> final").isEmpty():  # only cycles still move
            break
    return at.join(at.select(F.col("id").alias("final")), "final", "left_anti").select("id", "final")


def fitting_buys(facts: DataFrame, lost: DataFrame) -> DataFrame:
    """(id, fit): for lost buys the live buy of the same content and price that fits best: of a time
    that may be the same, of the highest authority, then the first by seq. ``lost``: ids.

    The best live buys of a key at each time, without a time and at any time are aggregates, so
    lost and live rows are never paired."""
    keys = [c for c in EXECUTION if c != "kind"]
    buys = _ranked(facts.filter("kind = 'BuyExecution'"))
    order = F.struct((-F.col("rank")).alias("r"), F.col("seq"), F.col("id"))
    live = buys.filter("NOT retracted")
    timed = live.filter("time IS NOT NULL").groupBy(*keys, "time").agg(F.min(order).alias("same"))
    any_ = live.groupBy(*keys).agg(F.min(order).alias("any"), F.min(F.when(F.col("time").isNull(), order)).alias("untimed"))
    j = buys.filter("retracted").join(lost.select("id").distinct(), "id", "left_semi").join(any_, keys).join(timed, [*keys, "time"], "left")
    fit = F.when(F.col("time").isNull(), F.col("any")).otherwise(F.least("same", "untimed"))
    return j.select("id", fit["id"].alias("fit")).filter("fit IS NOT NULL")


def converge(facts: DataFrame, decisions: DataFrame, trades: DataFrame, earlier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(retractions, replacements): (id, winner) of facts to retract, and explicit allocations (id,
    sell_execution_id, allocations) that replace those of their id.

    References go to the end of the chain of winners, of ``earlier`` pairs (id, winner) too; a lot
    that is retracted without a winner, or whose chain ends so, becomes the live buy that fits best.
    Allocations keep their order, and those whose references are all right are left alone.
    """
    gone = durable(superseded(facts, trades), "superseded")
    final = durable(final_targets(gone.unionByName(earlier.select("id", "winner"))), "final")
    now = facts.join(gone.select("id", F.lit(True).alias("falls")), "id", "left").withColumn("retracted", F.col("retracted") | F.coalesce("falls", F.lit(False))).drop("falls")
    now = durable(now, "facts")
    lines = decisions.select("id", "sell_execution_id", F.posexplode_outer("allocations").alias("pos", "a")).select("id", "sell_execution_id", "pos", F.col("a.lot_ref").alias("lot_ref"), F.col("a.shares").alias("shares"))
    point = lambda c: final.select(F.col("id").alias(c), F.col("final").alias(f"{c}_final"))
    lines = lines.join(point("lot_ref"), "lot_ref", "left").join(point("sell_execution_id"), "sell_execution_id", "left")
    lines = lines.withColumn("lot", F.coalesce("lot_ref_final", "lot_ref")).withColumn("sell", F.coalesce("sell_execution_id_final", "sell_execution_id"))
    fits = fitting_buys(now, lines.select(F.col("lot").alias("id")))
    lines = lines.join(fits.select(F.col("id").alias("lot"), "fit"), "lot", "left").withColumn("lot", F.coalesce("fit", "lot"))
    changed = F.coalesce(F.col("lot") != F.col("lot_ref"), F.lit(False)) | (F.col("sell") != F.col("sell_execution_id"))
    part = F.when(F.col("pos").isNotNull(), F.struct("pos", F.struct(F.col("lot").alias("lot_ref"), "shares").alias("a")))
    g = lines.groupBy("id", F.col("sell")).agg(F.bool_or(changed).alias("changed"), F.transform(F.array_sort(F.collect_list(part)), lambda x: x["a"]).alias("allocations"))
    return gone, g.filter("changed").select("id", F.col("sell").alias("sell_execution_id"), "allocations")
