"""Sweeps over all keys: completed fields, canonical transactions, official coverage, root causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import authority, known_time
from ..scratch import durable
from .resolve import CONTENT


def completed_fields(facts: DataFrame, order: list) -> DataFrame:
    """Unknown times filled from the first sibling of another source that knows one, invoices
    first. Rows that got none are left out.

    The donor of a key is found per source by an aggregate, so a key's rows are never paired.
    """
    known = facts.filter(known_time("minutes").isNotNull())
    rank = F.struct((F.col("source") != "invoice").cast("int").alias("k"), *[F.col(c) for c in order])
    per_source = known.groupBy(*CONTENT, "source").agg(F.min(F.struct(rank.alias("r"), F.col("minutes").alias("m"))).alias("d"))
    best = per_source.groupBy(*CONTENT).agg(F.sort_array(F.collect_list(F.struct(F.col("d.r").alias("r"), F.col("d.m").alias("m"), F.col("source").alias("s")))).alias("ds"))
    need = facts.filter(known_time("minutes").isNull()).join(best, CONTENT)
    donor = F.try_element_at(F.filter("ds", lambda x: x["s"] != F.col("source")), F.lit(1))
    return need.withColumn("filled", donor["m"]).filter("filled IS NOT NULL").drop("ds")


OFFICIAL = 5  # the authority of an official export
TWIN = [*CONTENT, "price"]


def _ranks(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The highest authority of the rows of one execution at each known time (``name``), and, of its
    key, at any time (``name_any``) and at none (``name_untimed``)."""
    r = rows.withColumn("time", known_time("minutes")).withColumn("rank", F.coalesce(authority("source"), F.lit(-1)))
    timed = r.filter("time IS NOT NULL").groupBy(*TWIN, "time").agg(F.max("rank").alias(name))
    return timed, r.groupBy(*TWIN).agg(F.max("rank").alias(f"{name}_any"), F.max(F.when(F.col("time").isNull(), F.col("rank"))).alias(f"{name}_untimed"))


def official_coverage(facts: DataFrame) -> DataFrame:
    """(keys, fully_official, n_official, n_shadowed, n_covered, n): whether every live row of a ticker
    is official or better, or has a twin of higher authority.

    A twin has the row's content and price. A live one counts at the same known time (shadowed);
    a retracted one at any time that may be the row's: unknown and midnight go with every time
    (covered). Facts: content, price, minutes, source, retracted. The ranks of twins are maxima by
    time, so rows are never paired, and a row's own rank can't exceed itself.
    """
    live = facts.filter("NOT retracted").withColumn("time", known_time("minutes")).withColumn("rank", F.coalesce(authority("source"), F.lit(-1)))
    shadows, _ = _ranks(facts.filter("NOT retracted"), "live")
    gone_timed, gone = _ranks(facts.filter("retracted"), "gone")
    j = live.join(shadows, [*TWIN, "time"], "left").join(gone_timed, [*TWIN, "time"], "left").join(gone, TWIN, "left")
    twin = F.when(F.col("time").isNull(), F.col("gone_any")).otherwise(F.greatest("gone", "gone_untimed"))
    own, shadowed, covered = F.col("rank") >= OFFICIAL, F.coalesce(F.col("live") > F.col("rank"), F.lit(False)), F.coalesce(twin > F.col("rank"), F.lit(False))
    g = j.groupBy("portfolio_id", "ticker_id").agg(F.bool_and(own | shadowed | covered).alias("fully_official"), F.count_if(own).alias("n_official"), F.count_if(~own & shadowed).alias("n_shadowed"), F.count_if(~own & ~shadowed & covered).alias("n_covered"), F.count(F.lit(1)).alias("n"))
    return g


def session_coverage(facts: DataFrame, candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(keys, covered): whether an import session's official rows account for a ticker, for each one
    that has such rows: every live row has an official candidate of its content, price and a time
    that may be its own, and none is official itself yet; without live rows, the ledger has no
    shares. ``candidates``: content, price, minutes, source; ``existing``: keys, existing."""
    keys = ["portfolio_id", "ticker_id"]
    official = candidates.filter("source = 'official-broker-excel'")
    timed, any_ = _ranks(official, "seen")
    live = facts.filter("NOT retracted").withColumn("time", known_time("minutes")).withColumn("rank", F.coalesce(authority("source"), F.lit(-1)))
    j = live.join(timed, [*TWIN, "time"], "left").join(any_, TWIN, "left")
    met = F.when(F.col("time").isNull(), F.col("seen_any").isNotNull()).otherwise(F.col("seen").isNotNull() | F.col("seen_untimed").isNotNull())
    g = j.groupBy(*keys).agg(F.bool_and(met & (F.col("rank") < OFFICIAL)).alias("all_met"))
    asked = official.select(*keys).distinct().join(g, keys, "left").join(existing.select(*keys, "existing"), keys, "left")
    return asked.select(*keys, F.coalesce("all_met", F.abs("existing") < 1e-6, F.lit(False)).alias("covered"))


def ticker_split(tickers: DataFrame, resolved: DataFrame) -> DataFrame:
    """By portfolio: tickers still active and completed (``resolved``: keys, resolved), and how
    many of the active ones match."""
    j = tickers.join(resolved, ["portfolio_id", "ticker_id"], "left").withColumn("done", F.coalesce("resolved", F.lit(False)))
    return j.groupBy("portfolio_id").agg(F.count_if(~F.col("done")).alias("n_active"), F.count_if("done").alias("n_completed"), F.count_if(~F.col("done") & F.col("matched")).alias("n_matched"), F.count_if(~F.col("done") & ~F.col("matched")).alias("n_unmatched"))


def unique_invoice_matches(pending: DataFrame, invoices: DataFrame, keys: list[str]) -> DataFrame:
    """Pending executions that exactly one invoice of their key can confirm, and the invoice."""
    i = invoices.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("invoice_id"))
    return pending.join(i.filter("k = 1"), keys).select("id", "invoice_id")


def sweep_report(facts: DataFrame) -> DataFrame:
    """By portfolio: live pairs, duplicate groups, rows a better twin supersedes."""
    g = facts.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("n"), F.max(authority("source")).alias("top"))
    by_rank = facts.groupBy(*CONTENT, authority("source").alias("rank")).agg(F.count(F.lit(1)).alias("k"))
    below = by_rank.join(g, CONTENT).filter("rank < top").groupBy("portfolio_id").agg(F.sum("k").alias("n_superseded"))
    pairs = facts.groupBy("portfolio_id").agg(F.count_distinct("ticker_id").alias("n_tickers"), F.count(F.lit(1)).alias("n_facts"))
    groups = g.filter("n > 1").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n_groups"))
    return pairs.join(groups, "portfolio_id", "left").join(below, "portfolio_id", "left").fillna(0, ["n_groups", "n_superseded"])


def closed_positions(facts: DataFrame) -> DataFrame:
    """Whether a position is closed: its shares net to zero, or all its rows are official and
    they net to none or less."""
    signed = F.when(F.col("kind") == "BuyExecution", F.col("shares")).otherwise(-F.col("shares"))
    g = facts.groupBy("portfolio_id", "ticker_id").agg(F.sum(signed).alias("net"), F.bool_and(F.col("source") == "official-broker-excel").alias("official"))
    return g.select("portfolio_id", "ticker_id", "net", ((F.col("net") == 0) | (F.col("official") & (F.col("net") <= 0))).alias("closed"))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): all nodes that the seeds reach over edges (a, b) in either direction, by rounds
    from the newest nodes only. Each round is written to the shared folder, so plans don't grow
    and a lost executor costs one round."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    seen = fresh = durable(seeds.select("node").distinct(), "seen")
    while fresh.limit(1).count():
        fresh = durable(both.join(fresh.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"), "fresh")
        seen = durable(seen.unionByName(fresh), "seen")
    return seen


def with_running_rank(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
