"""Review of the ledger: issues, rebuild differences, pending confirmations, import decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import authority, half_up
from ..scratch import durable
from .ledger import SHARE, micro_shares

TRACKING_START = "2026-01-01"


def tracked(df: DataFrame, day: str, start: str = TRACKING_START, today: str | None = None) -> DataFrame:
    """Rows within the tracking window: from its start to tomorrow."""
    out = df.filter(F.col(day) >= F.lit(start).cast("date"))
    return out.filter(F.col(day) <= F.date_add(F.lit(today).cast("date"), 1)) if today else out


def tracked_counts(df: DataFrame, keys: list[str], day: str, start: str, today: str) -> DataFrame:
    inside = F.col(day).between(F.lit(start).cast("date"), F.date_add(F.lit(today).cast("date"), 1))
    return df.groupBy(*keys).agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"))


def duplicate_trades(trades: DataFrame, keys: list[str], touched: str) -> DataFrame:
    """Groups of equal trades: what may go (untouched ones but one; all untouched ones where a
    touched one stays), and whether two touched states make it ambiguous."""
    g = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(touched) != 0).alias("n_touched"), F.count_distinct(F.when(F.col(touched) != 0, F.col(touched))).alias("n_states")).filter("n > 1")
    return g.select(*keys, "n", (F.col("n") - F.greatest(F.lit(1), F.col("n_touched"))).alias("n_removable"), (F.col("n_states") >= 2).alias("ambiguous"))


def lot_issues(lots: DataFrame, sells: DataFrame, allocated: DataFrame, today) -> DataFrame:
    """Issues of lots and sales, one row each: over-allocated lot, lot dated ahead, lot without
    cost, sale without allocation, sale allocated in part, sale before any lot.

    ``lots``: key, id, shares, price, on. ``sells``: key, id, shares, on. ``allocated``: sell_id,
    lot_id, shares.
    """
    by_lot = allocated.groupBy(F.col("lot_id").alias("id")).agg(F.sum("shares").alias("used"))
    by_sell = allocated.groupBy(F.col("sell_id").alias("id")).agg(F.sum("shares").alias("used"))
    lot = lots.join(by_lot, "id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    first = lots.groupBy("key").agg(F.min("on").alias("first_lot"))
    sell = sells.join(by_sell, "id", "left").join(first, "key", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    issue = lambda df, code, cond: df.filter(cond).select("key", "id", F.lit(code).alias("issue"))
    out = issue(lot, "over-allocated", F.col("used") > F.col("shares"))
    for df, code, cond in (
        (lot, "future-lot", F.col("on") > F.lit(today).cast("date")), (lot, "no-cost", F.col("price") <= 0), (sell, "unallocated", F.col("used") == 0),
        (sell, "partly-allocated", (F.col("used") > 0) & (F.col("used") < F.col("shares"))), (sell, "before-any-lot", F.col("first_lot").isNull() | (F.col("on") < F.col("first_lot"))),
    ):
        out = out.unionByName(issue(df, code, cond))
    return out


def rebuild_differences(canonical: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What a rebuild adds and removes: rows of a key are matched one to one, so a key differs by
    its counts."""
    a = canonical.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_canonical"))
    b = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_stored"))
    j = a.join(b, keys, "full_outer").fillna(0, ["n_canonical", "n_stored"]).filter("n_canonical <> n_stored")
    return j.select(*keys, F.greatest(F.lit(0), F.col("n_canonical") - F.col("n_stored")).cast("bigint").alias("to_add"), F.greatest(F.lit(0), F.col("n_stored") - F.col("n_canonical")).cast("bigint").alias("to_remove"))


def import_decisions(incoming: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows counted by decision: recorded where no live twin has their authority or
    more, else skipped."""
    top = live.groupBy(*keys).agg(F.max(authority("source")).alias("live_rank"))
    j = incoming.join(top, keys, "left")
    decision = F.when(F.col("live_rank").isNull(), "new").when(authority("source") > F.col("live_rank"), "upgrade").otherwise("skip")
    return j.groupBy("source", decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def invalidated_verifications(facts: DataFrame, verifications: DataFrame) -> DataFrame:
    """Verifications whose units differ from what facts up to their day net to."""
    j = verifications.join(facts.select("portfolio_id", "ticker_id", "kind", "shares", "execution_date"), ["portfolio_id", "ticker_id"])
    net = F.sum(F.when(F.col("execution_date") <= F.col("captured_on"), F.when(F.col("kind") == "BuyExecution", F.col("shares")).otherwise(-F.col("shares"))).otherwise(0))
    g = j.groupBy("portfolio_id", "ticker_id", "units", "captured_on").agg(net.alias("net"))
    return g.filter("net <> units")


def default_portfolios(facts: DataFrame, choices: DataFrame) -> DataFrame:
    """The portfolio of each ticker: an explicit choice, else its only one, else none."""
    g = facts.groupBy("ticker_id").agg(F.count_distinct("portfolio_id").alias("n"), F.min("portfolio_id").alias("only"))
    return g.join(choices, "ticker_id", "left").select("ticker_id", F.coalesce("choice", F.when(F.col("n") == 1, F.col("only"))).alias("portfolio_id"))


def pending_confirmations(trades: DataFrame) -> DataFrame:
    """Pending rows by key, buys singly and sales by group."""
    buys = trades.filter("pending AND kind = 'BuyExecution'").select("portfolio_id", "ticker_id", F.lit("buy").alias("what"), F.col("shares").cast("bigint").alias("shares"))
    sells = trades.filter("pending AND kind = 'SellExecution'").groupBy("portfolio_id", "ticker_id", "l_orderkey").agg(F.sum("shares").alias("shares"))
    both = buys.unionByName(sells.select("portfolio_id", "ticker_id", F.lit("sell").alias("what"), "shares"))
    return both.groupBy("portfolio_id", "ticker_id", "what").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"))


def smart_order(lots: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Lots in the order in which a sale takes them: by day, known times first, then by time."""
    w = Window.partitionBy(*keys).orderBy("execution_date", F.col("minutes").isNull().cast("int"), F.coalesce("minutes", F.lit(0)), *order)
    return lots.withColumn("take_order", F.row_number().over(w))


def authority_retractions(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a twin of higher authority retracts, counted by source; keys whose known times
    clash keep all their rows."""
    t = F.nullif(F.coalesce("minutes", F.lit(0)), F.lit(0))
    g = facts.groupBy(*keys).agg(F.max(authority("source")).alias("top"), F.count_distinct(t).alias("n_times"), F.count(F.lit(1)).alias("n"))
    j = facts.join(g.filter("n > 1 AND n_times <= 1"), keys).filter(authority("source") < F.col("top"))
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n_retracted"))


def lot_manager(lots: DataFrame, sells: DataFrame, allocated: DataFrame) -> dict[str, DataFrame]:
    """All that a lot manager shows of each key, as five tables:

    ``lots``: key, id, on, shares, price, cost_micros, allocated, remaining, status (closed, partial,
    open), closed_by; ``sells``: key, id, on, shares, price, allocated, remaining, status (completed,
    partial, pending), lines; ``positions``: key, bought, available, allocated, pending;
    ``timeline``: key, id, type, on, minutes, shares, price, n_lines, net (shares held after it);
    ``issues``: key, id, lot_id, code.

    Lots and sales: key, id, on, minutes, shares, price, fees, taxes; ``allocated``: sell_id, lot_id,
    shares, ord. Lines of unknown lots or sales count where they are known. Lists hold the lines of
    one lot or sale, in the order of ``ord``; statuses come from exact micro-shares.
    """
    m, back = (lambda df: micro_shares(df)), (lambda c: F.col(c) / F.lit(float(SHARE)))
    lots, sells = (x.withColumn("m", m(x)) for x in (lots, sells))
    lines = allocated.withColumn("lm", m(allocated))
    lines = lines.join(sells.select(F.col("id").alias("sell_id"), F.col("on").alias("sell_on"), F.col("key").alias("sell_key")), "sell_id", "left")
    # what allocates may be a whole match of lots and sales: it is made once, whatever tables look at it
    lines = durable(lines.join(lots.select(F.col("id").alias("lot_id"), F.col("on").alias("lot_on")), "lot_id", "left"), "lines")

    def of(side: str, other: str) -> DataFrame:
        line = F.struct("ord", F.col(f"{other}_id").alias("id"), F.col(f"{other}_on").alias("on"), back("lm").alias("shares"))
        listed = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["id"].alias("id"), x["on"].alias("on"), x["shares"].alias("shares")))
        return lines.groupBy(F.col(f"{side}_id").alias("id")).agg(F.sum("lm").alias("used"), F.count(F.lit(1)).alias("n_lines"), listed.alias("list"))

    def stated(df: DataFrame, side: str, other: str, words: tuple[str, str, str]) -> DataFrame:
        j = df.join(of(side, other), "id", "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn("n_lines", F.coalesce("n_lines", F.lit(0))).withColumn("left", F.col("m") - F.col("used"))
        return j.withColumn("status", F.when(F.col("left") <= 0, words[0]).when(F.col("used") > 0, words[1]).otherwise(words[2]))

    lot, sell = stated(lots, "lot", "sell", ("closed", "partial", "open")), stated(sells, "sell", "lot", ("completed", "partial", "pending"))
    cost = half_up((F.col("price") * F.col("shares") + F.coalesce("fees", F.lit(0.0)) + F.coalesce("taxes", F.lit(0.0))) * 1e6)
    held = lot.groupBy("key").agg(F.sum("m").alias("bought"), F.sum("left").alias("available"))
    owed = sell.groupBy("key").agg(F.sum("left").alias("pending"))
    taken = lines.filter("sell_key IS NOT NULL").groupBy(F.col("sell_key").alias("key")).agg(F.sum("lm").alias("allocated"))
    p = held.join(owed, "key", "full_outer").join(taken, "key", "full_outer").fillna(0, ["bought", "available", "pending", "allocated"])
    row = lambda df, type_, sign: df.select("key", "id", F.lit(type_).alias("type"), "on", "minutes", "shares", "price", "n_lines", (F.col("m") * sign).alias("move"))
    at = Window.partitionBy("key").orderBy("on", F.coalesce("minutes", F.lit(0)), "type", "id").rowsBetween(Window.unboundedPreceding, 0)
    timeline = row(lot, "BUY", 1).unionByName(row(sell, "SELL", -1)).withColumn("net", F.sum("move").over(at) / F.lit(float(SHARE))).drop("move")
    issue = lambda df, code, id_="id", lot_id=None: df.select("key", F.col(id_).alias("id") if id_ else F.lit(None).cast("string").alias("id"), F.col(lot_id).alias("lot_id") if lot_id else F.lit(None).cast("string").alias("lot_id"), F.lit(code).alias("code"))
    known = lines.filter("sell_key IS NOT NULL").withColumn("key", F.col("sell_key"))
    twice = known.groupBy("key", "sell_id", "lot_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    issues = issue(lot.filter("left < 0"), "negative-remaining", None, "id").unionByName(issue(sell.filter("left < 0"), "over-allocation")).unionByName(issue(sell.filter("status = 'pending'"), "missing-allocation"))
    issues = issues.unionByName(issue(twice, "duplicate-allocation", "sell_id", "lot_id")).unionByName(issue(known.filter("lot_on > sell_on").select("key", "sell_id", "lot_id").distinct(), "chronological-violation", "sell_id", "lot_id"))
    issues = issues.unionByName(issue(p.filter("allocated > bought"), "inventory-mismatch", None))
    shown = lambda df, name, *more: df.select("key", "id", "on", "shares", "price", *more, back("used").alias("allocated"), back("left").alias("remaining"), "status", F.coalesce("list", F.array().cast(df.schema["list"].dataType)).alias(name))
    return {
        "lots": shown(lot, "closed_by", cost.alias("cost_micros")), "sells": shown(sell, "lines"),
        "positions": p.select("key", *[back(c).alias(c) for c in ("bought", "available", "allocated", "pending")]), "timeline": timeline, "issues": issues,
    }
