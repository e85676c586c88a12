"""The ledger: live facts, cash, first-in first-out lots, balances, allocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up, to_micros

#: How a cash fact moves cash. Buys and withdrawals take, the rest give.
CASH_SIGN = {"BuyExecution": -1, "Withdrawal": -1, "SellExecution": 1, "DividendPayment": 1, "CashAdjustment": 1, "Deposit": 1}
CONTROL_KINDS = ["Correction", "Retraction", "PortfolioAssignment"]


def live_facts(facts: DataFrame) -> DataFrame:
    """Facts that no retraction targets; a retracted retraction still counts."""
    gone = facts.filter("kind = 'Retraction'").select(F.col("target_id").alias("id")).distinct()
    return facts.join(gone, "id", "left_anti")


def current_tickers(facts: DataFrame) -> DataFrame:
    """Each fact's ticker after the correction of largest seq that names one."""
    last = facts.filter("kind = 'Correction' AND patch_ticker IS NOT NULL").groupBy(F.col("target_id").alias("id")).agg(F.max_by("patch_ticker", "seq").alias("new_ticker"))
    return facts.join(last, "id", "left").withColumn("current_ticker", F.coalesce("new_ticker", "ticker")).drop("new_ticker")


def current_portfolios(facts: DataFrame) -> DataFrame:
    """Each fact's portfolio after the assignment of largest seq."""
    last = facts.filter("kind = 'PortfolioAssignment'").groupBy(F.col("target_id").alias("id")).agg(F.max_by("assigned_portfolio_id", "seq").alias("new_portfolio"))
    return facts.join(last, "id", "left").withColumn("current_portfolio", F.coalesce("new_portfolio", "portfolio_id")).drop("new_portfolio")


def relevant_facts(facts: DataFrame) -> DataFrame:
    """Live subject facts under their current ticker and portfolio."""
    f = current_portfolios(current_tickers(facts))
    return live_facts(f).filter(~F.col("kind").isin(CONTROL_KINDS))


def cash_projection(cash: DataFrame) -> DataFrame:
    """Balance by portfolio: the reset of largest seq, and what follows it by seq.

    The reset is found by an aggregate and joined back, so a portfolio of any size needs no
    window over all its rows.
    """
    reset = cash.filter("kind = 'CashReset'").groupBy("portfolio_id").agg(F.max("seq").alias("reset_seq"), F.max_by("amount", "seq").alias("reset_amount"))
    sign = F.create_map(*[F.lit(x) for kv in CASH_SIGN.items() for x in kv])[F.col("kind")]
    later = cash.join(reset, "portfolio_id", "left").filter("reset_seq IS NULL OR seq > reset_seq")
    moved = later.groupBy("portfolio_id").agg(F.sum(F.when(F.col("kind") != "CashReset", to_micros("amount") * sign)).alias("moved"), F.count(F.lit(1)).alias("n_after"))
    all_ = cash.select("portfolio_id").distinct().join(reset, "portfolio_id", "left").join(moved, "portfolio_id", "left")
    return all_.select("portfolio_id", (F.coalesce(to_micros("reset_amount"), F.lit(0)) + F.coalesce("moved", F.lit(0))).alias("cash_micros"), F.coalesce("n_after", F.lit(0)).cast("bigint").alias("n_after"))


SHARE = 1_000_000  # micro-shares: running sums and bounds of intervals are exact on this axis


def _whole(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")


def micro_shares(df: DataFrame, c: str = "shares") -> Column:
    """A column of shares, whole or not, as micro-shares; less than half of one is dust."""
    return F.col(c).cast("bigint") * F.lit(SHARE).cast("bigint") if _whole(df, c) else half_up(F.col(c).cast("double") * F.lit(float(SHARE)))


def shares_of(micros: str, whole: bool) -> Column:
    """Micro-shares as shares: whole numbers stay what they are."""
    return F.expr(f"{micros} div {SHARE}") if whole else F.col(micros) / F.lit(float(SHARE))


def fifo_timeline(facts: DataFrame, keys: list[str], order: list[str], at: str = "execution_date") -> DataFrame:
    """Executions with their micro-shares (micros), and running ones: bought (cb), sold (cs) and
    sold that lots could serve (eff).

    A sale is served from lots bought before it; what they lack is dropped, not carried. With
    U the largest shortage so far, E = CS - U is what has been taken from the lots.
    """
    w = Window.partitionBy(*keys).orderBy(at, F.col("kind") != "BuyExecution", *order).rowsBetween(Window.unboundedPreceding, 0)
    f = facts if "micros" in facts.columns else facts.withColumn("micros", micro_shares(facts))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("micros")).otherwise(0)).over(w)
    run = f.withColumn("cb", of("BuyExecution")).withColumn("cs", of("SellExecution"))
    return run.withColumn("eff", F.col("cs") - F.greatest(F.lit(0), F.max(F.col("cs") - F.col("cb")).over(w)))


def fifo_open_lots(timeline: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Lots with what first-in first-out sales leave of them, emptied ones left out."""
    last = timeline.groupBy(*keys).agg(F.max("eff").alias("e"))
    lots = timeline.filter("kind = 'BuyExecution'").join(last, keys)
    left = F.greatest(F.lit(0), F.col("cb") - F.greatest(F.col("cb") - F.col("micros"), F.col("e"))).cast("bigint")
    lots = lots.withColumn("left", left).filter("left > 0")
    return lots.select(*keys, *keep, "shares", shares_of("left", _whole(timeline, "shares")).alias("remaining"))


def fifo_matches(timeline: DataFrame, keys: list[str], lot_id: Column, sell_id: Column) -> DataFrame:
    """(keys, lot_id, sell_id, matched): the pairs of the first-in first-out match.

    Lots and sales are intervals on one axis of shares. Both are cut at all bounds of the key:
    with the sorted bounds, a lot covers a run of pieces, and so does a sale, and a piece
    belongs to the last lot and the last sale that start at or before it. So matching is two
    running lookups, with no join of lots against sales.
    """
    lots = timeline.filter("kind = 'BuyExecution' AND micros > 0").select(*keys, (F.col("cb") - F.col("micros")).alias("lo"), F.col("cb").alias("hi"), lot_id.alias("lot_id"))
    sells = timeline.filter("kind = 'SellExecution'").withColumn("prev", F.coalesce(F.lag("eff").over(Window.partitionBy(*keys).orderBy("cs")), F.lit(0)))
    sells = sells.filter("eff > prev").select(*keys, F.col("prev").alias("lo"), F.col("eff").alias("hi"), sell_id.alias("sell_id"))
    points = lots.select(*keys, F.col("lo").alias("at"), "lot_id", F.col("hi").alias("lot_hi"), F.lit(None).cast(sells.schema["sell_id"].dataType).alias("sell_id"), F.lit(None).cast("bigint").alias("sell_hi"))
    points = points.unionByName(sells.select(*keys, F.col("lo").alias("at"), F.lit(None).cast(lots.schema["lot_id"].dataType).alias("lot_id"), F.lit(None).cast("bigint").alias("lot_hi"), "sell_id", F.col("hi").alias("sell_hi")))
    points = points.groupBy(*keys, "at").agg(F.max("lot_id").alias("lot_id"), F.max("lot_hi").alias("lot_hi"), F.max("sell_id").alias("sell_id"), F.max("sell_hi").alias("sell_hi"))
    run = Window.partitionBy(*keys).orderBy("at")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    p = points.withColumn("next", F.lead("at").over(run))
    for c in ("lot_id", "lot_hi", "sell_id", "sell_hi"):
        p = p.withColumn(c, F.last(c, ignorenulls=True).over(upto))
    size = F.least("lot_hi", "sell_hi", F.coalesce("next", F.col("lot_hi"))) - F.col("at")
    both = p.withColumn("part", size.cast("bigint")).filter("lot_id IS NOT NULL AND sell_id IS NOT NULL AND part > 0").groupBy(*keys, "lot_id", "sell_id").agg(F.sum("part").alias("part"))
    return both.select(*keys, "lot_id", "sell_id", shares_of("part", _whole(timeline, "shares")).alias("matched"))


def holdings(lots: DataFrame, sells: DataFrame, allocations: DataFrame, keys: list[str]) -> DataFrame:
    """Lots with what explicit allocations, and then first-in first-out sales, leave of them.

    ``lots``: keys, id, at (its time, compared as text), shares, price, fees, taxes; ``sells``: keys,
    id, at, shares; ``allocations``: ord, sell_id, lot_id, shares. A line takes what its lot still
    has at most; sales then take what their lines lack from lots no later than they. Gives keys,
    id, remaining, cost_micros; lots with no more than a micro-share left are left out.
    """
    whole = _whole(lots, "shares")
    lots, sells = (x.withColumn("held", micro_shares(x)) for x in (lots, sells))
    a = allocations.withColumn("ask", F.greatest(micro_shares(allocations), F.lit(0))).join(lots.select(F.col("id").alias("lot_id"), "held"), "lot_id")
    before = F.coalesce(F.sum("ask").over(Window.partitionBy("lot_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = a.withColumn("got", F.least("ask", F.greatest(F.lit(0), F.col("held") - before)))
    gone = lambda c: a.groupBy(F.col(c).alias("id")).agg(F.sum("got").alias("gone"))
    left = lambda df, c: df.join(gone(c), "id", "left").withColumn("micros", F.greatest(F.lit(0), F.col("held") - F.coalesce("gone", F.lit(0))).cast("bigint"))
    paid = ["price", "fees", "taxes"]  # what lots cost goes along with them, so they aren't joined again
    row = lambda df, kind, *more: df.filter("micros > 0").select(*keys, F.lit(kind).alias("kind"), "at", "id", "shares", "micros", *more)
    both = row(left(lots, "lot_id"), "BuyExecution", *paid).unionByName(row(left(sells, "sell_id"), "SellExecution"), allowMissingColumns=True)
    t = fifo_timeline(both, keys, ["id"], "at").withColumn("e", F.max("eff").over(Window.partitionBy(*keys)))
    open_ = t.filter("kind = 'BuyExecution'").withColumn("left", F.greatest(F.lit(0), F.col("cb") - F.greatest(F.col("cb") - F.col("micros"), F.col("e"))).cast("bigint"))
    open_ = open_.filter("left > 1")
    cost = to_micros(F.col("price") * F.col("shares") + F.coalesce("fees", F.lit(0.0)) + F.coalesce("taxes", F.lit(0.0)))
    remaining = shares_of("left", whole)
    return open_.select(*keys, "id", remaining.alias("remaining"), half_up(cost * remaining / F.col("shares")).alias("cost_micros"))


def propose_fifo(lots: DataFrame, need: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What one sale a key takes from each lot dated no later than it: (keys..., take)."""
    j = lots.join(need, keys).filter("execution_date <= sell_date")
    w = Window.partitionBy(*keys).orderBy("execution_date", *order).rowsBetween(Window.unboundedPreceding, -1)
    whole = _whole(lots, "remaining") and _whole(need, "need")
    j = j.withColumn("left", micro_shares(j, "remaining"))
    before = F.coalesce(F.sum("left").over(w), F.lit(0))
    j = j.withColumn("take", F.least("left", F.greatest(F.lit(0), micro_shares(j, "need") - before)).cast("bigint")).filter("take > 0")
    return j.drop("left").withColumn("take", shares_of("take", whole))


def last_balanced_date(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The last day on which shares net to zero (less than a micro-share off), null if the last day
    does too or none does. Sums are of micro-shares, so 0.1 + 0.2 - 0.3 is nothing."""
    m = micro_shares(facts)
    days = facts.groupBy(*keys, "execution_date").agg(F.sum(F.when(F.col("kind") == "BuyExecution", m).otherwise(-m)).alias("net"))
    run = days.withColumn("balance", F.sum("net").over(Window.partitionBy(*keys).orderBy("execution_date").rowsBetween(Window.unboundedPreceding, 0)))
    g = run.groupBy(*keys).agg(F.max(F.when(F.col("balance") == 0, F.col("execution_date"))).alias("d"), F.max("execution_date").alias("last"), F.sum("net").alias("net"))
    return g.select(*keys, F.when(F.col("d") < F.col("last"), F.col("d")).alias("balanced_on"), shares_of("net", _whole(facts, "shares")).alias("net_shares"))


def sell_orders(facts: DataFrame) -> DataFrame:
    """Sales regrouped by their group, else by date, price to 4 places and time."""
    price = F.floor(F.col("price") * 10000 + 0.5)
    s = facts.filter("kind = 'SellExecution'")
    return s.groupBy("portfolio_id", "ticker_id", "execution_date", price.alias("price4"), F.coalesce("minutes", F.lit(-1)).alias("at")).agg(F.sum("shares").alias("shares"), F.count(F.lit(1)).alias("n"))


def unallocated_sells(sells: DataFrame, allocated: DataFrame) -> DataFrame:
    """Sales of which less is allocated than sold. (sell_id, shares) and (sell_id, shares)"""
    a = allocated.groupBy("sell_id").agg(F.sum("shares").alias("allocated"))
    j = sells.join(a, "sell_id", "left").withColumn("allocated", F.coalesce("allocated", F.lit(0)))
    return j.filter("allocated < shares - 0.000001")


def split_tickers(facts: DataFrame) -> DataFrame:
    """Tickers held in more than one portfolio, with those portfolios in order."""
    each = facts.select("ticker_id", "portfolio_id").distinct()
    g = each.groupBy("ticker_id").agg(F.count(F.lit(1)).alias("n_portfolios"), F.array_join(F.transform(F.sort_array(F.collect_list("portfolio_id")), lambda x: x.cast("string")), ",").alias("portfolios"))
    return g.filter("n_portfolios > 1")


def timeline_by_day(cash: DataFrame) -> DataFrame:
    return cash.groupBy(F.to_date("ts").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(to_micros("amount")).alias("amount_micros"))


def sell_outcomes(realized: DataFrame, lots: DataFrame) -> DataFrame:
    """By sell group: proceeds, result, and whether it is a full sale (one line that closes its
    lot) or a partial one."""
    closed = lots.select("trade_id", (F.col("remaining_shares") <= 0).alias("closes"))
    j = realized.join(closed, "trade_id")
    g = j.groupBy("sell_group_id").agg(F.sum(F.col("pnl_micros") + F.col("cost_micros")).alias("proceeds_micros"), F.sum("pnl_micros").alias("pnl_micros"), F.count(F.lit(1)).alias("n"), F.bool_and("closes").alias("c"))
    return g.select("sell_group_id", "proceeds_micros", "pnl_micros", F.when((F.col("n") == 1) & F.col("c"), "Sell").otherwise("PartialSell").alias("event"))
