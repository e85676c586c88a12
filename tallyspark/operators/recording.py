"""Recording: what buys, sales, moves, deletions, corrections and cash operations do to a ledger,
for whole tables of such requests at once.

Nothing is changed in place: each function gives the rows to append, the new state, the change
of cash by portfolio in micros, or the faults for which a request is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import normalize_ticker, to_micros
from .graph import components

#: Operations on cash and the sign of their amount.
CASH_SIGNS = {"dividend": 1, "delete-dividend": -1, "adjust": 1, "deposit": 1, "withdrawal": -1, "split": 0, "rights-issue": 0}
EVENTS = {"dividend": "Dividend", "adjust": "CashAdjustment", "deposit": "Deposit", "withdrawal": "Withdrawal", "split": "Split", "rights-issue": "RightsIssue"}


def cost_micros() -> Column:
    """What a buy costs: shares times price, fees and taxes, each rounded."""
    return to_micros(F.col("shares") * F.col("entry_price")) + to_micros("fees") + to_micros("taxes")


def proceeds_micros() -> Column:
    return to_micros(F.col("shares_closed") * F.col("exit_price")) - to_micros("fees") - to_micros("taxes")


def buy_effects(trades: DataFrame) -> DataFrame:
    """A timeline event for each buy: portfolio_id, trade_id, type, timestamp, ticker, amount and
    change of cash. An unknown time is midnight."""
    at = F.concat_ws("T", F.date_format("execution_date", "yyyy-MM-dd"), F.coalesce("execution_time", F.lit("00:00")) if "execution_time" in trades.columns else F.lit("00:00"))
    return trades.select("portfolio_id", "trade_id", F.lit("Buy").alias("type"), at.alias("timestamp"), normalize_ticker("ticker").alias("ticker"), cost_micros().alias("amount_micros"), (-cost_micros()).alias("cash_micros"))


def allocation_faults(lines: DataFrame, lots: DataFrame, sells: DataFrame, held: DataFrame) -> DataFrame:
    """(sell_id, lot_id, fault) of requested allocations. Any fault refuses the sale's whole request.

    ``lines``: sell_id, lot_id, shares; ``lots``: lot_id, remaining, bought_on; ``sells``: sell_id,
    sold, sold_on; ``held``: sell_id, lot_id, shares that the sale has from the lot already.
    """
    n = lines.groupBy("sell_id", "lot_id").agg(F.count(F.lit(1)).alias("times"))
    own = held.groupBy("sell_id", "lot_id").agg(F.sum("shares").alias("own"))
    j = lines.join(n, ["sell_id", "lot_id"]).join(sells, "sell_id", "left").join(lots, "lot_id", "left").join(own, ["sell_id", "lot_id"], "left").fillna(0, ["own"])
    total = lines.groupBy("sell_id").agg(F.sum("shares").alias("asked")).join(sells, "sell_id").filter("asked > sold")
    fault = (
        F.when(F.col("sold").isNull(), "no such sale").when(F.col("shares") <= 0, "shares must be positive").when(F.col("times") > 1, "lot named twice").when(F.col("remaining").isNull(), "no such lot")
        .when(F.col("bought_on") > F.col("sold_on"), "lot is later than the sale").when(F.col("shares") > F.col("remaining") + F.col("own"), "more than the lot has")
    )
    each = j.select("sell_id", "lot_id", fault.alias("fault")).filter("fault IS NOT NULL").distinct()
    return each.unionByName(total.select("sell_id", F.lit(None).cast(lines.schema["lot_id"].dataType).alias("lot_id"), F.lit("more than the sale closed").alias("fault")))


def allocation_decisions(lines: DataFrame, faults: DataFrame, live: DataFrame, resets: DataFrame) -> DataFrame:
    """Facts to append: a Retraction of each sale's live decision (``live``: sell_id, decision_id)
    that a request without fault, or a reset (``resets``: sell_id), replaces, and the new
    decisions of the requests with their lines."""
    good = lines.join(faults.select("sell_id").distinct(), "sell_id", "left_anti")
    named = good.select("sell_id").unionByName(resets.select("sell_id")).distinct()
    gone = live.join(named, "sell_id").select(F.lit("Retraction").alias("kind"), "sell_id", F.col("decision_id").alias("target_id"), F.lit(None).cast("array<struct<lot_id:string,shares:double>>").alias("lines"))
    line = F.struct(F.col("lot_id").cast("string").alias("lot_id"), F.col("shares").cast("double").alias("shares"))
    new = good.groupBy("sell_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return gone.unionByName(new.select(F.lit("SellAllocationDecision").alias("kind"), "sell_id", F.lit(None).cast(live.schema["decision_id"].dataType).alias("target_id"), "lines"))


def trade_groups(trades: DataFrame, allocations: DataFrame) -> DataFrame:
    """(trade_id, group): trades that shared sales tie together within their portfolio, directly or
    not; the group is named by its smallest trade. Ids are numbers."""
    a = allocations.select("trade_id", "sell_group_id").join(trades.select("trade_id", "portfolio_id"), "trade_id").select("portfolio_id", "trade_id", "sell_group_id").distinct()
    # a sale is named by its smallest trade in the portfolio, so trades alone are nodes
    sale = a.groupBy("portfolio_id", "sell_group_id").agg(F.min("trade_id").alias("first"))
    links = a.join(sale, ["portfolio_id", "sell_group_id"]).select(F.col("trade_id").alias("a"), F.col("first").alias("b"))
    c = components(links).select(F.col("node").alias("trade_id"), F.col("comp").alias("group"))
    return trades.select("trade_id").join(c, "trade_id", "left").select("trade_id", F.coalesce("group", "trade_id").alias("group"))


def moves(trades: DataFrame, allocations: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moved, cash): requests (trade_id, target) take all trades of a group along. ``moved``:
    trade_id, source, target; of several requests for a group the smallest trade's counts.
    ``cash``: portfolio_id, cash_micros; the source gets back what the group cost net of its
    sales, the target pays it."""
    g = trade_groups(trades, allocations)
    want = requests.join(g, "trade_id").groupBy("group").agg(F.min_by("target", "trade_id").alias("target"))
    moved = trades.select("trade_id", F.col("portfolio_id").alias("source"), cost_micros().alias("cost")).join(g, "trade_id").join(want, "group").filter("source <> target")
    sold = allocations.groupBy("trade_id").agg(F.sum(proceeds_micros()).alias("proceeds"))
    net = moved.join(sold, "trade_id", "left").withColumn("net", F.col("cost") - F.coalesce("proceeds", F.lit(0)))
    cash = net.select(F.col("source").alias("portfolio_id"), F.col("net").alias("c")).unionByName(net.select(F.col("target").alias("portfolio_id"), (-F.col("net")).alias("c")))
    return moved.select("trade_id", "source", "target"), cash.groupBy("portfolio_id").agg(F.sum("c").alias("cash_micros"))


def consolidate(trades: DataFrame, allocations: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``moves``, for all trades of the tickers in ``targets`` (ticker, target) elsewhere."""
    t = trades.join(targets, "ticker").filter(F.col("portfolio_id") != F.col("target"))
    return moves(trades, allocations, t.select("trade_id", "target"))


def deletions(lots: DataFrame, requests: DataFrame) -> DataFrame:
    """(trade_id, portfolio_id, fault, cash_micros): trades to delete; one that doesn't exist, or
    against which shares are closed, is refused, else its cost is refunded."""
    j = requests.select("trade_id").distinct().join(lots, "trade_id", "left")
    fault = F.when(F.col("shares").isNull(), "no such trade").when(F.col("remaining_shares") != F.col("shares"), "shares are closed against it")
    return j.select("trade_id", "portfolio_id", fault.alias("fault"), F.when(fault.isNull(), cost_micros()).alias("cash_micros"))


def renamed(rows: DataFrame, renames: DataFrame, column: str = "ticker") -> DataFrame:
    """Rows with tickers renamed; ``renames``: old, new. Both are normalised; an empty new name, or
    the same one, changes nothing. ``was_renamed`` tells which rows changed."""
    r = renames.select(normalize_ticker("old").alias("_old"), normalize_ticker("new").alias("_new")).filter("_new <> '' AND _new <> _old").groupBy("_old").agg(F.min("_new").alias("_new"))
    j = rows.join(r, normalize_ticker(column) == F.col("_old"), "left")
    return j.withColumn(column, F.coalesce("_new", column)).withColumn("was_renamed", F.col("_new").isNotNull()).drop("_old", "_new")


def date_corrections(trades: DataFrame, allocations: DataFrame, requests: DataFrame, start, today) -> DataFrame:
    """(trade_id, new_date, fault): corrections (trade_id, new_date); refused before the tracking
    start, ahead of today, for unknown trades, and after the lot's first sale."""
    first = allocations.groupBy("trade_id").agg(F.min("execution_date").alias("first_sale"))
    j = requests.join(trades.select("trade_id", F.lit(True).alias("known")), "trade_id", "left").join(first, "trade_id", "left")
    day = F.col("new_date")
    fault = F.when(day < F.lit(start).cast("date"), "before tracking").when(day > F.lit(today).cast("date"), "in the future").when(F.col("known").isNull(), "no such trade").when(day > F.col("first_sale"), "after its first sale")
    return j.select("trade_id", "new_date", fault.alias("fault"))


def cash_operations(ops: DataFrame, cash: DataFrame, start) -> tuple[DataFrame, DataFrame]:
    """(operations with fault, event and cash_micros; cash after them). Operations: seq,
    portfolio_id, op, amount, day. ``set`` counts from its place on: of each portfolio the last
    one and what follows it. Dividends must be positive and not before the tracking start;
    splits and rights issues are on record only."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    fault = F.when((F.col("op") == "dividend") & ~F.coalesce(F.col("amount") > 0, F.lit(False)), "dividend must be positive").when((F.col("op") == "dividend") & (F.col("day") < F.lit(start).cast("date")), "before tracking").when(~F.col("op").isin("set", *CASH_SIGNS), "unknown operation")
    o = ops.withColumn("fault", fault).withColumn("event", F.when(fault.isNull(), pairs(EVENTS)[F.col("op")])).withColumn("cash_micros", F.when(fault.isNull() & (F.col("op") != "set"), to_micros(F.coalesce("amount", F.lit(0.0))) * pairs(CASH_SIGNS)[F.col("op")]))
    good = o.filter("fault IS NULL")
    last = good.filter("op = 'set'").groupBy("portfolio_id").agg(F.max("seq").alias("from_seq"), F.max_by("amount", "seq").alias("base"))
    sums = good.join(last, "portfolio_id", "left").filter("from_seq IS NULL OR seq > from_seq").groupBy("portfolio_id").agg(F.sum("cash_micros").alias("change"))
    j = cash.join(last, "portfolio_id", "full_outer").join(sums, "portfolio_id", "left")
    after = F.coalesce(to_micros("base"), F.col("cash_micros"), F.lit(0)) + F.coalesce("change", F.lit(0))
    return o, j.select("portfolio_id", after.alias("cash_micros"))


def pending_states(pending: DataFrame, confirmations: DataFrame, sold: DataFrame) -> DataFrame:
    """Pending executions after their confirmations and sales: a confirmed buy is executed at once,
    a confirmed sale when its lots are allocated.

    ``pending``: id, side, status (needs-confirmation or other), shares, price, number;
    ``confirmations``: id, ord, c_shares, c_price, c_number, the first counts; ``sold``: id,
    sell_group_id. Gives verification, execution, shares and price in force, number, and
    whether a confirmation was refused (more than one, or not awaited).
    """
    c = confirmations.groupBy("id").agg(F.min_by(F.struct("c_shares", "c_price", "c_number"), "ord").alias("c"), F.count(F.lit(1)).alias("k"))
    j = pending.join(c, "id", "left").join(sold, "id", "left")
    ok = (F.col("status") == "needs-confirmation") & F.col("k").isNotNull()
    verified = ok | (F.col("status") == "verified")
    executed = (F.col("side") == "BUY") & ok | verified & F.col("sell_group_id").isNotNull()
    pick = lambda new, old: F.when(ok, F.coalesce(F.col(f"c.{new}"), F.col(old))).otherwise(F.col(old))
    return j.select("id", "side", F.when(ok, "verified").otherwise(F.col("status")).alias("verification"), F.when(executed, "executed").otherwise("pending").alias("execution"), pick("c_shares", "shares").alias("shares"), pick("c_price", "price").alias("price"), pick("c_number", "number").alias("number"), (F.coalesce("k", F.lit(0)) > F.when(ok, 1).otherwise(0)).alias("refused"))


def projection(events: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, event_id, trade_id, action): committed lots against stored trades: of one key
    they are matched in their order, one to one; the rest is created or deleted.

    Events: keys, event_id, ord; trades: keys, trade_id, ord.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    e, t = events.select(*keys, "event_id", rank.alias("rank")), trades.select(*keys, "trade_id", rank.alias("rank"))
    action = F.when(F.col("trade_id").isNull(), "create").when(F.col("event_id").isNull(), "delete").otherwise("keep")
    return e.join(t, [*keys, "rank"], "full_outer").select(*keys, "rank", "event_id", "trade_id", action.alias("action"))
