"""Portfolio analytics: realized and open results, attribution, allocation, health.

Every function takes DataFrames and gives one; all portfolios are computed at once. Money is
summed as integer micros, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, from_micros, half_up, money_div, ratio_pct, round_to, to_micros
from ..scratch import durable


def unit_cost() -> Column:
    return F.col("entry_price") + (F.col("fees") + F.col("taxes")) / F.col("shares")


def unit_proceeds() -> Column:
    return F.col("exit_price") - (F.col("a_fees") + F.col("a_taxes")) / F.col("shares_closed")


def realized(allocations: DataFrame, trades: DataFrame, strict: bool = True) -> DataFrame:
    """Allocations with their lot: pnl_micros, cost_micros, return_pct, days.

    ``strict``: an allocation without its trade fails the query; else it is left out.
    """
    a = allocations.withColumnsRenamed({"fees": "a_fees", "taxes": "a_taxes", "execution_date": "exit_date", "portfolio_id": "a_portfolio_id"})
    j = a.join(trades, "trade_id", "left" if strict else "inner")
    if strict:
        j = j.withColumn("shares", F.when(F.col("shares").isNull(), F.raise_error(F.lit("allocation without its trade")).cast("double")).otherwise(F.col("shares")))
    closed = F.col("shares_closed")
    return j.select(
        F.col("a_portfolio_id").alias("portfolio_id"), "trade_id", "ticker", "sector", "sell_group_id", "shares_closed", "exit_date", "execution_date", "strategy_tags_raw",
        to_micros((unit_proceeds() - unit_cost()) * closed).alias("pnl_micros"), to_micros(unit_cost() * closed).alias("cost_micros"),
        ((unit_proceeds() - unit_cost()) / unit_cost() * 100).alias("return_pct"), F.datediff("exit_date", "execution_date").alias("days"),
    )


def realized_pnl_by_portfolio(r: DataFrame) -> DataFrame:
    return r.groupBy("portfolio_id").agg(F.sum("pnl_micros").alias("pnl_micros"), F.sum("cost_micros").alias("cost_micros"), F.count(F.lit(1)).alias("n_allocations"))


def profit_factor(pnl: str = "pnl_micros") -> Column:
    """Gains over losses; infinite with gains alone, zero with neither."""
    gain = F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0))
    loss = F.sum(F.when(F.col(pnl) < 0, -F.col(pnl)).otherwise(0))
    return F.when(loss > 0, round_to(gain / F.when(loss > 0, loss), 6)).when(gain > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def win_rate(pnl: str = "pnl_micros") -> Column:
    n = F.count(F.lit(1))
    return F.when(n > 0, F.count_if(F.col(pnl) > 0) / n * 100).otherwise(F.lit(0.0))


def win_rate_profit_factor(r: DataFrame) -> DataFrame:
    return r.groupBy("portfolio_id").agg(round_to(win_rate(), 6).alias("win_rate"), profit_factor().alias("profit_factor"))


def avg_winner_loser(r: DataFrame) -> DataFrame:
    """Mean return of winners and of losers, each allocation's return in micros of a percent."""
    p = to_micros("return_pct")
    mean = lambda cond: F.coalesce(F.sum(F.when(cond, p)).cast("double") / F.count_if(cond) / 1e6, F.lit(0.0))
    safe = lambda cond: F.when(F.count_if(cond) > 0, mean(cond)).otherwise(F.lit(0.0))
    return r.groupBy("portfolio_id").agg(round_to(safe(F.col("return_pct") > 0), 6).alias("avg_winner"), round_to(safe(F.col("return_pct") < 0), 6).alias("avg_loser"))


def holding_time(r: DataFrame) -> DataFrame:
    shares = F.sum("shares_closed")
    return r.groupBy("portfolio_id").agg(round_to(F.when(shares > 0, F.sum(F.col("days") * F.col("shares_closed")) / shares).otherwise(F.lit(0.0)), 6).alias("holding_days"))


def open_lots(trades: DataFrame, allocations: DataFrame) -> DataFrame:
    """Lots with remaining shares, status and remaining cost in micros."""
    closed = allocations.groupBy("trade_id").agg(F.sum("shares_closed").alias("closed"))
    left = F.col("shares") - F.coalesce("closed", F.lit(0.0))
    lots = trades.join(closed, "trade_id", "left").withColumn("remaining_shares", F.greatest(left, F.lit(0.0)))
    total = to_micros(F.col("shares") * F.col("entry_price") + F.col("fees") + F.col("taxes"))
    status = F.when(F.col("remaining_shares") <= 0, "closed").when(F.col("remaining_shares") < F.col("shares"), "partial").otherwise("open")
    return lots.withColumn("status", status).withColumn("cost_micros", half_up(total * F.col("remaining_shares") / F.col("shares")))


def positions(lots: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Open positions by portfolio and ticker; value and unrealized result null without a price."""
    p = lots.filter("remaining_shares > 0").groupBy("portfolio_id", "ticker").agg(F.sum("remaining_shares").alias("shares"), F.sum("cost_micros").alias("cost_micros"), F.count(F.lit(1)).alias("n_lots"))
    p = p.withColumn("avg_cost_micros", money_div("cost_micros", "shares"))
    if prices is None:
        return p
    value = half_up(F.col("price") * 1e6 * F.col("shares"))
    return p.join(prices, "ticker", "left").withColumn("value_micros", value).withColumn("unrealized_micros", F.col("value_micros") - F.col("cost_micros")).drop("price")


def open_position_stats(lots: DataFrame, prices: DataFrame, today) -> DataFrame:
    """Of priced open lots: winners by money, averages in percent, weighted days."""
    o = lots.filter("remaining_shares > 0").join(prices, "ticker")
    o = o.withColumn("pnl_micros", half_up(F.col("price") * 1e6 * F.col("remaining_shares")) - F.col("cost_micros"))
    o = o.withColumn("pct", (F.col("price") - unit_cost()) / unit_cost() * 100).withColumn("days", F.datediff(F.lit(today).cast("date"), "execution_date"))
    p = to_micros("pct")
    mean = lambda cond: F.when(F.count_if(cond) > 0, F.sum(F.when(cond, p)).cast("double") / F.when(F.count_if(cond) > 0, F.count_if(cond)) / 1e6).otherwise(F.lit(0.0))
    return o.groupBy("portfolio_id").agg(
        round_to(win_rate(), 6).alias("win_rate"), profit_factor().alias("profit_factor"), round_to(mean(F.col("pnl_micros") > 0), 6).alias("avg_winner"),
        round_to(mean(F.col("pnl_micros") < 0), 6).alias("avg_loser"), round_to(F.max("pct"), 6).alias("best_pct"), round_to(F.min("pct"), 6).alias("worst_pct"),
        round_to(F.sum(F.col("days") * F.col("remaining_shares")) / F.sum("remaining_shares"), 6).alias("holding_days"), F.count(F.lit(1)).alias("n_lots"),
    )


def portfolio_health(lots: DataFrame, prices: DataFrame, cash: DataFrame, r: DataFrame) -> DataFrame:
    """Open lots, concentration, largest position, best and worst realized return, health; a lot
    without a price counts at entry price.

    ``cash``: portfolio_id, cash_micros; ``r``: realized allocations. Ties of the largest go to
    the ticker that sorts first. Without realized allocations best and worst are 0.
    """
    v = lots.filter("remaining_shares > 0").join(prices, "ticker", "left").withColumn("v", half_up(F.coalesce("price", "entry_price") * 1e6 * F.col("remaining_shares")))
    t = v.groupBy("portfolio_id", "ticker").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("k"))
    total = F.sum("v").over(Window.partitionBy("portfolio_id"))
    t = t.withColumn("w", F.when(total > 0, F.col("v") / F.when(total > 0, total)).otherwise(F.lit(0.0)))
    g = t.groupBy("portfolio_id").agg(
        F.sum("v").alias("value_micros"), F.sum("k").alias("open_trades"), (F.sum(half_up(F.col("w") * F.col("w") * 1e12)) / 1e12).alias("hhi"),
        F.min_by("ticker", F.struct(-F.col("v"), F.col("ticker"))).alias("largest_ticker"), F.max("w").alias("w"),
    )
    g = g.join(cash, "portfolio_id", "left").withColumn("cash_micros", F.coalesce("cash_micros", F.lit(0)))
    g = g.join(r.groupBy("portfolio_id").agg(F.max("return_pct").alias("best"), F.min("return_pct").alias("worst")), "portfolio_id", "left").fillna(0.0, ["best", "worst"])
    equity = F.col("value_micros") + F.col("cash_micros")
    diversification = (1 - F.col("hhi")) * 100
    cash_pct = ratio_pct("cash_micros", equity)
    cash_score = F.when(F.col("value_micros") > 0, F.greatest(F.lit(0.0), 100 - 2 * F.abs(cash_pct - 20))).otherwise(F.lit(0.0))
    return g.select(
        "portfolio_id", "value_micros", "open_trades", round_to("best", 6).alias("largest_winner"), round_to("worst", 6).alias("largest_loser"), round_to("hhi", 6).alias("hhi"), round_to(diversification, 6).alias("diversification"), "largest_ticker",
        round_to(F.col("w") * 100, 6).alias("largest_pct"), round_to(cash_pct, 6).alias("cash_pct"), round_to(clamp(diversification * 0.6 + cash_score * 0.4, 0.0, 100.0), 6).alias("health"),
    )


def sector_allocation(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """Value (else cost) and share by sector; ord puts Unclassified last, else larger first."""
    v = lots.filter("remaining_shares > 0").join(prices, "ticker", "left").withColumn("v", F.coalesce(half_up(F.col("price") * 1e6 * F.col("remaining_shares")), "cost_micros"))
    s = v.filter("v > 0").groupBy("portfolio_id", F.coalesce("sector", F.lit("Unclassified")).alias("sector")).agg(F.sum("v").alias("value_micros"))
    w = Window.partitionBy("portfolio_id")
    rank = F.row_number().over(w.orderBy((F.col("sector") == "Unclassified").cast("int"), F.desc("value_micros"), "sector"))
    return s.select("portfolio_id", "sector", "value_micros", round_to(F.col("value_micros") / F.sum("value_micros").over(w) * 100, 6).alias("pct"), rank.alias("ord"))


def strategy_attribution(trades: DataFrame, r: DataFrame, journal: DataFrame | None = None) -> DataFrame:
    """Results by tag, by falling result (``ord``; ties by tag).

    ``trades``: portfolio_id, trade_id, tags; ``journal``: trade_id, ord, tags. A trade has its
    own tags and those of its last journal entry, each once; it counts in full for each of
    them, sold or not. Allocations are summed by trade before tags multiply them.
    """
    t = trades.select("portfolio_id", "trade_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    if journal is not None:
        last = journal.groupBy("trade_id").agg(F.max_by("tags", "ord").alias("more"))
        t = t.join(last, "trade_id", "left").withColumn("tags", F.array_union("tags", F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    gain, loss = (F.sum(F.greatest(F.lit(0), sign * F.col("pnl_micros"))) for sign in (1, -1))
    sums = {"n": F.count(F.lit(1)), "wins": F.count_if(F.col("pnl_micros") > 0), "gain": gain, "loss": loss, "pnl": F.sum("pnl_micros"), "cost": F.sum("cost_micros")}
    by_trade = r.groupBy("trade_id").agg(*[v.alias(k) for k, v in sums.items()])
    each = t.select("portfolio_id", "trade_id", F.explode(F.array_distinct("tags")).alias("tag")).filter("tag <> ''").join(by_trade, "trade_id", "left").fillna(0, list(sums))
    g = each.groupBy("portfolio_id", "tag").agg(F.count(F.lit(1)).alias("n_trades"), *[F.sum(k).alias(k) for k in sums])
    part = lambda x, y, scale=1.0: F.when(F.col(y) > 0, F.col(x) / F.when(F.col(y) > 0, F.col(y)) * scale).otherwise(F.lit(0.0))
    factor = F.when(F.col("loss") > 0, round_to(part("gain", "loss"), 6)).when(F.col("gain") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("pnl"), "tag"))
    return g.select(
        "portfolio_id", "tag", rank.alias("ord"), "n_trades", F.col("n").alias("n_allocations"), round_to(part("wins", "n", 100.0), 6).alias("win_rate"), factor.alias("profit_factor"),
        F.col("pnl").alias("pnl_micros"), F.when(F.col("n") > 0, money_div("pnl", "n")).otherwise(0).alias("avg_pnl_micros"), round_to(part("pnl", "cost", 100.0), 6).alias("return_pct"),
    )


def exposure(lots: DataFrame, prices: DataFrame, cash: DataFrame) -> DataFrame:
    """Cost of all open lots, value of the priced ones, and their ratios to equity."""
    o = lots.filter("remaining_shares > 0").join(prices, "ticker", "left")
    g = o.groupBy("portfolio_id").agg(F.sum("cost_micros").alias("cost_micros"), F.coalesce(F.sum(half_up(F.col("price") * 1e6 * F.col("remaining_shares"))), F.lit(0)).alias("value_micros"))
    g = g.join(cash, "portfolio_id", "left").withColumn("cash_micros", F.coalesce("cash_micros", F.lit(0)))
    equity = F.col("value_micros") + F.col("cash_micros")
    return g.select("portfolio_id", "cost_micros", "value_micros", "cash_micros", round_to(ratio_pct("value_micros", equity), 6).alias("exposure"), round_to(ratio_pct("cash_micros", equity), 6).alias("cash_ratio"), round_to(ratio_pct("cost_micros", equity), 6).alias("deployment"))


def status_counts(lots: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return lots.groupBy("ticker").agg(n("open"), n("partial"), n("closed"))


def portfolio_rollup(positions: DataFrame, r: DataFrame, dividends: DataFrame) -> DataFrame:
    """By portfolio: value (cost where no price is known), cost, realized and unrealized results,
    dividends, in micros."""
    p = positions.groupBy("portfolio_id").agg(F.sum(F.coalesce("value_micros", "cost_micros")).alias("value_micros"), F.sum("cost_micros").alias("cost_micros"), F.sum(F.coalesce("unrealized_micros", F.lit(0))).alias("unrealized_micros"))
    a = r.groupBy("portfolio_id").agg(F.sum("pnl_micros").alias("realized_micros"))
    d = dividends.groupBy("portfolio_id").agg(F.sum("amount_micros").alias("dividend_micros"))
    sums = ["value_micros", "cost_micros", "unrealized_micros", "realized_micros", "dividend_micros"]
    return p.join(a, "portfolio_id", "full_outer").join(d, "portfolio_id", "full_outer").fillna(0, sums).select("portfolio_id", *sums)


def dashboard_totals(rollup: DataFrame, cash: DataFrame, returns: DataFrame) -> DataFrame:
    """One row over all portfolios: sums, return weighted by assets, mean deployment, and the best
    and worst portfolio by total return (ties: the smallest id).

    Sums are whole whatever their size: 64-bit integers, and decimals where one of them passes those.
    ``returns``: portfolio_id, total_pct, deployment.
    """
    j = rollup.join(cash, "portfolio_id", "left").join(returns, "portfolio_id", "left").fillna(0, ["cash_micros"]).fillna(0.0, ["total_pct", "deployment"])
    assets = F.col("value_micros") + F.col("cash_micros")
    pct = to_micros("total_pct")
    money = ["cash_micros", "value_micros", "cost_micros", "realized_micros", "unrealized_micros", "dividend_micros"]
    wide = lambda x: F.sum(x.cast("decimal(20,0)"))
    g = j.agg(
        *[wide(F.col(c)).alias(c) for c in money], wide(assets).alias("assets_micros"), F.sum(pct.cast("decimal(19,0)") * assets.cast("decimal(19,0)")).cast("double").alias("weighted"), (F.sum(to_micros("deployment")) / F.count(F.lit(1))).alias("deployed"),
        F.min_by("portfolio_id", F.struct(-pct, F.col("portfolio_id"))).alias("best"), F.min_by("portfolio_id", F.struct(pct, F.col("portfolio_id"))).alias("worst"),
    )
    g = durable(g, "totals")  # one row, whose sums tell their type
    if g.filter(F.greatest(*[F.abs(c) for c in money]) > F.lit(2**63 - 1)).isEmpty():
        g = g.withColumns({c: F.col(c).cast("bigint") for c in money})
    weighted = F.when(F.col("assets_micros") > 0, F.col("weighted") / F.when(F.col("assets_micros") > 0, F.col("assets_micros").cast("double")) / 1e6).otherwise(F.lit(0.0))
    return g.select(*money, round_to(weighted, 4).alias("weighted_return"), round_to(F.col("deployed") / 1e6, 4).alias("mean_deployment"), "best", "worst")


def summary(parts: dict[str, DataFrame], portfolios: DataFrame) -> DataFrame:
    """One flat row a portfolio: the columns of all parts side by side, each named after its part
    where a name occurs twice; numbers that a part has none of are 0."""
    seen: set[str] = {"portfolio_id"}
    out = portfolios.select("portfolio_id").distinct()
    for name, df in parts.items():
        new = [(c, c if c not in seen else f"{name}_{c}") for c in df.columns if c != "portfolio_id"]
        seen |= {n for _, n in new}
        out = out.join(df.select("portfolio_id", *[F.col(c).alias(n) for c, n in new]), "portfolio_id", "left")
    return out.fillna(0)
