"""Performance over time: deltas, curve, periods, drawdown, prices as of a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import round_to, to_micros
from .analytics import unit_cost


def dated_deltas(realized: DataFrame, trades: DataFrame, dividends: DataFrame | None = None) -> DataFrame:
    """(portfolio_id, day, is_buy, invested, released, pnl, dividend) in micros.

    Of one day releases come before investments, so capital that is recycled within it isn't
    counted twice at the peak.
    """
    zero = F.lit(0).cast("bigint")
    buys = trades.select("portfolio_id", F.col("execution_date").alias("day"), F.lit(1).alias("is_buy"), to_micros(unit_cost() * F.col("shares")).alias("invested"), zero.alias("released"), zero.alias("pnl"), zero.alias("dividend"))
    sells = realized.select("portfolio_id", F.col("exit_date").alias("day"), F.lit(0).alias("is_buy"), zero.alias("invested"), F.col("cost_micros").alias("released"), F.col("pnl_micros").alias("pnl"), zero.alias("dividend"))
    out = buys.unionByName(sells)
    if dividends is not None:
        out = out.unionByName(dividends.select("portfolio_id", "day", F.lit(0).alias("is_buy"), zero.alias("invested"), zero.alias("released"), zero.alias("pnl"), F.col("amount_micros").alias("dividend")))
    return out


def daily_states(deltas: DataFrame) -> DataFrame:
    """The last state of each day: running result, dividends, open cost and its peak so far.

    Deltas of one day and side are added up first: between them the open cost moves one way
    only (releases down, then investments up), so the peak is the same and the window has at
    most two rows a day, however many trades a portfolio has.
    """
    d = deltas.groupBy("portfolio_id", "day", "is_buy").agg(*[F.sum(c).alias(c) for c in ("invested", "released", "pnl", "dividend")])
    w = Window.partitionBy("portfolio_id").orderBy("day", "is_buy").rowsBetween(Window.unboundedPreceding, 0)
    run = d.select("portfolio_id", "day", "is_buy", F.sum("pnl").over(w).alias("pnl"), F.sum("dividend").over(w).alias("dividend"), F.sum(F.col("invested") - F.col("released")).over(w).alias("open"))
    peak = run.withColumn("peak", F.greatest(F.lit(0), F.max("open").over(w)))
    return peak.groupBy("portfolio_id", "day").agg(*[F.max_by(c, "is_buy").alias(c) for c in ("pnl", "dividend", "open", "peak")])


def performance_curve(deltas: DataFrame, today) -> DataFrame:
    """(portfolio_id, day, realized_pct, dividend_pct) of each day with a delta, and today's."""
    s = daily_states(deltas)
    last = s.groupBy("portfolio_id").agg(F.max("day").alias("d"), *[F.max_by(c, "day").alias(c) for c in ("pnl", "dividend", "open", "peak")])
    day = F.lit(today).cast("date")
    out = s.unionByName(last.filter(F.col("d") < day).drop("d").withColumn("day", day))
    pct = lambda c: round_to(F.when(F.col("peak") > 0, F.col(c) / F.when(F.col("peak") > 0, F.col("peak")) * 100).otherwise(F.lit(0.0)), 6)
    return out.select("portfolio_id", "day", pct("pnl").alias("realized_pct"), pct("dividend").alias("dividend_pct"))


def max_drawdown(curve: DataFrame) -> DataFrame:
    """Largest fall, in points, from the best total so far; the start counts as 0."""
    w = Window.partitionBy("portfolio_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    t = curve.withColumn("total", F.col("realized_pct") + F.col("dividend_pct"))
    t = t.withColumn("fall", F.greatest(F.lit(0.0), F.max("total").over(w)) - F.col("total"))
    return t.groupBy("portfolio_id").agg(round_to(F.max("fall"), 6).alias("max_drawdown"))


def price_as_of(probes: DataFrame, prices: DataFrame, key: str, day: str = "day") -> DataFrame:
    """Probes with the latest close on or before their day, never a later one; null before the
    first. One shuffle by key for both sides, no range join."""
    p = prices.select(key, F.col("price_date").alias("_day"), F.lit(0).alias("_probe"), F.col("close").alias("_close"))
    q = probes.withColumn("_day", F.col(day)).withColumn("_probe", F.lit(1))
    both = q.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_day", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("close", F.last("_close", ignorenulls=True).over(w)).filter("_probe = 1").drop("_day", "_probe", "_close")


def unrealized_by_period(trades: DataFrame, allocations: DataFrame, prices: DataFrame, today, unit: str = "month") -> DataFrame:
    """(portfolio_id, period, unrealized_micros) of the lots open at each period's end, today's at
    the latest, at the last close on or before it; tickers without a close count nothing.

    ``prices``: ticker, price_date, close. A lot is a step function of time: allocations before
    its own day count from that day, and one that is closed beyond its shares counts nothing.
    Steps are summed by ticker and period before they are laid out over the periods, so the
    rows follow tickers times periods, not lots times periods.
    """
    end = F.lit(today).cast("date")
    t = trades.select("trade_id", "portfolio_id", "ticker", "shares", F.col("execution_date").alias("bought"), unit_cost().alias("unit"))
    sold = allocations.groupBy("trade_id", F.col("execution_date").alias("day")).agg(F.sum("shares_closed").alias("closed"))
    steps = t.select("trade_id", F.col("bought").alias("day"), F.lit(0.0).alias("closed")).unionByName(sold)
    steps = steps.join(t, "trade_id").groupBy("trade_id", "portfolio_id", "ticker", "shares", "unit", F.greatest("day", "bought").alias("day")).agg(F.sum("closed").alias("closed"))
    w = Window.partitionBy("trade_id").orderBy("day")
    left = F.greatest(F.lit(0.0), F.col("shares") - F.sum("closed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    steps = steps.withColumn("left", left).withColumn("cost", to_micros(F.col("left") * F.col("unit")))
    steps = steps.withColumn("step", F.col("left") - before("left")).withColumn("cost_step", F.col("cost") - before("cost")).filter(F.col("day") <= end)
    by_period = steps.groupBy("portfolio_id", "ticker", F.trunc("day", unit).alias("period")).agg(F.sum("step").alias("shares"), F.sum("cost_step").alias("cost_micros"))
    spine = by_period.groupBy("portfolio_id", "ticker").agg(F.min("period").alias("p")).select("portfolio_id", "ticker", F.explode(F.sequence("p", F.trunc(end, unit), F.expr(f"interval 1 {unit}"))).alias("period"))
    run = Window.partitionBy("portfolio_id", "ticker").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    held = spine.join(by_period, ["portfolio_id", "ticker", "period"], "left")
    held = held.select("portfolio_id", "ticker", "period", F.sum(F.coalesce("shares", F.lit(0.0))).over(run).alias("shares"), F.sum(F.coalesce("cost_micros", F.lit(0))).over(run).alias("cost_micros"))
    last_day = F.least(F.date_add(F.add_months("period", 12 if unit == "year" else 1), -1), end)
    probes = held.select("ticker", "period").distinct().withColumn("day", last_day)
    closes = price_as_of(probes, prices, "ticker").filter("close IS NOT NULL").select("ticker", "period", "close")
    value = to_micros(F.col("close") * F.col("shares")) - F.col("cost_micros")
    return held.join(closes, ["ticker", "period"]).groupBy("portfolio_id", "period").agg(F.sum(value).alias("unrealized_micros"))


def period_performance(deltas: DataFrame, today, unit: str = "month", unrealized: DataFrame | None = None) -> DataFrame:
    """Every period from the first activity to today: own results, and the change of
    ``unrealized`` results within it, over the peak of open cost through the period's end."""
    s = daily_states(deltas)
    end = F.lit(today).cast("date")
    first = s.groupBy("portfolio_id").agg(F.min("day").alias("d")).filter(F.col("d") <= end)
    spine = first.select("portfolio_id", F.explode(F.sequence(F.trunc("d", unit), F.trunc(end, unit), F.expr(f"interval 1 {unit}"))).alias("period"))
    own = s.groupBy("portfolio_id", F.trunc("day", unit).alias("period")).agg(*[F.max_by(c, "day").alias(c) for c in ("pnl", "dividend", "peak")])
    w = Window.partitionBy("portfolio_id").orderBy("period")
    j = spine.join(own, ["portfolio_id", "period"], "left")
    filled = j.select("portfolio_id", "period", *[F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias(c) for c in ("pnl", "dividend", "peak")])
    own_of = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    if unrealized is None:
        filled = filled.withColumn("unrealized_micros", F.lit(0).cast("bigint"))
    else:
        filled = filled.join(unrealized, ["portfolio_id", "period"], "left").fillna(0, ["unrealized_micros"])
    f = filled.withColumn("own_pnl", own_of("pnl")).withColumn("own_div", own_of("dividend")).withColumn("own_open", own_of("unrealized_micros"))
    pct = lambda c: round_to(F.when(F.col("peak") > 0, F.col(c) / F.when(F.col("peak") > 0, F.col("peak")) * 100).otherwise(F.lit(0.0)), 6)
    return f.select("portfolio_id", F.date_format("period", "yyyy-MM-dd").alias("period"), F.col("own_pnl").alias("pnl_micros"), pct("own_pnl").alias("realized_pct"), pct("own_div").alias("dividend_pct"), pct("own_open").alias("unrealized_pct"))


def comparison_curve(curve: DataFrame) -> DataFrame:
    """Realized and dividend return together, of each portfolio on all days that any has from its
    first on, carried forward."""
    days = curve.select("day").distinct()
    last = days.agg(F.max("day")).first()[0]
    each = curve.groupBy("portfolio_id").agg(F.min("day").alias("first"))
    spine = each.select("portfolio_id", F.explode(F.sequence("first", F.lit(last).cast("date"))).alias("day")).join(days, "day", "left_semi")
    w = Window.partitionBy("portfolio_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = curve.select("portfolio_id", "day", (F.col("realized_pct") + F.col("dividend_pct")).alias("total"))
    return spine.join(total, ["portfolio_id", "day"], "left").select("portfolio_id", "day", round_to(F.last("total", ignorenulls=True).over(w), 6).alias("return_pct"))


def monthly_mean(periods: DataFrame) -> DataFrame:
    """Plain mean over the portfolios of a period's realized, dividend and unrealized return."""
    total = to_micros("realized_pct") + to_micros("dividend_pct") + to_micros("unrealized_pct")
    return periods.groupBy("period").agg((F.sum(total) / F.count(F.lit(1)) / 1e6).alias("m"), F.count(F.lit(1)).alias("n")).select("period", round_to("m", 4).alias("mean_pct"), "n")


def total_returns(curve: DataFrame, exposure: DataFrame) -> DataFrame:
    """(portfolio_id, n_points, realized_pct, dividend_pct, portfolio_return, unrealized_pct,
    total_pct): the curve's end, and the open result over its cost. Zero where nothing is known."""
    j = curve_end(curve).join(exposure.select("portfolio_id", "value_micros", "cost_micros"), "portfolio_id", "full_outer").fillna(0).fillna(0.0)
    open_pct = round_to(F.when(F.col("cost_micros") > 0, (F.col("value_micros") - F.col("cost_micros")) / F.when(F.col("cost_micros") > 0, F.col("cost_micros")) * 100).otherwise(F.lit(0.0)), 6)
    own = round_to(F.col("realized_pct") + F.col("dividend_pct"), 6)
    j = j.withColumn("portfolio_return", own).withColumn("unrealized_pct", open_pct)
    return j.select("portfolio_id", "n_points", "realized_pct", "dividend_pct", "portfolio_return", "unrealized_pct", round_to(F.col("portfolio_return") + F.col("unrealized_pct"), 6).alias("total_pct"))


def curve_end(curve: DataFrame) -> DataFrame:
    """The last point of each portfolio's curve, and how many points it has."""
    return curve.groupBy("portfolio_id").agg(F.max_by("realized_pct", "day").alias("realized_pct"), F.max_by("dividend_pct", "day").alias("dividend_pct"), F.count(F.lit(1)).alias("n_points"))


def frozen_history(prices: DataFrame, key: str) -> DataFrame:
    """Series of 10 or more closes of which 9 in 10 are the same, and those too short to use."""
    by_value = prices.groupBy(key, "close").count().groupBy(key).agg(F.sum("count").alias("n"), F.max("count").alias("same"))
    return by_value.select(key, "n", ((F.col("n") >= 10) & (F.col("same") * 10 >= F.col("n") * 9)).alias("frozen"), (F.col("n") < 30).alias("needs_backfill"))


def choose_quote(quotes: DataFrame, now, fresh_days: int = 7) -> DataFrame:
    """One quote a ticker: the first provider's fresh one, else one of unknown time, else the
    latest. (ticker, provider_rank, price, quoted_at)"""
    age = F.datediff(F.lit(now).cast("date"), F.to_date("quoted_at"))
    order = F.when(age <= fresh_days, 0).when(F.col("quoted_at").isNull(), 1).otherwise(2)
    newest = F.when(order == 2, -F.unix_timestamp(F.to_timestamp("quoted_at"))).otherwise(F.lit(0))
    return quotes.groupBy("ticker").agg(F.min_by(F.struct("price", "provider_rank"), F.struct(order.alias("o"), newest.alias("t"), F.col("provider_rank"))).alias("q")).select("ticker", "q.price", "q.provider_rank")


def epoch_closes(df: DataFrame) -> DataFrame:
    """(ticker, day, close) from arrays of epoch seconds and closes; null closes drop out."""
    z = df.select("ticker", F.explode(F.arrays_zip("timestamps", "closes")).alias("z"))
    return z.filter("z.closes IS NOT NULL").select("ticker", F.to_date(F.timestamp_seconds("z.timestamps")).alias("day"), F.col("z.closes").alias("close"))


def anchor_estimates(df: DataFrame, today) -> DataFrame:
    """(ticker, day, estimate): the price some days ago from today's and the change in percent."""
    return df.select("ticker", F.date_sub(F.lit(today).cast("date"), F.col("days_ago")).alias("day"), round_to(F.col("price") / (1 + F.col("pct") / 100), 2).alias("estimate"))
