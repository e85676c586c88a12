"""Time-series queries over the adapters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import timeseries as T
from ..sources import adapters as S
from .oracle import ALLOCATIONS, PRICES, REALIZED, TRADES, r6, with_

TODAY = "2002-01-15"


def _deltas(s, d):
    trades = S.trades(s, d)
    return T.dated_deltas(A.realized(S.allocations(s, d), trades), trades, S.dividends(s, d))


def _periods_of(s, d, unit):
    open_ = T.unrealized_by_period(S.trades(s, d), S.allocations(s, d), S.brand_prices(s, d), TODAY, unit)
    return T.period_performance(_deltas(s, d), TODAY, unit, open_)


def _probes(s, d):
    o = S.table(s, d, "orders")
    return o.select("o_orderkey", (F.col("o_custkey") % 40).alias("ticker_id"), F.to_date("o_orderdate").alias("day"))


def _curve(s, d):
    return T.performance_curve(_deltas(s, d), TODAY)


QUERIES = {
    "performance_curve": _curve,
    "performance_drawdown": lambda s, d: T.max_drawdown(_curve(s, d)),
    "monthly_performance": lambda s, d: _periods_of(s, d, "month"),
    "annual_performance": lambda s, d: _periods_of(s, d, "year"),
    "monthly_mean_across_portfolios": lambda s, d: T.monthly_mean(_periods_of(s, d, "month")),
    "unrealized_by_month": lambda s, d: T.unrealized_by_period(S.trades(s, d), S.allocations(s, d), S.brand_prices(s, d), TODAY).withColumn("period", F.date_format("period", "yyyy-MM-dd")),
    "price_as_of": lambda s, d: T.price_as_of(_probes(s, d), S.prices(s, d), "ticker_id"),
    "comparison_curve_ffill": lambda s, d: T.comparison_curve(_curve(s, d)),
    "frozen_history": lambda s, d: T.frozen_history(S.prices(s, d), "ticker_id"),
}

_D = """dv AS (SELECT user_id % 8 AS portfolio_id, CAST(DATE '2000-01-01' + CAST(event_id % 600 AS INTEGER) AS DATE) AS day, CAST(floor(value * 1e6 + 0.5) AS BIGINT) AS amount FROM events WHERE event_type = 'click'),
d AS (
SELECT portfolio_id, execution_date AS day, 1 AS is_buy, CAST(floor((entry_price + (fees + taxes) / shares) * shares * 1e6 + 0.5) AS BIGINT) AS inv, 0 AS pnl, 0 AS div, row_number() OVER () AS o FROM v_trades
UNION ALL SELECT portfolio_id, exit_date, 0, -cost, pnl, 0, row_number() OVER () FROM r
UNION ALL SELECT portfolio_id, day, 0, 0, 0, amount, 1000000000000 + row_number() OVER () FROM dv),
run AS (SELECT *, sum(pnl) OVER w AS cp, sum(div) OVER w AS cd, sum(inv) OVER w AS op FROM d WINDOW w AS (PARTITION BY portfolio_id ORDER BY day, is_buy, o ROWS UNBOUNDED PRECEDING)),
pk AS (SELECT *, greatest(0, max(op) OVER (PARTITION BY portfolio_id ORDER BY day, is_buy, o ROWS UNBOUNDED PRECEDING)) AS peak FROM run),
st AS (SELECT portfolio_id, day, arg_max(cp, (is_buy, o)) AS pnl, arg_max(cd, (is_buy, o)) AS div, arg_max(peak, (is_buy, o)) AS peak FROM pk GROUP BY 1, 2)"""
_PCT, _DIV, _OWN = (r6(f"CASE WHEN peak > 0 THEN {x} / peak * 100 ELSE 0.0 END") for x in ("pnl", "div", "un"))
_CURVE = f"""cv AS (SELECT portfolio_id, day, {_PCT} AS realized_pct, {_DIV} AS dividend_pct FROM (
SELECT * FROM st UNION ALL SELECT portfolio_id, DATE '{TODAY}', arg_max(pnl, day), arg_max(div, day), arg_max(peak, day) FROM st GROUP BY 1))"""
_BASE = with_(TRADES, ALLOCATIONS, REALIZED, _D)


def _open_results(unit: str) -> str:
    """Lot by lot and period by period, as the definition has it."""
    return f"""bp AS (SELECT upper(p_brand) AS ticker, CAST(l_shipdate AS DATE) AS price_date, CAST(floor(sum(CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT)) / count(*) + 0.5) AS BIGINT) / 100.0::DOUBLE AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
pe AS (SELECT period, least(CAST(period + INTERVAL 1 {unit} AS DATE) - 1, DATE '{TODAY}') AS e FROM (SELECT CAST(unnest(generate_series(date_trunc('{unit}', DATE '1995-01-01'), date_trunc('{unit}', DATE '{TODAY}'), INTERVAL 1 {unit})) AS DATE) AS period)),
lf AS (SELECT t.trade_id, t.portfolio_id, t.ticker, period, e, any_value(t.entry_price + (t.fees + t.taxes) / t.shares) AS unit, greatest(0.0, any_value(t.shares) - coalesce(sum(shares_closed) FILTER (a.execution_date <= e), 0.0)) AS l
  FROM v_trades t CROSS JOIN pe LEFT JOIN v_allocations a ON a.trade_id = t.trade_id WHERE t.execution_date <= e GROUP BY 1, 2, 3, 4, 5),
ul AS (SELECT portfolio_id, ticker, period, e, sum(l) AS shares, CAST(sum(CAST(floor(l * unit * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS cost FROM lf GROUP BY ALL),
un AS (SELECT portfolio_id, period, CAST(sum(CAST(floor(close * shares * 1e6 + 0.5) AS BIGINT) - cost) AS BIGINT) AS un FROM ul ASOF JOIN bp ON ul.ticker = bp.ticker AND ul.e >= bp.price_date GROUP BY 1, 2)"""


def _periods(unit: str) -> str:
    return _open_results(unit) + f""",
sp AS (SELECT portfolio_id, CAST(unnest(generate_series(date_trunc('{unit}', min(day)), date_trunc('{unit}', DATE '{TODAY}'), INTERVAL 1 {unit})) AS DATE) AS period FROM st GROUP BY 1),
ow AS (SELECT portfolio_id, CAST(date_trunc('{unit}', day) AS DATE) AS period, arg_max(pnl, day) AS pnl, arg_max(div, day) AS div, arg_max(peak, day) AS peak FROM st GROUP BY 1, 2),
fl AS (SELECT portfolio_id, period, coalesce(last_value(pnl IGNORE NULLS) OVER w, 0) AS pnl, coalesce(last_value(div IGNORE NULLS) OVER w, 0) AS div, coalesce(last_value(peak IGNORE NULLS) OVER w, 0) AS peak, coalesce(un, 0) AS un
  FROM sp LEFT JOIN ow USING (portfolio_id, period) LEFT JOIN un USING (portfolio_id, period) WINDOW w AS (PARTITION BY portfolio_id ORDER BY period ROWS UNBOUNDED PRECEDING)),
oo AS (SELECT portfolio_id, period, peak, pnl - coalesce(lag(pnl) OVER v, 0) AS pnl, div - coalesce(lag(div) OVER v, 0) AS div, un - coalesce(lag(un) OVER v, 0) AS un FROM fl WINDOW v AS (PARTITION BY portfolio_id ORDER BY period)),
pf AS (SELECT portfolio_id, strftime(period, '%Y-%m-%d') AS period, CAST(pnl AS BIGINT) AS pnl_micros, {_PCT} AS realized_pct, {_DIV} AS dividend_pct, {_OWN} AS unrealized_pct FROM oo)"""


def _q(*parts: str, select: str) -> str:
    return _BASE.rstrip() + ",\n" + ",\n".join(parts) + "\n" + select


ORACLES = {
    "performance_curve": _q(_CURVE, select="SELECT * FROM cv"),
    "performance_drawdown": _q(_CURVE, select=f"SELECT portfolio_id, {r6('max(fall)')} AS max_drawdown FROM (SELECT portfolio_id, greatest(0.0, max(realized_pct + dividend_pct) OVER (PARTITION BY portfolio_id ORDER BY day ROWS UNBOUNDED PRECEDING)) - (realized_pct + dividend_pct) AS fall FROM cv) GROUP BY 1"),
    "monthly_performance": _q(_periods("month"), select="SELECT * FROM pf"),
    "annual_performance": _q(_periods("year"), select="SELECT * FROM pf"),
    "monthly_mean_across_portfolios": _q(_periods("month"), select="SELECT period, CAST(floor(sum(CAST(floor(realized_pct * 1e6 + 0.5) AS BIGINT) + CAST(floor(dividend_pct * 1e6 + 0.5) AS BIGINT) + CAST(floor(unrealized_pct * 1e6 + 0.5) AS BIGINT)) / count(*) / 1e6 * 10000.0 + 0.5) AS BIGINT) / 10000.0::DOUBLE AS mean_pct, count(*) AS n FROM pf GROUP BY 1"),
    "unrealized_by_month": _q(_open_results("month"), select="SELECT portfolio_id, strftime(period, '%Y-%m-%d') AS period, un AS unrealized_micros FROM un"),
    "price_as_of": with_(PRICES) + "SELECT o_orderkey, o.ticker_id, o.day, p.close FROM (SELECT o_orderkey, o_custkey % 40 AS ticker_id, CAST(o_orderdate AS DATE) AS day FROM orders) o ASOF LEFT JOIN v_prices p ON o.ticker_id = p.ticker_id AND o.day >= p.price_date",
    "comparison_curve_ffill": _q(_CURVE, select=f"""SELECT s.portfolio_id, s.day, {r6("last_value(realized_pct + dividend_pct IGNORE NULLS) OVER (PARTITION BY s.portfolio_id ORDER BY s.day ROWS UNBOUNDED PRECEDING)")} AS return_pct
FROM (SELECT portfolio_id, day FROM (SELECT portfolio_id, min(day) AS first FROM cv GROUP BY 1) JOIN (SELECT DISTINCT day FROM cv) ON day >= first) s LEFT JOIN cv USING (portfolio_id, day)"""),
    "frozen_history": with_(PRICES) + "SELECT ticker_id, CAST(sum(k) AS BIGINT) AS n, sum(k) >= 10 AND max(k) * 10 >= sum(k) * 9 AS frozen, sum(k) < 30 AS needs_backfill FROM (SELECT ticker_id, close, count(*) AS k FROM v_prices GROUP BY 1, 2) GROUP BY 1",
}
