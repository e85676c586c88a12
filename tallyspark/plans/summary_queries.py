"""Queries that put the analytics of each portfolio together, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import timeseries as T
from ..sources import adapters as S
from .analytics_queries import ORACLES as _A
from .analytics_queries import QUERIES as _QA
from .analytics_queries import _cash
from .oracle import r6
from .timeseries_queries import ORACLES as _T
from .timeseries_queries import QUERIES as _QT


def _returns(s, d):
    return T.total_returns(_QT["performance_curve"](s, d), _QA["exposure_cash_ratio"](s, d))


def _counted(name):
    return lambda s, d: _QT[name](s, d).groupBy("portfolio_id").agg(F.count(F.lit(1)).alias(f"n_{name.split('_')[0]}"))


def _summary(s, d):
    """The figures of one portfolio in one row; series and tables by their sizes."""
    closed = S.allocations(s, d).groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("closed_trades"))
    tags = _QA["strategy_attribution"](s, d).groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n_tags"))
    parts = {
        "sold": _QA["win_rate_profit_factor"](s, d), "means": _QA["avg_winner_loser_pct"](s, d), "held": _QA["holding_time_weighted"](s, d), "exposure": _QA["exposure_cash_ratio"](s, d).select("portfolio_id", "exposure", "cash_ratio", "deployment"),
        "drawdown": _QT["performance_drawdown"](s, d), "returns": _returns(s, d), "months": _counted("monthly_performance")(s, d), "years": _counted("annual_performance")(s, d),
        "health": _QA["portfolio_health"](s, d).select("portfolio_id", "health"), "tags": tags, "closed": closed, "open": _QA["open_position_stats"](s, d).select("portfolio_id", "win_rate", "profit_factor", "n_lots"),
    }
    return A.summary(parts, S.trades(s, d))


def _totals(s, d):
    returns = _returns(s, d).select("portfolio_id", "total_pct").join(_QA["exposure_cash_ratio"](s, d).select("portfolio_id", "deployment"), "portfolio_id", "full_outer")
    return A.dashboard_totals(_QA["portfolio_rollup"](s, d), _cash(s), returns)


QUERIES = {"total_returns": _returns, "analytics_summary": _summary, "dashboard_totals": _totals}

_CASH = "(SELECT p AS portfolio_id, (p + 1) * 5000000000000 AS cash FROM range(7) x(p))"
_RET = f"""SELECT portfolio_id, n_points, realized_pct, dividend_pct, portfolio_return, unrealized_pct, {r6("portfolio_return + unrealized_pct")} AS total_pct
FROM (SELECT portfolio_id, coalesce(n, 0) AS n_points, coalesce(rp, 0.0) AS realized_pct, coalesce(dp, 0.0) AS dividend_pct, {r6("coalesce(rp, 0.0) + coalesce(dp, 0.0)")} AS portfolio_return,
    coalesce(CASE WHEN cost_micros > 0 THEN {r6("(value_micros - cost_micros) / cost_micros * 100")} ELSE 0.0 END, 0.0) AS unrealized_pct
  FROM (SELECT portfolio_id, arg_max(realized_pct, day) AS rp, arg_max(dividend_pct, day) AS dp, count(*) AS n FROM ({_T["performance_curve"]}) GROUP BY 1) FULL JOIN ({_A["exposure_cash_ratio"]}) USING (portfolio_id))"""
_SUB = [
    _A["win_rate_profit_factor"], _A["avg_winner_loser_pct"], _A["holding_time_weighted"], f"SELECT portfolio_id, exposure, cash_ratio, deployment FROM ({_A['exposure_cash_ratio']})", _T["performance_drawdown"], _RET,
    f"SELECT portfolio_id, count(*) AS n_monthly FROM ({_T['monthly_performance']}) GROUP BY 1", f"SELECT portfolio_id, count(*) AS n_annual FROM ({_T['annual_performance']}) GROUP BY 1", f"SELECT portfolio_id, health FROM ({_A['portfolio_health']})",
    f"SELECT portfolio_id, count(*) AS n_tags FROM ({_A['strategy_attribution']}) GROUP BY 1", "SELECT l_partkey % 8 AS portfolio_id, count(*) AS closed_trades FROM lineitem GROUP BY 1",
    f"SELECT portfolio_id, win_rate AS open_win_rate, profit_factor AS open_profit_factor, n_lots FROM ({_A['open_position_stats']})",
]
_COLUMNS = "win_rate profit_factor avg_winner avg_loser holding_days exposure cash_ratio deployment max_drawdown n_points realized_pct dividend_pct portfolio_return unrealized_pct total_pct n_monthly n_annual health n_tags closed_trades open_win_rate open_profit_factor n_lots".split()
ORACLES = {
    "total_returns": _RET,
    "analytics_summary": "SELECT portfolio_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _COLUMNS) + " FROM (SELECT DISTINCT p_partkey % 8 AS portfolio_id FROM part)" + "".join(f"\nLEFT JOIN ({q}) USING (portfolio_id)" for q in _SUB),
    "dashboard_totals": f"""WITH j AS (SELECT portfolio_id, value_micros, cost_micros, unrealized_micros, realized_micros, dividend_micros, coalesce(cash, 0) AS cash, coalesce(total_pct, 0.0) AS tp, coalesce(deployment, 0.0) AS dep
  FROM ({_A["portfolio_rollup"]}) LEFT JOIN {_CASH} USING (portfolio_id) LEFT JOIN ({_RET}) USING (portfolio_id) LEFT JOIN (SELECT portfolio_id, deployment FROM ({_A["exposure_cash_ratio"]})) USING (portfolio_id)),
k AS (SELECT *, CAST(floor(tp * 1e6 + 0.5) AS BIGINT) AS pct, value_micros + cash AS assets FROM j)
SELECT CAST(sum(cash) AS BIGINT) AS cash_micros, CAST(sum(value_micros) AS BIGINT) AS value_micros, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, CAST(sum(realized_micros) AS BIGINT) AS realized_micros, CAST(sum(unrealized_micros) AS BIGINT) AS unrealized_micros,
  CAST(sum(dividend_micros) AS BIGINT) AS dividend_micros, CAST(floor(CAST(sum(CAST(pct AS HUGEINT) * assets) AS DOUBLE) / sum(assets) / 1e6 * 10000.0 + 0.5) AS BIGINT) / 10000.0::DOUBLE AS weighted_return,
  CAST(floor(sum(CAST(floor(dep * 1e6 + 0.5) AS BIGINT)) / count(*) / 1e6 * 10000.0 + 0.5) AS BIGINT) / 10000.0::DOUBLE AS mean_deployment, arg_min(portfolio_id, (-pct, portfolio_id)) AS best, arg_min(portfolio_id, (pct, portfolio_id)) AS worst FROM k""",
}
