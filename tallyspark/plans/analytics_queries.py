"""Analytics queries over the adapters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..sources import adapters as S
from .oracle import ALLOCATIONS, LOTS, PF, REALIZED, TRADES, WIN, mean_pct, r6, with_

TODAY = "2002-01-01"


def _r(spark, d):
    return A.realized(S.allocations(spark, d), S.trades(spark, d))


def _lots(spark, d):
    return A.open_lots(S.trades(spark, d), S.allocations(spark, d))


def _cash(spark: SparkSession) -> DataFrame:
    """Cash of seven of the eight portfolios; the last has none on record."""
    return spark.range(7).select(F.col("id").alias("portfolio_id"), ((F.col("id") + 1) * F.lit(5_000_000_000_000)).alias("cash_micros"))


QUERIES = {
    "realized_pnl_by_portfolio": lambda s, d: A.realized_pnl_by_portfolio(_r(s, d)),
    "win_rate_profit_factor": lambda s, d: A.win_rate_profit_factor(_r(s, d)),
    "avg_winner_loser_pct": lambda s, d: A.avg_winner_loser(_r(s, d)),
    "holding_time_weighted": lambda s, d: A.holding_time(_r(s, d)),
    "positions_by_ticker": lambda s, d: A.positions(_lots(s, d), S.lot_prices(s, d)),
    "open_position_stats": lambda s, d: A.open_position_stats(_lots(s, d), S.lot_prices(s, d), TODAY),
    "portfolio_health": lambda s, d: A.portfolio_health(_lots(s, d), S.lot_prices(s, d), _cash(s), _r(s, d)),
    "sector_allocation": lambda s, d: A.sector_allocation(_lots(s, d), S.lot_prices(s, d)),
    "strategy_attribution": lambda s, d: A.strategy_attribution(S.trades(s, d), _r(s, d), S.journal(s, d)),
    "exposure_cash_ratio": lambda s, d: A.exposure(_lots(s, d), S.lot_prices(s, d), _cash(s)),
    "status_counts": lambda s, d: A.status_counts(_lots(s, d)),
    "portfolio_rollup": lambda s, d: A.portfolio_rollup(A.positions(_lots(s, d), S.lot_prices(s, d)), _r(s, d), S.dividends(s, d)),
}

_BASE = with_(TRADES, ALLOCATIONS, REALIZED)
_OPEN = with_(TRADES, ALLOCATIONS, LOTS)
_ALL = with_(TRADES, ALLOCATIONS, REALIZED, LOTS)
_VALUE = "CAST(floor(price * 1e6 * rem + 0.5) AS BIGINT)"
_EXPOSURE = f"""e AS (SELECT portfolio_id, CAST(cost AS BIGINT) AS cost_micros, CAST(value AS BIGINT) AS value_micros, coalesce(cash, 0) AS cash_micros,
  {r6("CASE WHEN value + coalesce(cash, 0) > 0 THEN value / (value + coalesce(cash, 0)) * 100 ELSE 0 END")} AS exposure,
  {r6("CASE WHEN value + coalesce(cash, 0) > 0 THEN coalesce(cash, 0) / (value + coalesce(cash, 0)) * 100 ELSE 0 END")} AS cash_ratio,
  {r6("CASE WHEN value + coalesce(cash, 0) > 0 THEN cost / (value + coalesce(cash, 0)) * 100 ELSE 0 END")} AS deployment
FROM (SELECT portfolio_id, sum(cost) AS cost, coalesce(sum({_VALUE}), 0) AS value FROM lots LEFT JOIN px USING (ticker) WHERE rem > 0 GROUP BY 1) LEFT JOIN cash USING (portfolio_id))"""

ORACLES = {
    "realized_pnl_by_portfolio": _BASE + "SELECT portfolio_id, CAST(sum(pnl) AS BIGINT) AS pnl_micros, CAST(sum(cost) AS BIGINT) AS cost_micros, count(*) AS n_allocations FROM r GROUP BY 1",
    "win_rate_profit_factor": _BASE + f"SELECT portfolio_id, {WIN} AS win_rate, {PF} AS profit_factor FROM r GROUP BY 1",
    "avg_winner_loser_pct": _BASE + f"SELECT portfolio_id, {mean_pct('pct > 0')} AS avg_winner, {mean_pct('pct < 0')} AS avg_loser FROM r GROUP BY 1",
    "holding_time_weighted": _BASE + f"SELECT portfolio_id, {r6('sum(days * shares_closed) / sum(shares_closed)')} AS holding_days FROM r GROUP BY 1",
    "positions_by_ticker": _OPEN + """SELECT portfolio_id, ticker, shares, cost_micros, n_lots, CAST(floor(cost_micros / shares + 0.5) AS BIGINT) AS avg_cost_micros,
  CAST(floor(price * 1e6 * shares + 0.5) AS BIGINT) AS value_micros, CAST(floor(price * 1e6 * shares + 0.5) AS BIGINT) - cost_micros AS unrealized_micros
FROM (SELECT portfolio_id, ticker, sum(rem) AS shares, CAST(sum(cost) AS BIGINT) AS cost_micros, count(*) AS n_lots FROM lots WHERE rem > 0 GROUP BY 1, 2) LEFT JOIN px USING (ticker)""",
    "open_position_stats": _OPEN + f"""SELECT portfolio_id, {WIN} AS win_rate, {PF} AS profit_factor, {mean_pct('pnl > 0')} AS avg_winner, {mean_pct('pnl < 0')} AS avg_loser,
  {r6('max(pct)')} AS best_pct, {r6('min(pct)')} AS worst_pct, {r6('sum(days * rem) / sum(rem)')} AS holding_days, count(*) AS n_lots
FROM (SELECT portfolio_id, rem, {_VALUE} - cost AS pnl, (price - (entry_price + (fees + taxes) / shares)) / (entry_price + (fees + taxes) / shares) * 100 AS pct,
             date_diff('day', execution_date, DATE '{TODAY}') AS days FROM lots JOIN px USING (ticker) WHERE rem > 0) GROUP BY 1""",
    "portfolio_health": _ALL + f"""SELECT portfolio_id, value_micros, open_trades, {r6('coalesce(best, 0)')} AS largest_winner, {r6('coalesce(worst, 0)')} AS largest_loser, {r6('hhi')} AS hhi, {r6('(1 - hhi) * 100')} AS diversification, largest_ticker, {r6('w * 100')} AS largest_pct, {r6('cp')} AS cash_pct,
  {r6('least(greatest((1 - hhi) * 100 * 0.6 + (CASE WHEN value_micros > 0 THEN greatest(0.0, 100 - 2 * abs(cp - 20)) ELSE 0.0 END) * 0.4, 0.0), 100.0)')} AS health
FROM (SELECT *, CASE WHEN value_micros + coalesce(cash, 0) > 0 THEN coalesce(cash, 0) / (value_micros + coalesce(cash, 0)) * 100 ELSE 0.0 END AS cp
  FROM (SELECT portfolio_id, CAST(sum(v) AS BIGINT) AS value_micros, CAST(sum(k) AS BIGINT) AS open_trades, CAST(sum(CAST(floor(w * w * 1e12 + 0.5) AS BIGINT)) AS BIGINT) / 1e12::DOUBLE AS hhi, arg_min(ticker, (-v, ticker)) AS largest_ticker, max(w) AS w
    FROM (SELECT portfolio_id, ticker, v, k, v / sum(v) OVER (PARTITION BY portfolio_id) AS w
      FROM (SELECT portfolio_id, ticker, count(*) AS k, CAST(sum(CAST(floor(coalesce(price, entry_price) * 1e6 * rem + 0.5) AS BIGINT)) AS BIGINT) AS v FROM lots LEFT JOIN px USING (ticker) WHERE rem > 0 GROUP BY 1, 2)) GROUP BY 1)
  LEFT JOIN cash USING (portfolio_id) LEFT JOIN (SELECT portfolio_id, max(pct) AS best, min(pct) AS worst FROM r GROUP BY 1) USING (portfolio_id))""",
    "sector_allocation": _OPEN + f"""SELECT portfolio_id, sector, value_micros, {r6('value_micros / sum(value_micros) OVER (PARTITION BY portfolio_id) * 100')} AS pct,
  CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY CASE WHEN sector = 'Unclassified' THEN 1 ELSE 0 END, value_micros DESC, sector) AS INTEGER) AS ord
FROM (SELECT portfolio_id, coalesce(sector, 'Unclassified') AS sector, CAST(sum(coalesce({_VALUE}, cost)) AS BIGINT) AS value_micros FROM lots LEFT JOIN px USING (ticker) WHERE rem > 0 AND coalesce({_VALUE}, cost) > 0 GROUP BY 1, 2)""",
    "strategy_attribution": _BASE.rstrip() + f""",
jr AS (SELECT p_partkey AS trade_id, [lower(p_type), string_split(p_name, ' ')[1]] AS more FROM part WHERE p_partkey % 3 = 0),
tg AS (SELECT portfolio_id, trade_id, unnest(list_distinct(list_concat(string_split(tags, ' '), coalesce(more, [])))) AS tag FROM v_trades LEFT JOIN jr USING (trade_id)),
g AS (SELECT tg.portfolio_id, tag, count(DISTINCT tg.trade_id) AS n_trades, count(r.trade_id) AS n_allocations, count(*) FILTER (pnl > 0) AS wins, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain, coalesce(sum(-pnl) FILTER (pnl < 0), 0) AS loss,
  coalesce(sum(pnl), 0) AS pnl, coalesce(sum(cost), 0) AS cost FROM tg LEFT JOIN r ON r.trade_id = tg.trade_id WHERE tag <> '' GROUP BY 1, 2)
SELECT portfolio_id, tag, CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY pnl DESC, tag) AS INTEGER) AS ord, n_trades, n_allocations, coalesce({r6('wins / n_allocations * 100')}, 0.0) AS win_rate,
  CASE WHEN loss > 0 THEN {r6('gain / loss')} WHEN gain > 0 THEN 'infinity'::DOUBLE ELSE 0.0 END AS profit_factor, CAST(pnl AS BIGINT) AS pnl_micros,
  CAST(CASE WHEN n_allocations > 0 THEN floor(pnl / n_allocations + 0.5) ELSE 0 END AS BIGINT) AS avg_pnl_micros, CASE WHEN cost > 0 THEN {r6('pnl / cost * 100')} ELSE 0.0 END AS return_pct FROM g""",
    "exposure_cash_ratio": _OPEN.rstrip() + ",\n" + _EXPOSURE + " SELECT * FROM e",
    "status_counts": _OPEN + "SELECT ticker, count(*) FILTER (rem >= shares) AS n_open, count(*) FILTER (rem > 0 AND rem < shares) AS n_partial, count(*) FILTER (rem <= 0) AS n_closed FROM lots GROUP BY 1",
    "portfolio_rollup": _ALL.rstrip() + f""",
ps AS (SELECT portfolio_id, ticker, CAST(sum(cost) AS BIGINT) AS cost, sum(rem) AS sh FROM lots WHERE rem > 0 GROUP BY 1, 2), pv AS (SELECT *, CAST(floor(price * 1e6 * sh + 0.5) AS BIGINT) AS v FROM ps LEFT JOIN px USING (ticker)),
dv AS (SELECT user_id % 8 AS portfolio_id, CAST(sum(CAST(floor(value * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS d FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT portfolio_id, coalesce(value_micros, 0) AS value_micros, coalesce(cost_micros, 0) AS cost_micros, coalesce(unrealized_micros, 0) AS unrealized_micros, coalesce(realized_micros, 0) AS realized_micros, coalesce(d, 0) AS dividend_micros
FROM (SELECT portfolio_id, CAST(sum(coalesce(v, cost)) AS BIGINT) AS value_micros, CAST(sum(cost) AS BIGINT) AS cost_micros, CAST(sum(coalesce(v - cost, 0)) AS BIGINT) AS unrealized_micros FROM pv GROUP BY 1)
FULL JOIN (SELECT portfolio_id, CAST(sum(pnl) AS BIGINT) AS realized_micros FROM r GROUP BY 1) USING (portfolio_id) FULL JOIN dv USING (portfolio_id)""",
}
