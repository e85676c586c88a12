"""The calculators by name: each takes named tables and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import analytics as A
from ..operators import timeseries as T

Tables = dict[str, DataFrame]


def _r(t: Tables) -> DataFrame:
    return A.realized(t["allocations"], t["trades"])


def _lots(t: Tables) -> DataFrame:
    return A.open_lots(t["trades"], t["allocations"])


def _curve(t: Tables, today) -> DataFrame:
    return T.performance_curve(T.dated_deltas(_r(t), t["trades"], t.get("dividends")), today)


def _exposure(t: Tables) -> DataFrame:
    return A.exposure(_lots(t), t["prices"], t["cash"])


def _buckets(t: Tables, today, unit: str = "month") -> DataFrame:
    open_ = T.unrealized_by_period(t["trades"], t["allocations"], t["history"], today, unit) if "history" in t else None
    return T.period_performance(T.dated_deltas(_r(t), t["trades"], t.get("dividends")), today, unit, open_)


CALCULATORS: dict[str, Callable[..., DataFrame]] = {
    "realizedPnl": lambda t, today: A.realized_pnl_by_portfolio(_r(t)),
    "winRate": lambda t, today: A.win_rate_profit_factor(_r(t)).select("portfolio_id", "win_rate"),
    "profitFactor": lambda t, today: A.win_rate_profit_factor(_r(t)).select("portfolio_id", "profit_factor"),
    "avgWinner": lambda t, today: A.avg_winner_loser(_r(t)).select("portfolio_id", "avg_winner"),
    "avgLoser": lambda t, today: A.avg_winner_loser(_r(t)).select("portfolio_id", "avg_loser"),
    "holdingTime": lambda t, today: A.holding_time(_r(t)),
    "exposure": lambda t, today: _exposure(t).select("portfolio_id", "exposure"),
    "cashRatio": lambda t, today: _exposure(t).select("portfolio_id", "cash_ratio"),
    "capitalDeployment": lambda t, today: _exposure(t).select("portfolio_id", "deployment"),
    "openPositions": lambda t, today: A.positions(_lots(t), t["prices"]),
    "openPositionStats": lambda t, today: A.open_position_stats(_lots(t), t["prices"], today),
    "portfolioHealth": lambda t, today: A.portfolio_health(_lots(t), t["prices"], t["cash"], _r(t)),
    "sectorAllocation": lambda t, today: A.sector_allocation(_lots(t), t["prices"]),
    "strategyAttribution": lambda t, today: A.strategy_attribution(t["trades"], _r(t), t.get("journal")),
    "performanceCurve": _curve,
    "bucketPerformance": lambda t, today: _buckets(t, today),
    "maxDrawdown": lambda t, today: T.max_drawdown(_curve(t, today)),
}


def compute(name: str, tables: Tables, today) -> DataFrame:
    return CALCULATORS[name](tables, today)
