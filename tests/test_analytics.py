"""Golden cases on tiny tables."""

import datetime as dt

import pytest

from tallyspark.operators import analytics as A
from tallyspark.operators import timeseries as T

D = dt.date
TRADE = "trade_id string, portfolio_id string, ticker string, sector string, shares double, entry_price double, fees double, taxes double, execution_date date, strategy_tags_raw string"
ALLOC = "sell_group_id string, line_no int, trade_id string, portfolio_id string, shares_closed double, exit_price double, fees double, taxes double, execution_date date"


def trades(spark, *rows):
    full = [(r[0], "p1", r[1], r[5] if len(r) > 5 else None, r[2], r[3], 0.0, 0.0, r[4], "") for r in rows]
    return spark.createDataFrame(full, TRADE)


def allocs(spark, *rows):
    return spark.createDataFrame([("s", 1, r[0], "p1", r[1], r[2], 0.0, 0.0, r[3]) for r in rows], ALLOC)


def curve(spark, t, a, today):
    r = A.realized(a, t)
    return [(x["day"], x["realized_pct"]) for x in T.performance_curve(T.dated_deltas(r, t), today).orderBy("day").collect()]


def test_curve(spark):
    t = trades(spark, ("t", "X", 100.0, 10.0, D(2026, 1, 1)))
    a = allocs(spark, ("t", 10.0, 15.0, D(2026, 2, 1)))
    assert curve(spark, t, a, "2026-02-01") == [(D(2026, 1, 1), 0.0), (D(2026, 2, 1), 5.0)]


def test_recycled_capital_counts_once(spark):
    t = trades(spark, ("a", "X", 100.0, 10.0, D(2026, 1, 1)), ("b", "X", 100.0, 10.0, D(2026, 2, 1)))
    a = allocs(spark, ("a", 100.0, 10.5, D(2026, 2, 1)), ("b", 100.0, 10.5, D(2026, 3, 1)))
    assert curve(spark, t, a, "2026-03-01")[-1] == (D(2026, 3, 1), 10.0)


def test_no_rows(spark):
    t, a = spark.createDataFrame([], TRADE), spark.createDataFrame([], ALLOC)
    assert curve(spark, t, a, "2026-03-01") == []


def test_drawdown(spark):
    c = spark.createDataFrame([("p", D(2026, 1, i + 1), v, 0.0) for i, v in enumerate([0.0, 20.0, 5.0, 12.0])], "portfolio_id string, day date, realized_pct double, dividend_pct double")
    assert T.max_drawdown(c).first()["max_drawdown"] == 15.0


def test_open_position_stats(spark):
    t = trades(spark, ("a", "W", 100.0, 10.0, D(2026, 1, 1)), ("b", "L", 100.0, 10.0, D(2026, 1, 1)))
    lots = A.open_lots(t, spark.createDataFrame([], ALLOC))
    px = spark.createDataFrame([("W", 15.0), ("L", 8.0)], "ticker string, price double")
    r = A.open_position_stats(lots, px, "2026-01-11").first()
    assert (r["win_rate"], r["profit_factor"], r["avg_winner"], r["avg_loser"], r["holding_days"]) == (50.0, 2.5, 50.0, -20.0, 10.0)
    one = A.open_position_stats(lots.filter("ticker = 'W'"), px, "2026-01-11").first()
    assert one["profit_factor"] == float("inf")


def test_health_of_two_equal_tickers(spark):
    t = trades(spark, ("a", "A", 100.0, 10.0, D(2026, 1, 1)), ("b", "B", 100.0, 10.0, D(2026, 1, 1)))
    r = A.portfolio_health(A.open_lots(t, spark.createDataFrame([], ALLOC)), spark.createDataFrame([], "ticker string, price double"), spark.createDataFrame([], "portfolio_id string, cash_micros long"), A.realized(spark.createDataFrame([], ALLOC), t)).first()
    assert (r["hhi"], r["largest_pct"], r["largest_ticker"], r["open_trades"], r["largest_winner"]) == (0.5, 50.0, "A", 2, 0.0)


def test_allocation_without_trade_fails(spark):
    t, a = trades(spark, ("t", "X", 1.0, 1.0, D(2026, 1, 1))), allocs(spark, ("gone", 1.0, 1.0, D(2026, 1, 2)))
    with pytest.raises(Exception, match="allocation without its trade"):
        A.realized(a, t).collect()
    assert A.realized(a, t, strict=False).collect() == []


def test_cost_of_a_part_sold(spark):
    t = spark.createDataFrame([("t", "p1", "X", None, 100.0, 40.0, 10.0, 5.0, D(2026, 1, 1), "")], TRADE)
    lots = A.open_lots(t, allocs(spark, ("t", 25.0, 50.0, D(2026, 2, 1))))
    assert lots.first()["cost_micros"] == 3_011_250_000


def test_price_as_of_never_looks_ahead(spark):
    px = spark.createDataFrame([("X", D(2026, 1, 5), 1.0), ("X", D(2026, 1, 9), 2.0)], "k string, price_date date, close double")
    q = spark.createDataFrame([("X", D(2026, 1, d)) for d in (4, 5, 8, 9, 30)], "k string, day date")
    assert [r["close"] for r in T.price_as_of(q, px, "k").orderBy("day").collect()] == [None, 1.0, 1.0, 2.0, 2.0]


def test_quotes_closes_and_estimates(spark):
    q = spark.createDataFrame([("A", 1, 10.0, "2026-01-01"), ("A", 2, 11.0, "2026-02-09"), ("B", 1, 5.0, "2025-01-01"), ("B", 2, 6.0, None), ("C", 1, 1.0, "2025-01-01"), ("C", 2, 2.0, "2025-03-01")], "ticker string, provider_rank int, price double, quoted_at string")
    assert {r["ticker"]: r["price"] for r in T.choose_quote(q, "2026-02-10").collect()} == {"A": 11.0, "B": 6.0, "C": 2.0}
    e = spark.createDataFrame([("A", [0, 86400, 172800], [1.0, None, 3.0])], "ticker string, timestamps array<long>, closes array<double>")
    assert [(str(r["day"]), r["close"]) for r in T.epoch_closes(e).orderBy("day").collect()] == [("1970-01-01", 1.0), ("1970-01-03", 3.0)]
    a = spark.createDataFrame([("A", 7, 110.0, 10.0)], "ticker string, days_ago int, price double, pct double")
    r = T.anchor_estimates(a, "2026-01-08").first()
    assert (str(r["day"]), r["estimate"]) == ("2026-01-01", 100.0)


def test_periods_carry_prices_of_empty_months(spark):
    t = trades(spark, ("t", "X", 100.0, 10.0, D(2026, 1, 5)))
    a = allocs(spark, ("t", 50.0, 12.0, D(2026, 3, 2)))
    got = T.period_performance(T.dated_deltas(A.realized(a, t), t), "2026-04-15").orderBy("period").collect()
    assert [(r["period"], r["realized_pct"]) for r in got] == [("2026-01-01", 0.0), ("2026-02-01", 0.0), ("2026-03-01", 10.0), ("2026-04-01", 0.0)]


def test_open_results_by_period(spark):
    t = trades(spark, ("t", "X", 100.0, 10.0, D(2026, 1, 5)), ("u", "Y", 10.0, 1.0, D(2026, 1, 5)))
    a = allocs(spark, ("t", 50.0, 12.0, D(2026, 3, 2)))
    px = spark.createDataFrame([("X", D(2026, 1, 20), 11.0), ("X", D(2026, 2, 28), 9.0), ("X", D(2026, 4, 16), 99.0)], "ticker string, price_date date, close double")
    open_ = T.unrealized_by_period(t, a, px, "2026-04-15")
    got = {str(r["period"]): r["unrealized_micros"] / 1e6 for r in open_.collect()}
    assert got == {"2026-01-01": 100.0, "2026-02-01": -100.0, "2026-03-01": -50.0, "2026-04-01": -50.0}  # Y has no close; the last close is of tomorrow
    p = T.period_performance(T.dated_deltas(A.realized(a, t), t), "2026-04-15", "month", open_).orderBy("period").collect()
    assert [r["unrealized_pct"] for r in p] == [round(x / 1010 * 100, 6) for x in (100.0, -200.0, 50.0, 0.0)]


def test_last_journal_entry_has_the_tags(spark):
    t = trades(spark, ("t", "X", 100.0, 10.0, D(2026, 1, 5)), ("u", "X", 100.0, 10.0, D(2026, 1, 5))).withColumn("tags", A.F.array(A.F.lit("swing")))
    a = allocs(spark, ("t", 50.0, 12.0, D(2026, 3, 2)))
    j = spark.createDataFrame([("t", 1, ["early"]), ("t", 2, ["late", "swing"])], "trade_id string, ord int, tags array<string>")
    got = {r["tag"]: (r["n_trades"], r["n_allocations"], r["ord"]) for r in A.strategy_attribution(t, A.realized(a, t), j).collect()}
    assert got == {"swing": (2, 1, 2), "late": (1, 1, 1)}


def test_totals_beyond_64_bits_are_whole(spark):
    """Each portfolio's value fits a 64-bit integer, and their sum doesn't; smaller sums stay 64-bit integers."""
    rollup = lambda v: spark.createDataFrame([(i, v + i, v, 7, -3, 1) for i in range(3)], "portfolio_id long, value_micros long, cost_micros long, unrealized_micros long, realized_micros long, dividend_micros long")
    cash = spark.createDataFrame([(0, 5), (1, 6)], "portfolio_id long, cash_micros long")
    returns = spark.createDataFrame([(0, 10.0, 50.0), (1, 20.0, 60.0), (2, 30.0, 70.0)], "portfolio_id long, total_pct double, deployment double")
    big, small = 8 * 10**18, 10**15
    for v, kind in ((big, "decimal"), (small, "long")):
        t = A.dashboard_totals(rollup(v), cash, returns)
        assert {t.schema[c].dataType.typeName() for c in ("cash_micros", "value_micros", "cost_micros", "realized_micros")} == {kind}
        x = t.collect()[0]
        assert (int(x.value_micros), int(x.cost_micros), int(x.cash_micros), int(x.realized_micros)) == (3 * v + 3, 3 * v, 11, -9)
        assert (x.weighted_return, x.mean_deployment, x.best, x.worst) == (20.0, 60.0, 2, 0)
