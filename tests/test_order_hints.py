"""Tickers that orders hint at, against a loop over all pairs."""

import datetime as dt
import random

from tallyspark.operators import resolve as R

ROW = "id string, portfolio_id long, ticker_id long, kind string, execution_date date, shares long, price double, minutes int, confidence string"
ORDER = "portfolio_id long, ticker_id long, kind string, shares long, price double, minutes int, day date, total double"
DAYS = [dt.date(2026, 1, 5), dt.date(2026, 1, 6)]


def within(a, b):
    return None not in (a, b) and abs(a - b) <= max(a, b) * 0.05


def frames(spark):
    rng = random.Random(11)
    pick, price, minutes = rng.choice, lambda: rng.choice((0.0, None, 10.0, 10.5, round(rng.uniform(1, 400), 1))), lambda: rng.choice((None, 0, 60))
    rows = [(f"{i:03d}", pick((1, 2)), pick((1, 2, 3)), pick(("BuyExecution", "SellExecution")), pick(DAYS), pick((10, 20)), price(), minutes(), pick(("low", "low", "high"))) for i in range(150)]
    orders = [(pick((1, 2)), pick((1, 2, 3, 4)), pick(("BuyExecution", "SellExecution")), s, p, minutes(), pick((None, *DAYS)), None if p is None else s * p) for s, p in ((pick((10, 20)), price()) for _ in range(90))]
    return rows, orders, R.order_ticker_hints(spark.createDataFrame(rows, ROW), spark.createDataFrame(orders, ORDER))


def test_against_pairs(spark):
    rows, orders, hints = frames(spark)
    want = {}
    for id_, p, t, kind, day, shares, price, minutes, confidence in rows:
        fits = set()
        for op, ot, okind, oshares, oprice, ominutes, oday, total in orders:
            near = within(total, None if price is None else shares * price) and oday == day if oday else oshares == shares and within(oprice, price)
            if near and (op, okind) == (p, kind) and (minutes is None or ominutes is None or minutes == ominutes):
                fits.add(ot)
        if confidence != "high" and len(fits) == 1 and t not in fits:
            want[id_] = fits.pop()
    assert len(want) > 5 and {r["id"]: r["suggested_ticker"] for r in hints.collect()} == want


def test_rows_and_orders_are_not_paired(spark):
    """Rows join on their own value and time, never on day or shares alone."""
    joins = [line for line in frames(spark)[2]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and ("day" in line or "shares" in line)]
    assert joins and all("look" in line or "bin" in line for line in joins)
