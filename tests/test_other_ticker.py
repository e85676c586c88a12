"""The first other ticker of a row, against a loop over all pairs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyspark.operators import resolve as R

ROW = "id string, portfolio_id long, ticker_id long, kind string, execution_date date, shares long, price double, confidence string"


def within(a, b):
    return abs(a - b) <= max(a, b) * 0.1


def test_against_pairs(spark):
    rng = random.Random(3)
    prices = [0.0, 9.0, 10.0, 0.9, 1.0, *(round(rng.uniform(1, 60), 2) for _ in range(60))]
    rows = [(f"{i:04d}", rng.randrange(2), rng.randrange(4), "BuyExecution", dt.date(2026, 1, rng.choice((5, 6))), 10, rng.choice(prices), rng.choice(("low", "high"))) for i in range(400)]
    rows += [("x", 1, None, "BuyExecution", dt.date(2026, 1, 5), 10, 9.0, "low"), ("y", 1, 1, "BuyExecution", dt.date(2026, 1, 5), 10, None, "low")]
    got = {r["id"]: r["other"] for r in R.with_first_other_ticker(spark.createDataFrame(rows, ROW), "id", "other", 0.1).collect()}
    for r in rows:
        near = [o for o in rows if r[7] != "high" and None not in (r[2], o[2], r[6], o[6]) and (r[1], r[4]) == (o[1], o[4]) and r[2] != o[2] and within(r[6], o[6])]
        assert got[r[0]] == (min(near)[2] if near else None)


def test_rows_of_a_price_are_never_paired(spark):
    """20,000 tickers of one price: pairs of rows would be 4e8."""
    rows = spark.range(20000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("portfolio_id"), F.col("id").alias("ticker_id"), F.lit("BuyExecution").alias("kind"), F.lit(dt.date(2026, 1, 5)).alias("execution_date"), F.lit(10).alias("shares"), F.lit(7.5).alias("price"), F.lit("low").alias("confidence"))
    df = R.with_first_other_ticker(rows, "id", "other", 0.1)
    assert df.groupBy("other").count().orderBy("other").collect() == [(0, 19999), (1, 1)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the rows meet one row a price, and nothing else


def test_only_prices_near_another_ticker_are_looked_at(spark):
    """Of a key's prices those count that have two tickers within reach; rows of the others meet nothing."""
    rng, keys = random.Random(4), ["portfolio_id", "kind", "execution_date", "shares"]
    prices = [0.0, -1.0, 9.0, 10.0, 0.9, 1.0, *(round(rng.uniform(1, 500), 2) for _ in range(40))]
    rows = [(f"{i:04d}", rng.randrange(3), rng.randrange(3), "BuyExecution", dt.date(2026, 1, 5), rng.choice((10, 20)), rng.choice(prices), rng.choice(("low", "high"))) for i in range(150)]
    rows += [("x", 1, None, "BuyExecution", dt.date(2026, 1, 5), 10, 9.0, "low"), ("y", 1, 1, "BuyExecution", dt.date(2026, 1, 5), 10, None, "low")]
    facts = spark.createDataFrame(rows, ROW)
    full = [r for r in rows if None not in (r[2], r[6])]
    near = lambda r: [o for o in full if (r[1], r[5]) == (o[1], o[5]) and r[2] != o[2] and within(r[6], o[6])]
    got = {(x.portfolio_id, x.shares, x.price) for x in R._mixed_prices(facts, keys, 0.1).collect()}
    want = {(r[1], r[5], r[6]) for r in full if near(r)}
    assert want <= got and all(p <= 0 for _, _, p in got - want) and len(got) < len({(r[1], r[5], r[6]) for r in full})
    found = {x.id: x.suggested_ticker for x in R.wrong_tickers(facts, F.col("id")).collect()}
    assert found == {r[0]: min(near(r))[2] for r in full if r[7] != "high" and near(r)}
