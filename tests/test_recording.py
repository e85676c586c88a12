"""Recording against brute force and literal cases."""

import random

from tallyspark.operators import recording as R


def brute_groups(trades, sales):
    parent = {t: t for t in trades}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sales:
        for b in sales:
            if a[1] == b[1] and trades[a[0]] == trades[b[0]]:
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    return {t: find(t) for t in trades}


def test_groups_against_brute_force(spark):
    r = random.Random(5)
    trades = {i: r.randrange(2) for i in range(40)}
    sales = [(r.randrange(40), r.randrange(25)) for _ in range(45)]
    t = spark.createDataFrame(list(trades.items()), "trade_id long, portfolio_id long")
    a = spark.createDataFrame(sales, "trade_id long, sell_group_id long")
    assert dict(R.trade_groups(t, a).collect()) == brute_groups(trades, sales)


def test_moves_take_the_group_along(spark):
    t = spark.createDataFrame([(1, 0, 10.0, 2.0, 1.0, 0.0), (2, 0, 5.0, 2.0, 0.0, 0.0), (3, 0, 5.0, 2.0, 0.0, 0.0)], "trade_id long, portfolio_id long, shares double, entry_price double, fees double, taxes double")
    a = spark.createDataFrame([(1, 7, 4.0, 3.0, 0.5, 0.5), (2, 7, 5.0, 3.0, 0.0, 0.0)], "trade_id long, sell_group_id long, shares_closed double, exit_price double, fees double, taxes double")
    moved, cash = R.moves(t, a, spark.createDataFrame([(2, 9)], "trade_id long, target long"))
    assert sorted(map(tuple, moved.collect())) == [(1, 0, 9), (2, 0, 9)]
    assert {r["portfolio_id"]: r["cash_micros"] / 1e6 for r in cash.collect()} == {0: 31.0 - 26.0, 9: -5.0}
    assert R.moves(t, a, spark.createDataFrame([(2, 0)], "trade_id long, target long"))[0].collect() == []
