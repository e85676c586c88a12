"""Folds, cash, first-in first-out against brute force, kernels."""

import datetime as dt
import random

from tallyspark.operators import grouped as G
from tallyspark.operators import ledger as L
from tallyspark.operators import resolve as R

D = dt.date


def brute_fifo(rows):
    lots, matches = [], {}
    for i, (kind, shares) in enumerate(rows):
        if kind == "BuyExecution":
            lots.append([i, shares])
            continue
        for lot in lots:
            take = min(lot[1], shares)
            if take:
                lot[1] -= take
                shares -= take
                matches[lot[0], i] = take
    return {i: s for i, s in lots if s}, matches


def test_fifo_against_brute_force(spark):
    r = random.Random(4)
    rows, want_left, want_match = [], {}, {}
    for k in range(150):
        seq = [(r.choice(["BuyExecution", "BuyExecution", "SellExecution"]), r.randrange(1, 9)) for _ in range(r.randrange(1, 14))]
        left, got = brute_fifo(seq)
        want_left |= {(k, i): s for i, s in left.items()}
        want_match |= {(k, a, b): s for (a, b), s in got.items()}
        rows += [(k, i, kind, s, D(2026, 1, 1) + dt.timedelta(i)) for i, (kind, s) in enumerate(seq)]
    df = spark.createDataFrame(rows, "k long, i long, kind string, shares long, execution_date date")
    t = L.fifo_timeline(df, ["k"], ["i"])
    from pyspark.sql import functions as F

    assert {(x["k"], x["i"]): x["remaining"] for x in L.fifo_open_lots(t, ["k"], ["i"]).collect()} == want_left
    assert {(x["k"], x["lot_id"], x["sell_id"]): x["matched"] for x in L.fifo_matches(t, ["k"], F.col("i"), F.col("i")).collect()} == want_match


def test_cash_after_resets(spark):
    rows = [(1, "a", "Deposit", 5000.0), (2, "a", "CashReset", 777.0), (3, "a", "Deposit", 100.0), (1, "b", "CashReset", 900.0), (2, "b", "CashReset", 500.0), (1, "c", "Withdrawal", 5.0)]
    got = {r["portfolio_id"]: r["cash_micros"] / 1e6 for r in L.cash_projection(spark.createDataFrame(rows, "seq long, portfolio_id string, kind string, amount double")).collect()}
    assert got == {"a": 877.0, "b": 500.0, "c": -5.0}


def test_folds(spark):
    rows = [("f1", 1, "BuyExecution", "A", "p", None, None, None), ("f2", 2, "BuyExecution", "A", "p", None, None, None), ("c1", 3, "Correction", None, "p", "f1", "B", None), ("c2", 4, "Correction", None, "p", "f1", "C", None), ("r1", 5, "Retraction", None, "p", "f2", None, None), ("r2", 6, "Retraction", None, "p", "r1", None, None), ("m1", 7, "PortfolioAssignment", None, "p", "f1", None, "q")]
    df = spark.createDataFrame(rows, "id string, seq long, kind string, ticker string, portfolio_id string, target_id string, patch_ticker string, assigned_portfolio_id string")
    assert [(r["id"], r["current_ticker"], r["current_portfolio"]) for r in L.relevant_facts(df).collect()] == [("f1", "C", "q")]


def test_allocation_lines():
    assert G.replay_allocations([("a", 100.0)], [("s", 100.0, 40.0, 20.0, "a", 25.0), ("s", 100.0, 40.0, 20.0, "a", 75.0)]) == [("s", "a", 25.0, 10.0, 5.0), ("s", "a", 75.0, 30.0, 15.0)]
    assert G.replay_allocations([("a", 50.0)], [("s", 80.0, 0.0, 0.0, "a", 80.0)]) == []


def test_subsets():
    pool = [("o1", 5000.0, 8.0), ("o2", 3000.0, 8.0)]
    assert G.smallest_subset(pool, 8000.0) == [0, 1]
    assert G.smallest_subset(pool[1:], 8000.0) is None and G.smallest_subset(pool, 0.0) is None
    r = random.Random(2)
    for _ in range(200):
        p = [(str(i), float(r.randrange(1, 9)), 100.0) for i in range(r.randrange(1, 9))]
        total = float(r.randrange(1, 25))
        fits = [c for c in ([i for i in range(len(p)) if m >> i & 1] for m in range(1, 2 ** len(p))) if sum(p[i][1] for i in c) == total]
        got = G.smallest_subset(p, total)
        assert (got is None) == (not fits) and (got is None or (len(got) == min(map(len, fits)) and got in fits))
    assert len(G.smallest_subset([(str(i), 100.0, 1.0) for i in range(30)], 1500.0)) == 15  # one choice a sum, not all of them


def test_removals():
    assert G.removal_suggestion([("a", 30.0, 1.0, 2), ("b", 15.0, 1.0, 2), ("c", 8.0, 1.0, 0)], 45.0) == (["c"], 0, False)
    assert G.removal_suggestion([("dear", 10.0, 9.0, 1), ("cheap", 10.0, 1.0, 1), ("x", 5.0, 9.0, 1)], 15.0, 9.0) == (["cheap"], 1, True)
    assert G.removal_suggestion([("dear", 10.0, 9.0, 1), ("cheap", 10.0, 1.0, 1), ("s", -5.0, 9.0, 1)], 5.0, 9.0)[2] is False  # sales aren't ranked by cost
    assert G.removal_suggestion([("a", 1.0, 1.0, 0)], 5.0) is None and G.removal_suggestion([("a", 1.0, 1.0, 0)], 0.0) is None
    assert G.removal_suggestion([("a", 5.0, 1.0, 0), ("b", 3.0, 1.0, 0)], 15.0, None, 12.0) == (["a"], 0, False)  # with what is on the ledger
    r = random.Random(9)
    for _ in range(100):
        rows = [(str(i), float(r.choice([-2, -1, 1, 2, 3])), 1.0, r.randrange(3)) for i in range(r.randrange(1, 9))]
        units, n = float(r.randrange(-2, 6)), len(rows)
        ways = [m for m in range(1, 2**n - 1) if sum(rows[i][1] for i in range(n) if m >> i & 1) == sum(x[1] for x in rows) - units]
        got = G.removal_suggestion(rows, units)
        if sum(x[1] for x in rows) == units or not ways:
            assert got is None
        else:
            best = min(ways, key=lambda m: (sum(rows[i][3] for i in range(n) if m >> i & 1), bin(m).count("1"), m))
            assert got == ([rows[i][0] for i in range(n) if best >> i & 1], len(ways) - 1, False)


def test_greedy_evidence():
    c = [("c1", "B", 5.0, 10.0, None, "d1"), ("c2", "B", 5.0, 10.0, 60, "d1"), ("c3", "B", 7.0, 10.0, 0, "d2")]
    e = [("e1", "B", 5.0, 10.2, 60, None, 51.0), ("e2", "B", 9.0, None, None, "d1", 52.0), ("e3", "B", 7.0, None, None, None, 70.0), ("e4", "B", 1.0, 1.0, 5, "d2", 70.0), ("e5", "B", 1.0, 1.0, 0, "d2", 74.0)]
    # dated evidence goes by day and value, undated by shares and price; midnight is a time; a missing price fits nothing
    assert G.match_greedy(c, e) == {"c1": "e1", "c2": "e2"}
    assert G.match_greedy(c, [*e, ("e6", "B", None, None, 0, "d2", 72.0)])["c3"] == "e6"


def test_completeness_and_compare(spark):
    a = spark.createDataFrame([("k1", 1.0, 0), ("k2", 1.0, 0), ("k3", 1.0, 0)], "k string, shares double, cost_micros long")
    b = spark.createDataFrame([("k1", 1.0, 20_000), ("k2", 2.0, 0), ("k4", 1.0, 0)], "k string, shares double, cost_micros long")
    assert {r["k"]: r["result"] for r in R.compare_positions(a, b, ["k"]).collect()} == {"k1": "cost-differs", "k2": "shares-differ", "k3": "only-left", "k4": "only-right"}


def test_official_repair_and_diff_match():
    lots = [("a", 10.0, 1), ("b", 10.0, 3)]
    assert G.repair_official_sells(lots, [("a", 4.0)], [("s", 8.0, 5), ("t", 9.0, 5), ("u", 1.0, 2)]) == {"s": [("a", 6.0), ("b", 2.0)], "t": None, "u": None}
    got = G.match_consuming([("c1", None, 10.0), ("c2", "n", 99.0)], [("s1", "n", 10.0), ("s2", None, 10.05), ("s3", None, 10.0)])
    assert got == {"c2": "s1", "c1": "s3"}


def test_closure(spark):
    from tallyspark.operators.sweep import closure

    e = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(20, 21)], "a long, b long")
    assert sorted(r[0] for r in closure(e, spark.createDataFrame([(3,)], "node long")).collect()) == list(range(7))


def test_holdings_against_brute_force(spark):
    r = random.Random(8)
    lots, sells, alloc, want = [], [], [], {}
    for k in range(60):
        own = [(k, f"{k}l{i}", f"2026-01-{r.randrange(1, 9):02d}T{r.choice(['10:00AM', '9:00AM', '0000'])}", r.randrange(1, 9)) for i in range(r.randrange(0, 6))]
        out = [(k, f"{k}s{i}", f"2026-01-{r.randrange(1, 9):02d}T{r.choice(['10:00AM', '9:00AM', '0000'])}", r.randrange(1, 9)) for i in range(r.randrange(0, 5))]
        lines = [(f"{k:03d}-{i}", r.choice(out)[1], r.choice(own)[1], r.randrange(-1, 6)) for i in range(r.randrange(0, 4))] if own and out else []
        left, got = {x[1]: x[3] for x in own}, {}
        for _, s, l, n in sorted(lines):
            take = min(max(n, 0), left[l])
            left[l] -= take
            got[s] = got.get(s, 0) + take
        for _, s, at, n in sorted(out, key=lambda x: (x[2], x[1])):
            n = max(0, n - got.get(s, 0))
            for _, l, lot_at, _ in sorted(own, key=lambda x: (x[2], x[1])):
                if lot_at <= at:
                    take = min(n, left[l])
                    left[l] -= take
                    n -= take
        want |= {l: n for l, n in left.items() if n}
        lots += [(*x, 2.0, 1.0, None) for x in own]
        sells += out
        alloc += lines
    df = L.holdings(spark.createDataFrame(lots, "k int, id string, at string, shares long, price double, fees double, taxes double"), spark.createDataFrame(sells, "k int, id string, at string, shares long"), spark.createDataFrame(alloc, "ord string, sell_id string, lot_id string, shares long"), ["k"])
    got = df.collect()
    assert {r["id"]: r["remaining"] for r in got} == want
    shares = {x[1]: x[3] for x in lots}
    assert all(r["cost_micros"] == int((2.0 * shares[r["id"]] + 1) * 1e6 * r["remaining"] / shares[r["id"]] + 0.5) for r in got)
