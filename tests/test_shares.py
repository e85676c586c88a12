"""Shares that aren't whole, and the rules for duplicates, dividends and the commit gate."""

import datetime as dt
import random
from fractions import Fraction

from pyspark.sql import functions as F

from tallyspark.operators import ledger as L
from tallyspark.operators import resolve as R
from tallyspark.operators import verification as V

D = dt.date
FACT = "k long, i long, kind string, shares double, execution_date date"
ENTRY = "id string, portfolio_id long, ticker_id long, kind string, execution_date date, shares long, price double, minutes int, number string, source string, confidence string"


def plain_fifo(rows):
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


def test_fractions_first_in_first_out_against_a_plain_loop(spark):
    r = random.Random(21)
    rows, want_left, want_match = [], {}, {}
    for k in range(120):
        seq = [(r.choice(["BuyExecution", "BuyExecution", "SellExecution"]), Fraction(r.randrange(1, 4000), r.choice([4, 8, 1000]))) for _ in range(r.randrange(1, 14))]
        left, got = plain_fifo(seq)
        want_left |= {(k, i): round(float(s), 6) for i, s in left.items()}
        want_match |= {(k, a, b): round(float(s), 6) for (a, b), s in got.items()}
        rows += [(k, i, kind, float(s), D(2026, 1, 1) + dt.timedelta(i)) for i, (kind, s) in enumerate(seq)]
    t = L.fifo_timeline(spark.createDataFrame(rows, FACT), ["k"], ["i"])
    assert {(x["k"], x["i"]): x["remaining"] for x in L.fifo_open_lots(t, ["k"], ["i"]).collect()} == want_left
    assert {(x["k"], x["lot_id"], x["sell_id"]): x["matched"] for x in L.fifo_matches(t, ["k"], F.col("i"), F.col("i")).collect()} == want_match


def test_probes_of_halves_and_tenths(spark):
    day = [D(2026, 1, i) for i in range(1, 6)]
    t = L.fifo_timeline(spark.createDataFrame([(1, 1, "BuyExecution", 1.5, day[0]), (1, 2, "SellExecution", 1.0, day[1]), (2, 1, "BuyExecution", 0.75, day[0])], FACT), ["k"], ["i"])
    assert sorted(x["remaining"] for x in L.fifo_open_lots(t, ["k"], ["i"]).collect()) == [0.5, 0.75]
    facts = [(1, 1, "BuyExecution", 0.1, day[0]), (1, 2, "BuyExecution", 0.2, day[1]), (1, 3, "SellExecution", 0.3, day[2]), (1, 4, "BuyExecution", 5.0, day[3])]
    assert L.last_balanced_date(spark.createDataFrame(facts, FACT), ["k"]).collect()[0]["balanced_on"] == day[2]


def test_fractional_holdings_and_proposals(spark):
    lots = spark.createDataFrame([(1, "a", "2026-01-01", 0.75, 4.0, None, None), (1, "b", "2026-01-02", 2.5, 8.0, 1.0, None)], "k int, id string, at string, shares double, price double, fees double, taxes double")
    sells = spark.createDataFrame([(1, "s", "2026-01-03", 1.25)], "k int, id string, at string, shares double")
    lines = spark.createDataFrame([("1", "s", "b", 0.25)], "ord string, sell_id string, lot_id string, shares double")
    got = {r["id"]: (r["remaining"], r["cost_micros"]) for r in L.holdings(lots, sells, lines, ["k"]).collect()}
    assert got == {"b": (2.0, 16_800_000)}
    have = spark.createDataFrame([(1, D(2026, 1, 1), 0.75), (1, D(2026, 1, 2), 2.5)], "k int, execution_date date, remaining double")
    need = spark.createDataFrame([(1, 1.5, D(2026, 1, 3))], "k int, need double, sell_date date")
    assert sorted(r["take"] for r in L.propose_fifo(have, need, ["k"], []).collect()) == [0.75, 0.75]


def entry(i, source, price=10.0, minutes=None, number=None, shares=10):
    return (i, 1, 1, "BuyExecution", D(2026, 1, 5), shares, price, minutes, number, source, "high")


def test_duplicates_fall_within_two_percent_and_never_with_another_number(spark):
    rows = [entry("a", "invoice", 100.0, number="7"), entry("b", "statement", 98.5), entry("c", "csv", 100.0, number="8"), entry("d", "csv", 97.0), entry("e", "csv", 50.0, number="7")]
    got = {r["id"]: r["duplicate"] for r in V.with_duplicates(spark.createDataFrame(rows, ENTRY), ["id"]).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False, "e": True}


def test_two_sources_within_two_percent_verify_each_other(spark):
    rows = [entry("a", "statement", 100.0), entry("b", "csv", 98.5), entry("c", "orders-screen", 90.0)]
    got = {r["id"]: r["cross_verified"] for r in V.with_corroboration(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == {"a": True, "b": True, "c": False}


def test_dividends_of_two_companies_are_two(spark):
    ts = dt.datetime(2026, 1, 5, 9)
    rows = [(1, 1, ts, 5.0), (2, 2, ts, 5.0), (3, 1, ts + dt.timedelta(hours=3), 5.0), (4, 1, ts, 5.01)]
    got = R.duplicate_dividends(spark.createDataFrame(rows, "seq long, ticker_id long, ts timestamp, amount double")).collect()
    assert [(r["seq"], r["first_seq"]) for r in got] == [(3, 1)]


def test_gate_needs_executions_and_no_open_verdict(spark):
    rows = [(1, 1, "BuyExecution", "Verified"), (1, 1, "SellExecution", "Rejected"), (1, 2, "BuyExecution", "Verified"), (1, 2, "BuyExecution", "Needs Review"), (1, 3, "DividendPayment", "Verified"), (1, 5, "BuyExecution", None)]
    asked = spark.createDataFrame([(1, t) for t in (1, 2, 3, 4, 5, 5)], "portfolio_id long, ticker_id long")
    got = V.commit_gate(asked, spark.createDataFrame(rows, "portfolio_id long, ticker_id long, kind string, verdict string")).collect()
    assert sorted((r["ticker_id"], r["commit"]) for r in got) == [(1, True), (2, False), (3, False), (4, False), (5, False)]
