"""Lot and sale statuses, closing lists and evidence case by case."""

import datetime as dt

from tallyspark.operators import review as V
from tallyspark.operators import verification as W

D = dt.date
ROW = "key string, id string, on date, minutes int, shares double, price double, fees double, taxes double"


def test_statuses_of_fractions_with_their_lines_and_issues(spark):
    lots = spark.createDataFrame([("k", "a", D(2026, 1, 1), 60, 0.3, 10.0, None, None), ("k", "b", D(2026, 1, 9), None, 2.0, 4.0, 1.0, None), ("k", "c", D(2026, 1, 2), None, 1.0, 4.0, None, 0.5)], ROW)
    sells = spark.createDataFrame([("k", "s", D(2026, 1, 3), None, 0.5, 12.0, None, None), ("k", "t", D(2026, 1, 4), None, 1.0, 12.0, None, None), ("j", "u", D(2026, 1, 4), None, 1.0, 12.0, None, None)], ROW)
    lines = spark.createDataFrame([("s", "a", 0.1, 1), ("s", "a", 0.2, 2), ("s", "b", 2.5, 3), ("gone", "c", 0.25, 4)], "sell_id string, lot_id string, shares double, ord int")
    t = V.lot_manager(lots, sells, lines)
    got = {r["id"]: (r["status"], r["remaining"], [(x["id"], x["shares"]) for x in r["closed_by"]], r["cost_micros"]) for r in t["lots"].collect()}
    assert got == {"a": ("closed", 0.0, [("s", 0.1), ("s", 0.2)], 3_000_000), "b": ("closed", -0.5, [("s", 2.5)], 9_000_000), "c": ("partial", 0.75, [("gone", 0.25)], 4_500_000)}
    assert {r["id"]: (r["status"], r["remaining"]) for r in t["sells"].collect()} == {"s": ("completed", -2.3), "t": ("pending", 1.0), "u": ("pending", 1.0)}
    assert sorted((r["code"], r["id"], r["lot_id"]) for r in t["issues"].collect() if r["id"]) == [("chronological-violation", "s", "b"), ("duplicate-allocation", "s", "a"), ("missing-allocation", "t", None), ("missing-allocation", "u", None), ("over-allocation", "s", None)]
    assert [(r["code"], r["lot_id"]) for r in t["issues"].collect() if not r["id"]] == [("negative-remaining", "b")]
    assert [(r["id"], r["net"], r["n_lines"]) for r in t["timeline"].filter("key = 'k'").orderBy("on").collect()] == [("a", 0.3, 2), ("c", 1.3, 1), ("s", 0.8, 3), ("t", -0.2, 0), ("b", 1.8, 1)]
    assert {r["key"]: (r["bought"], r["allocated"]) for r in t["positions"].collect()} == {"k": (3.3, 2.8), "j": (0.0, 0.0)}
    assert all(df.count() == 0 for df in V.lot_manager(lots.limit(0), sells.limit(0), lines.limit(0)).values())


def test_evidence_in_its_order(spark):
    rows = [
        ("a", "csv", True, False, True, True, True, "matched", None, "o", "invoice"), ("b", "csv", True, True, False, False, False, "mismatch", 7, None, None),
        ("c", "backfill", False, False, False, False, True, "matched", None, None, None), ("d", None, False, False, False, False, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, source string, duplicate boolean, cross_verified boolean, aggregated boolean, ordered boolean, matched boolean, reason string, other_ticker long, other_id string, other_source string")
    got = {r["id"]: [(e["type"], e["other"]) for e in r["evidence"]] for r in W.with_evidence(df).collect()}
    assert got == {
        "a": [("matched-ledger", None), ("matched-invoice", "o"), ("matched-statement-aggregate", None), ("matched-order", None), ("matched-position", "matched")],
        "b": [("contradicted-position-mismatch", "mismatch"), ("contradicted-wrong-ticker", "7")], "c": [("matched-backfill", None)], "d": [],
    }
