"""Sources, sinks, text and streams."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.functions import text as X
from tallyspark.sources import readers as D
from tallyspark.sources import sinks as K
from tallyspark.streaming import facts as W


def test_statements(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Ticker,Type,Quantity,Price\n2026-01-05,comi.ca,BUY,100,10.5\n05/02/2026,HRHO,Sell,20,7\nbad,row,BUY,x,1\n")
    (tmp_path / "b.csv").write_text("Date;Symbol;Side;Shares;Price\n2026-01-06;ABUK;S;5;1976.5\n")
    got = {(r["ticker"], r["side"], r["shares"], r["price"], r["day"]) for r in D.delimited_statement(spark, str(tmp_path)).collect()}
    assert got == {("COMI", "BUY", 100.0, 10.5, dt.date(2026, 1, 5)), ("HRHO", "SELL", 20.0, 7.0, dt.date(2026, 2, 5)), ("ABUK", "SELL", 5.0, 1976.5, dt.date(2026, 1, 6))}


def test_price_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"asOf": "2026-01-01", "prices": {"A": 1.5, "B": 2}, "quotes": {"A": {"price": 1.5, "quotedAt": "2026-01-01T10:00:00Z", "source": "x"}}}))
    (tmp_path / "h.json").write_text(json.dumps({"A": {"2026-01-01": 1.0, "2026-01-02": 2.0}}))
    snap = D.price_snapshot(spark, str(tmp_path / "s.json"))
    assert {(r["ticker"], r["price"], r["quoted_at"]) for r in snap.collect()} == {("A", 1.5, "2026-01-01T10:00:00Z"), ("B", 2.0, None)}
    assert D.snapshot_info(snap).first()["n"] == 2
    assert D.price_history(spark, str(tmp_path / "h.json")).count() == 2


def test_orders_sheet(spark):
    rows = [("f", 1, "Your Orders", "", "", "", "", ""), ("f", 2, "COMI", "", "", "", "", ""), ("f", 3, "2026-01-05 10:00", "Limit Buy", "Day", "80.5", "1,000/1,000", "Filled"), ("f", 4, "HRHO", "", "", "", "", ""), ("f", 5, "2026-01-06 10:00", "Market Sell", "Day", "7", "0/50", "Cancelled")]
    got = D.orders_sheet(spark.createDataFrame(rows, "file string, row int, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string")).orderBy("row").collect()
    assert [(r["ticker"], r["side"], r["executed"], r["ordered"], r["status"]) for r in got] == [("COMI", "BUY", 1000, 1000, "executed"), ("HRHO", "SELL", 0, 50, "cancelled")]


def test_files(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(b"plain")
    (tmp_path / "y.xlsx").write_bytes(b"PK\x03\x04rest")
    got = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in D.guarded_files(spark, str(tmp_path)).collect()}
    assert got == {"x.xlsx": "not-a-workbook", "y.xlsx": None}


def test_scalars(spark):
    df = spark.createDataFrame([("76,500", "1,976.500", "1O:57PM", "12:00AM")], "a string, b string, c string, d string")
    r = df.select(E.parse_price("a"), E.parse_price("b"), E.time_to_minutes(F.concat(E.repair_digits(F.substring("c", 1, 5)), F.substring("c", 6, 2))), E.time_to_minutes("d"), E.half_up(F.lit(-2.5))).first()
    assert tuple(r) == (76.5, 1976.5, 22 * 60 + 57, 0, -2)


def test_text(spark):
    df = spark.createDataFrame([(1, "note\nBUY 1,200 COMI @ 80.50 05/01/2026 1O:57 PM\nsell 5 ABUK @ 40 31/02/2026")], "doc_id long, text string")
    got = X.extract_orders(df).orderBy("pos").collect()
    assert [(r["side"], r["shares"], r["ticker"], r["price"], r["day"], r["minutes"]) for r in got] == [("BUY", 1200, "COMI", 80.5, dt.date(2026, 1, 5), 1377), ("SELL", 5, "ABUK", 40.0, None, None)]
    names = spark.createDataFrame([("COMMERCIAL INTEMATIONAL BANK",), ("OTHER",)], "name string")
    dim = spark.createDataFrame([(1, "Commercial International Bank", "COMI")], "ord int, company string, ticker string")
    assert [(r["name"], r["ticker"]) for r in X.fuzzy_lookup(names, dim).collect()] == [("COMMERCIAL INTEMATIONAL BANK", "COMI")]
    assert spark.createDataFrame([("ﬁve​",)], "t string").select(X.normalize(F.col("t"), True)).first()[0] == "five"


def test_sinks(spark, tmp_path):
    rows = spark.range(50).repartition(4).select(F.col("id").alias("v"))
    got = sorted((r["seq"], r["v"]) for r in K.numbered(rows, 10, ["v"]).collect())
    assert got == [(11 + i, i) for i in range(50)]
    K.export_ledger({"t": rows}, str(tmp_path / "b"))
    assert K.import_ledger(spark, str(tmp_path / "b"), {"t": "v long"})["t"].count() == 50
    spark.createDataFrame([(1, 9)], "v long, schemaVersion int").write.json(str(tmp_path / "n/t"))
    with pytest.raises(ValueError):
        K.import_ledger(spark, str(tmp_path / "n"), {"t": "v long"})


def test_purge(spark):
    rows = [("f1", "BuyExecution", "A", "p", None, 2.0, 5.0), ("c1", "Correction", None, "p", "f1", None, None), ("c2", "Retraction", None, "p", "c1", None, None), ("f2", "BuyExecution", "B", "p", None, 1.0, 1.0)]
    left, refund = K.purge_ticker(spark.createDataFrame(rows, "id string, kind string, ticker string, portfolio_id string, target_id string, shares double, price double"), "A")
    assert [r["id"] for r in left.collect()] == ["f2"] and refund.first()["refund_micros"] == 10_000_000


def test_facts_stream(spark, tmp_path):
    path, out = f"{tmp_path}/facts", f"{tmp_path}/cash"
    put = lambda rows: spark.createDataFrame(rows, W.FACT_SCHEMA).write.mode("append").parquet(path)
    fact = lambda i, seq, kind, p, amount: (i, seq, kind, p, None, None, None, amount, None, None, None)
    run = lambda: W.maintain(spark, path, out, f"{tmp_path}/ck", W.recompute_cash, ["portfolio_id"]).awaitTermination()
    put([fact("a", 1, "Deposit", 1, 5.0), fact("b", 2, "Deposit", 2, 7.0)])
    run()
    time.sleep(0.1)
    put([fact("c", 3, "CashReset", 2, 1.0)])
    run()
    assert {r["portfolio_id"]: r["cash_micros"] for r in spark.read.parquet(out).collect()} == {1: 5_000_000, 2: 1_000_000}


def test_exchange_workbook(spark):
    cols = "observation_id string, document_id string, transaction_type string, ticker string, trade_date string, trade_time string, quantity string, price string, gross_amount string, order_status string"
    rows = [("1", "d", "Buy", "comi.ca", "2026-01-05", "10:00AM", "100", "10", "1000", "Executed"), ("2", "d", "Buy", "COMI", "46027", None, "1", "2", "3", ""), ("3", "x", "Buy", "A", "2026-01-05", None, "1", "1", None, None), ("4", "d", "Sell", "A", "31/02/2026", None, "1", "1", None, None), ("5", "d", "Sell", "A", "46027", None, "1", "1", None, "Cancelled")]
    good, bad = D.exchange_workbook(spark.createDataFrame(rows, cols), spark.createDataFrame([("d", "Invoice")], "document_id string, document_type string"))
    assert {(r["observation_id"], r["ticker"], r["day"], r["minutes"], r["source"], r["status"]) for r in good.collect()} == {("1", "COMI", dt.date(2026, 1, 5), 600, "invoice", "executed"), ("5", "A", dt.date(2026, 1, 5), None, "invoice", "cancelled")}
    assert dict(bad.collect()) == {"2": "gross-mismatch", "3": "unknown-document", "4": "bad-date"}


def test_sql_functions_and_calculators(spark, sf):
    from tallyspark.functions.register import register
    from tallyspark.plans.calculators import CALCULATORS, compute
    from tallyspark.sources import adapters as S

    register(spark)
    assert tuple(spark.sql("SELECT half_up(-2.5D), to_micros(1.5D), normalize_ticker(' comi.ca '), ratio_pct(1, 0), within_share(100, 101, 0.01D)").first()) == (-2, 1_500_000, "COMI", 0.0, True)
    cash = spark.range(8).select(F.col("id").alias("portfolio_id"), F.lit(10**9).alias("cash_micros"))
    tables = {"trades": S.trades(spark, sf), "allocations": S.allocations(spark, sf), "prices": S.lot_prices(spark, sf), "cash": cash}
    for name in CALCULATORS:
        assert compute(name, tables, "2002-01-01").count() > 0


def test_guards_and_extensions(spark, tmp_path):
    from tallyspark.plans import extensions as E2

    cells = spark.createDataFrame([("a", f"s{i}", 1, 1, "h", "v") for i in range(33)] + [("b", "s", 1, 257, "constructor", "v"), ("c", "s", 100_001, 1, "h", "v"), ("d", "s", 1, 1, None, "v")], "file string, sheet string, row int, col int, header string, value string")
    kept, problems = D.guarded_sheets(cells)
    assert dict(problems.collect()) == {"a": "too-many-sheets", "b": "too-many-columns", "c": "too-many-rows", "d": None} and kept.filter("file = 'b'").count() == 0
    files = spark.createDataFrame([("p2", "x"), ("p1", "x")], "path string, digest string")
    assert [r["path"] for r in D.first_by_hash(files, "x").collect()] == ["p1"] and D.first_by_hash(files, "y").collect() == []
    c = E2.Catalog(spark).add("t", lambda s: s.range(3))
    c.views()
    assert spark.sql("SELECT count(*) FROM t").first()[0] == 3
    with pytest.raises(KeyError):
        c.load("u")
    with pytest.raises(ValueError):
        E2.add_parser("invoice", lambda d: d)
    df, seen = E2.recorded(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "run")
    df.collect()
    E2.append_record(spark, f"{tmp_path}/r", "run", seen, "2026-01-01")
    assert spark.read.parquet(f"{tmp_path}/r").first()["counts"] == {"rows": "2", "null_a": "0", "null_b": "1"}


def test_versions_and_patches(spark, tmp_path):
    K.commit_tables({"a": spark.range(2), "b": spark.range(3)}, f"{tmp_path}/v")
    time.sleep(0.01)
    K.commit_tables({"a": spark.range(5), "b": spark.range(6)}, f"{tmp_path}/v")
    assert (K.committed(spark, f"{tmp_path}/v", "a").count(), K.committed(spark, f"{tmp_path}/v", "b").count()) == (5, 6)
    spark.range(4).write.parquet(f"{tmp_path}/p")
    K.purge_all(spark, [f"{tmp_path}/p"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 0
