"""The lot manager's tables read lines that were made once, not what allocates."""

from tallyspark.operators import review as V


def test_lines_are_made_once(spark, tmp_path):
    side = "key string, id string, on string, minutes int, shares double, price double, fees double, taxes double"
    lots = spark.createDataFrame([("k", "b1", "2026-01-01", None, 5.0, 2.0, None, None)], side)
    sells = spark.createDataFrame([("k", "s1", "2026-01-02", None, 3.0, 3.0, None, None), ("k", "s2", "2026-01-03", None, 9.0, 3.0, None, None)], side)
    path = str(tmp_path / "allocated")
    spark.createDataFrame([("s1", "b1", 2.0, "1"), ("s1", "b1", 1.0, "2")], "sell_id string, lot_id string, shares double, ord string").write.parquet(path)
    tables = V.lot_manager(lots, sells, spark.read.parquet(path))
    assert not [name for name, df in tables.items() if any(path in f for f in df.inputFiles())]
    assert sorted((r.id, r.code) for r in tables["issues"].collect()) == [("s1", "duplicate-allocation"), ("s2", "missing-allocation")]
    assert [tuple(r) for r in tables["positions"].collect()] == [("k", 5.0, 2.0, 3.0, 9.0)]
