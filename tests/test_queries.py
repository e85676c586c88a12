"""Every query against its SQL in a second engine, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyspark.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    if name not in registry.ORACLES:
        assert df.columns
        return
    cur = duck.execute(registry.ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitions_change_nothing(spark, sf):
    got = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, registry.QUERIES["snapshot_hash"](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]
