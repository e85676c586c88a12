"""Keyed state against the batch projection, out of order and over restarts."""

import random

import pytest

from tallyspark.operators import ledger as L
from tallyspark.streaming import keyed as K


@pytest.fixture
def rocks(spark):
    old = {c: spark.conf.get(c, None) for c in K.STORE}
    for c, v in {**K.STORE, "spark.sql.shuffle.partitions": "2"}.items():
        spark.conf.set(c, v)
    yield spark
    for c, v in old.items():
        spark.conf.set(c, v) if v else spark.conf.unset(c)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def make(n, seed):
    r = random.Random(seed)
    rows = []
    for p in (1, 2, 3):
        for i in range(1, n + 1):
            kind = r.choice(["BuyExecution", "SellExecution", "Deposit", "Withdrawal", "DividendPayment", "CashReset", "Correction"])
            trade = kind.endswith("Execution")
            rows.append((p, i, 1000 * p + i, kind, None if kind == "Correction" else r.randrange(1, 900) / 8, r.choice("AB") if trade else None, r.randrange(1, 40) / 4 if trade else None))
    return rows


def test_running_state_equals_the_batch_projection(rocks, tmp_path):
    spark, rows = rocks, make(25, 3)
    r = random.Random(4)
    mixed = r.sample(rows, len(rows))
    path, last = str(tmp_path / "facts"), {}

    def keep(df, _):
        for x in df.collect():
            last[x.portfolio_id, x.ticker] = x

    cuts = [0, 20, 45, len(mixed)]
    for a, z in zip(cuts, cuts[1:]):  # each time a new query from the checkpoint; a part of each file came before
        spark.createDataFrame(mixed[max(0, a - 5) : z], K.FACTS).coalesce(1).write.mode("append").parquet(path)
        K.running(spark.readStream.schema(K.FACTS).parquet(path)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        for p in (1, 2, 3):
            here = {x[1] for x in mixed[:z] if x[0] == p}
            due = next(i for i in range(1, 99) if i not in here) - 1
            assert (last[p, None].applied, last[p, None].held) == (due, len([i for i in here if i > due]))
            done = [x for x in rows if x[0] == p and x[1] <= due]
            if done:
                want = L.cash_projection(spark.createDataFrame(done, K.FACTS).filter("kind <> 'Correction'")).collect()
                assert last[p, None].cash_micros == (want[0].cash_micros if want else 0)
            for t in "AB":
                net = sum((1 if x[3] == "BuyExecution" else -1) * x[6] for x in done if x[5] == t)
                assert ((p, t) in last and last[p, t].net_micro_shares == round(net * 1e6)) or net == 0
    assert all(last[p, None].held == 0 and last[p, None].applied == 25 for p in (1, 2, 3))
