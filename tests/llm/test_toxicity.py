import zlib

import numpy as np

from tallyspark.llm import toxicity as T


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in T.op9_toxicity(spark, d).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    out = [(rows[i]["predicted"], y) for i, y in truth.items() if rows[i]["held_out"]]
    hit = np.mean([p for p, y in out if y])
    wrong = np.mean([p for p, y in out if not y])
    print("held-out: caught", hit, "false alarms", wrong, "of", len(out))
    assert hit > 0.8 and wrong < 0.02  # some labelled documents of this table hold no toxic word


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["you utter numpty", "a fine day", "z" * 500_000, "", None, "numpty numpty"] * 30)] + [(None, "numpty", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int("numpty" in (t or ""))) for i, t in enumerate(["numpty", "a", "a", "a", "a", "numpty"] * 30)] + [(None, 1), (3, None), (4, 0), (4, 0)], "doc_id long, toxic int")
    got = T.score(docs, T.fit(docs, labels)).collect()
    assert len(got) == 181 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in T.score(docs, T.fit(docs, labels.filter("toxic = 0"))).collect()} == {0.0}
    assert T.score(docs.limit(0), None).collect() == []


def test_pieces():
    own = T.Counter({b"idiotic": 50, b"the": 900})
    assert T.dictionary(own, T.Counter({b"the": 900})) == b" idiotic "
