import zlib

import numpy as np

from tallyspark.llm import language_id as L


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in L.op3_language_id(spark, d).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    assert set(rows) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    out = [rows[i]["lang_pred"] == y for i, y in truth.items() if rows[i]["held_out"]]
    print("held-out accuracy", np.mean(out), len(out))
    assert np.mean(out) > 0.9


def test_tables_agree_with_the_network():
    r = np.random.default_rng(1)
    net = L.Network(["a", "b", "c"])
    x = r.integers(0, 64, (5, L.WINDOW))
    pooled = [sum(net.filters[w][j][x[:, j : L.WINDOW - w + 1 + j]] for j in range(w)).max(1) + net.bias[w] for w in L.WIDTHS]
    want = L.softmax(np.maximum(np.concatenate(pooled, 1), 0) @ net.dense + net.offset)
    assert np.abs(net.tables().probabilities(x.astype(np.uint8)) - want).max() < 0.01


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "12 -- 34", "en"), (None, "the cat and the dog", None), (5, "x" * 1_000_000, "en"), (5, "the cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.identify(df, L.fit(df)).collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3 and len(got) == 6
    none = L.identify(df, L.fit(df.filter("false"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert L.identify(df.filter("false"), L.fit(df)).collect() == []


def test_what_is_no_letter(spark):
    rows = [(1, "\u00bd \u00b2 \u2167 \u2460 12 _", None), (2, "", None), (3, None, None), (4, "\u00b2 a", None)]
    train = spark.createDataFrame([(i, ["the cat sat on the mat", "le chat est sur la table"][i % 2], ["en", "fr"][i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), L.fit(train)).collect()}
    assert [got[i]["lang_pred"] == "und" for i in (1, 2, 3, 4)] == [True, True, True, False] and got[1]["score"] == 0


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_ROWS", 600)
    train = spark.createDataFrame([(i, " ".join([f"w{i % 300}x"] * 40), f"l{i % 300}") for i in range(1800)], "doc_id long, text string, lang string")
    parts = L.training_windows(train, "doc_id", "text", "lang", 800)
    assert len({y for y, _, _ in parts}) > 200 and len({h for _, _, h in parts}) < 900
