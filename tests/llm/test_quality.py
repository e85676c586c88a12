import numpy as np

from tallyspark.llm import quality as Q


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in Q.op7_quality(spark, d).collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    out = [(rows[i]["predicted"], y) for i, y in truth.items() if rows[i]["held_out"]]
    good, bad = np.mean([p for p, y in out if y]), np.mean([1 - p for p, y in out if not y])
    print("held out: good kept", good, "bad found", bad)
    assert good > 0.9 and bad > 0.6


def test_shrinkage_and_odd_rows(spark):
    docs = [(i, ["good plain text here. ", "### $$$ !!! "][i % 2] * 20, "a", "b", 1) for i in range(100)] + [(None, None, None, None, 1), (500, "", "x", None, 1), (500, "", "x", None, 1), (501, "good plain text", "rare", "b", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, score int")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (7, None), (8, 0)], "doc_id long, quality int")
    got = Q.quality(df, labels).collect()
    assert len(got) == 104 and all(0 < r["score"] < 1 for r in got)
    one = {r["doc_id"]: r for r in got}
    assert one[80]["score"] > 0.5 > one[81]["score"]
    assert {r["score"] for r in Q.quality(df, labels.limit(0)).collect()} == {0.5}
    assert Q.quality(df.limit(0), labels).collect() == []


def test_training_reads_whole_texts(spark):
    same = "plain words " * 9_000  # the first 100,000 characters tell nothing
    df = spark.createDataFrame([(i, same + ["good plain text here. ", "### $$$ !!! "][i % 2] * 9_000, "a", "b") for i in range(40)], "doc_id long, text string, source string, lang string")
    one = {r["doc_id"]: r["evidence"] for r in Q.quality(df, spark.createDataFrame([(i, 1 - i % 2) for i in range(30)], "doc_id long, quality int")).collect()}
    assert one[38] > 0.8 and one[39] < 0.2


def test_posteriors_against_plain_python(spark):
    import math

    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality(docs, labels).collect()
    meta = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.select("doc_id", "source", "lang").collect()}
    import zlib

    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 3}
    e = {r["doc_id"]: float(y.get(r["doc_id"], r["evidence"])) for r in got}
    paths, sites = {}, {}
    for i, x in e.items():
        for table, key in ((paths, meta[i]), (sites, meta[i][0])):
            a, n = table.get(key, (0.0, 0))
            table[key] = (a + x, n + 1)
    prior = sum(a for a, _ in sites.values()) / sum(n for _, n in sites.values())

    def strength(rows):
        n = sum(k for _, k, _ in rows)
        each = sum(k * p * (1 - p) for _, k, p in rows) / n
        between = (sum(k * (m - p) ** 2 for m, k, p in rows) - len(rows) * each) / n
        return min(1000.0, max(1.0, each / between - 1)) if between > 0 else 1000.0

    ks = strength([(a / n, n, prior) for a, n in sites.values()])
    kp = strength([(a / n, n, (sites[k[0]][0] + ks * prior) / (sites[k[0]][1] + ks)) for k, (a, n) in paths.items()])
    rows = {r["doc_id"]: r for r in got}
    base = None
    for i, r in rows.items():
        (sa, sn), (pa, pn) = sites[meta[i][0]], paths[meta[i]]
        site = (sa - e[i] + ks * prior) / (sn - 1 + ks)
        path = (pa - e[i] + kp * site) / (pn - 1 + kp)
        assert math.isclose(r["site_mean"], site, rel_tol=1e-9) and math.isclose(r["path_mean"], path, rel_tol=1e-9)
        held = min(max(path, 1e-3), 1 - 1e-3)
        odds = lambda p: math.log(p / (1 - p))
        if 1e-9 < r["evidence"] < 1 - 1e-9:
            shift = odds(r["evidence"]) + odds(held) - odds(r["score"])  # the prior of training, the same for all
            base = shift if base is None else base
            assert math.isclose(shift, base, abs_tol=1e-6)
