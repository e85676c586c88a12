import base64
import hashlib
import os
import random
import sys

import corpus_pipeline
from tallyspark.llm import decontaminate, queries

sys.path.insert(0, os.path.dirname(__file__))
from test_near_dup import brute  # noqa: E402


def test_run_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for t, i in last.items()}
    components = brute(sorted(rows.items()))
    rows = {i: t for i, t in rows.items() if components[i][1] == i}
    leaks = {r["doc_id"] for r in decontaminate.op8_decontaminate(spark, d).collect()}
    rows = {i: t for i, t in rows.items() if i not in leaks}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == set(rows)
    for i, r in got.items():
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"]) and r["text_sha256"] == hashlib.sha256(rows[i].encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat today", "en", "s", 3), (1, "the cat sat on the mat today", "en", "s", 3), (None, None, None, None, None), (2, "le chat est sur la table", "fr", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact_dedup_stage(spark, df.unionByName(df.limit(2)), "").collect()
    assert sorted((r["doc_id"] or 0) for r in exact) == [0, 1, 2]  # of four equal rows one stays, null ids too
    clash = df.selectExpr("*", "1 AS hit", "2 AS d", "3 AS sha", "4 AS again", "map('k', 1) AS m")
    assert corpus_pipeline.exact_dedup_stage(spark, clash, "").schema.names == clash.schema.names
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "/root/testdata/sf0.001").schema.names == df.schema.names
        assert stage(spark, df.limit(0), "/root/testdata/sf0.001").collect() == []


def test_language_stage_rejects_what_is_in_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(5)
    noise = [
        "".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(600)), base64.b64encode(r.randbytes(400)).decode(), "xqzjv kwpfh qqxz vbnmk jhgfd zxcvb qwrtp", "1234567 x 89012345",
        "for (int i = 0; i < n; ++i) { if (buf[i] == NULL) return -EINVAL; kfree(ctx->ptr); memcpy(dst, src, sizeof(struct foo_hdr)); }",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    ]
    clean = ["Von.", "That it.", "Osrañ.", "Erinst resh.", "Pachque çaneux et.", "Of anntre erthnd, thlyre to the."]
    added = spark.createDataFrame([(10**6 + i, t, "en", "s", len(t)) for i, t in enumerate(noise + clean)], docs.schema)
    got = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs.unionByName(added), "").select("doc_id").collect()}
    assert [i for i in range(len(noise)) if 10**6 + i in got] == []
    assert got == {r["doc_id"] for r in docs.collect()} | {10**6 + len(noise) + i for i in range(len(clean))}


def test_registered():
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run and len(queries.QUERIES) == 11
