import random
import re

import numpy as np
import pytest

from tallyspark.llm import decontaminate as D

ITEMS = [(1, " ".join(f"alpha{i}" for i in range(30))), (2, "One two three, four five six seven eight?"), (3, "too short to count"), (4, None), (5, "")]


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["matched"] for r in D.leaks(docs, items).collect()}


def test_substitutions_and_shifts(spark):
    w = ITEMS[0][1].split()
    swapped = [x if i % 8 else "other" for i, x in enumerate(w)]
    shifted = w[:9] + ["put", "in"] + w[9:18]
    r = random.Random(3)
    clean = " ".join(f"beta{r.randrange(50)}" for _ in range(5000))
    got = found(spark, [" ".join(["lead", *swapped, "tail"]), " ".join(shifted), " ".join(w[:12]), clean, None, "", "x ONE two; three four five six seven eight y", clean + " " + ITEMS[0][1].upper()])
    assert got == {(0, 1): 26, (1, 1): 18, (6, 2): 8, (7, 1): 30}


def test_no_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEMS[0][1]), (None, ITEMS[0][1])], "doc_id long, text string")
    assert D.leaks(docs.limit(0), items).collect() == D.leaks(docs, items.limit(0)).collect() == []
    assert sorted((r[0] or 0) for r in D.leaks(docs, items).collect()) == [0, 1]


def test_blocks_cover_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)
    test_substitutions_and_shifts(spark)


def test_against_brute_force(spark):
    """Whole word runs of 13 found by plain sets are all reported."""
    d = "/root/testdata/sf0.01"
    norm = lambda t: [x.lower() for x in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    grams = {}
    for r in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        w = norm(r["text"])
        for i in range(len(w) - 12):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(r["item_id"])
    want = set()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        w = norm(r["text"])
        for i in range(len(w) - 12):
            want |= {(r["doc_id"], x) for x in grams.get(tuple(w[i : i + 13]), ())}
    got = {(r["doc_id"], r["item_id"]): r for r in D.op8_decontaminate(spark, d).collect()}
    print(len(want), "exact overlaps,", len(got), "found", [tuple(got[k]) for k in sorted(set(got) - want)][:5])
    assert want <= set(got)
