import hashlib
import random

import pytest

from tallyspark.llm import exact_dedup as X


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, kept = [], set()
    for i, t in rows:
        g = groups[t or ""]
        best = max((x for x in g if x is not None), default=None)
        keep = i == best and (t or "") not in kept
        if keep:
            kept.add(t or "")
        out.append((i, best, len(g), keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(str, out))


def rows_of(seed):
    r = random.Random(seed)
    texts = [None, "", "a", "a ", "A", "é" * 700 + ". " + "x" * 9000, "line one.\nline two.\n" * 400, "no cut here " * 2000, "😀" * 5000, "y" * 300_000]
    texts += ["".join(r.choice("ab .\n") for _ in range(r.choice([5, 600, 5000]))) for _ in range(10)]
    return [(i, r.choice(texts)) for i in range(120)] + [(7, "a"), (7, "a"), (None, "a"), (None, "only null")]


@pytest.mark.parametrize("digest_bytes", [32, 1])  # with one byte most digests stand for many chunks
def test_against_brute_force(spark, digest_bytes):
    rows = rows_of(digest_bytes)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, recipe string, keep_id string")
    got = sorted(str(tuple(r)) for r in X.exact_dedup(df, digest_bytes=digest_bytes).collect())
    assert got == brute(rows)
    assert X.exact_dedup(df.limit(0)).collect() == []


def test_chunks_join_to_the_text(spark):
    rows = [(i, t) for i, t in rows_of(3) if t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    c = X.chunks(F.col("text"))
    assert df.filter(F.array_join(c, "") != F.col("text")).count() == 0
    assert df.filter(F.exists(c, lambda x: F.length(x) > X.MAX_CHUNK)).count() == 0


def test_one_of_repeated_rows_stays(spark):
    df = spark.createDataFrame([(7, "t"), (7, "t"), (3, "t"), (None, "n"), (None, "n"), (None, "t"), (5, None), (5, "")], "doc_id long, text string")
    got = X.exact_dedup(df).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in got if r["kept"]) == [(0, 0, 2), (5, 5, 2), (7, 7, 4)]
    assert len(got) == 8
