import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import Row

from tallyspark.llm import periodic_runs as P


def brute(words):
    """Every lag over every position; of stretches that coincide the smallest lag is the period."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                best.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def found(words):
    numbers = {}
    own = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    return list(zip(*(x.tolist() for x in P.runs_of(own, np.array([0, len(own)])))))


def test_runs_of_random_and_nested_words():
    r = random.Random(3)
    texts = ["", "a", "aaaaaa", "aaaaa", "abababab", "abababa", "aabaabaabaab" * 2, "ab" * 9 + "c" + "ab" * 9]
    for k in range(1500):
        base = "".join(r.choice("abcdefgh"[: r.randrange(1, 9)]) for _ in range(r.randrange(1, 9)))
        t = "".join(r.choice("abcxyz"[: r.randrange(1, 7)]) for _ in range(r.randrange(30))) + base * r.randrange(1, 8) + base[: r.randrange(len(base) + 1)]
        t += t[-r.randrange(1, 20) :] * r.randrange(6) + r.choice(["", "zz", "q"])
        texts.append(t * r.choice([1, 1, 1, 4, 5]))
    for t in texts:
        assert found(t) == brute(t), t


def test_texts_side_by_side_do_not_touch():
    own = np.array([0, 0, 0] + [0, 0, 0] + [0] * 6 + [1, 2] * 4 + [2, 1], np.int64)
    assert [x.tolist() for x in P.runs_of(own, np.array([0, 3, 6, 12, 20, 22]))] == [[6, 12], [6, 8], [1, 2]]


def test_splitting_ends_with_words_frequent_in_each_segment():
    r = random.Random(4)
    word = np.array([r.randrange(40) for _ in range(4000)] + [r.randrange(3) for _ in range(500)], np.int64)
    s, e = P.split_by_frequency(word, np.array([0, 2000]), np.array([2000, 4500]))
    assert len(s) and all(np.unique(word[a:z], return_counts=True)[1].min() >= 4 and z - a >= 6 for a, z in zip(s, e))


def test_long_texts_take_near_linear_time():
    r = np.random.Generator(np.random.PCG64(1))
    word = np.concatenate([np.zeros(200_000, np.int64), r.integers(0, 30, 400_000), np.tile(r.integers(0, 1000, 30_000), 5)])
    began = time.perf_counter()
    s, n, q = P.runs_of(word, np.array([0, len(word)]))
    assert time.perf_counter() - began < 60
    assert (0, 1) in set(zip(s.tolist(), q.tolist())) and 30_000 in q.tolist()


def expected(doc_id, text):
    w = [x for x in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
    if w and (t := P.planted_tail(doc_id, len(w))):
        a, p = t
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    numbers = {}
    runs = brute([numbers.setdefault(x, len(numbers)) for x in w])
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = s, n, q
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_every_lag(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in P.op11_periodic_runs(spark, sf).collect()]
    short = [d for d in docs if len(d.text or "") < 12_000]  # every lag of the others takes too long here
    want = {expected(*d) for d in short}
    assert len(got) == len(docs) and {g for g in got if g[0] in {d.doc_id for d in short}} == want
    assert sum(g[1] > 0 for g in got) > 5


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (2, " \t\n", 3), (3, "a b " * 4, 4), (3, "a b " * 4, 4), (None, "x x\x1c " * 6, 5), (4, "word " * 300_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(P.periodic_runs(df).collect(), key=str)
    assert sorted(len(r.runs) for r in got) == [0, 0, 0, 1, 1, 1, 1]
    assert [r.collapsed for r in got if r.doc_id == 3] == ["a b", "a b"]
    assert [r.runs for r in got if r.doc_id == 4] == [[Row(start=0, length=300_000, period=1)]]
    assert [r.collapsed for r in got if r.doc_id is None and r.runs] == ["x x\x1c"]
    assert P.periodic_runs(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 7, 100])
def test_planted_tails(n):
    hits = [(i, t) for i in range(200) if (t := P.planted_tail(i, n))]
    assert hits and all(0 <= a < n and 1 <= p <= 1 + n // 3 for _, (a, p) in hits) and P.planted_tail(None, n) is None
