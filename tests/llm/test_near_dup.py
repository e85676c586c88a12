import random
import re

import pytest

from tallyspark.llm import graph, near_dup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS sig", "2 AS comp", "3 AS rep")
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def corpus(seed, n):
    r = random.Random(seed)
    rows, base = [], []
    common = " ".join(r.choice("abcdefgh") * 3 for _ in range(30))
    for i in range(n):
        if base and r.random() < 0.6:
            w = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                k = r.randrange(len(w))
                w[k : k + r.choice([0, 1])] = [f"Z{r.randrange(10**6)}"]
        else:
            w = [f"w{r.randrange(5000)}" for _ in range(r.choice([1, 3, 5, 6, 9, 40, 90, 150]))]
            if r.random() < 0.3:
                w += common.split()
        base.append(w)
        rows.append((i * 7 % n + 1000, r.choice([" ", "\t", "\n "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 300)
    assert run(spark, rows) == brute(rows)


def test_odd_texts(spark):
    long = " ".join(f"t{i}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one  TWO"), (6, "É a"), (7, "é a"), (8, long), (9, long + " x"), (10, "k" * 3_000_000), (11, "a b c d e f"), (12, "a b c d e g")]
    assert run(spark, rows) == brute(rows)


def test_repeats_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "other words")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[1], r[2] or 0) for r in near_dup.near_duplicates(df).collect()) == [(0, 1, 0), (0, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 700), (600, 700)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(101)} | {500: 500, 600: 500, 700: 500}


def test_pairs_meet_about_once(spark):
    """Documents that share most tokens but don't link are no pair on each of these tokens."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):  # a word in forty is new, so two share some 78 % of their shingles; links are few
        rows.append((i, " ".join(f"Z{r.randrange(10**9)}" if r.random() < 0.028 else w for w in base)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_dup.signatures(d, near_dup.frequency_sketch(d)).withColumnRenamed("doc_id", "row").cache()
    labels = signed.selectExpr("row", "row AS rep", "row AS comp")
    met = near_dup.meetings(signed, labels)
    n, pairs = met.count(), met.selectExpr("least(ra, rb)", "greatest(ra, rb)").distinct().count()
    assert 0 < pairs and n <= 3 * pairs
    assert run(spark, rows) == brute(rows)
