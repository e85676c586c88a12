import hashlib
import re

from tallyspark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, t):
    digits = re.sub("[^0-9]", "", t)
    if kind == "ip":
        return all(int(x) <= 255 for x in t.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(map(int, reversed(digits))):
            total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), list(BASE).index(k), m.end(), k) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


TRICKY = [
    None, "", "a@b.c", "a@b.c._x@e.f", "x" * 5000 + "@a.b", "a@b..c d@e.f.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.0.00", "4111 1111 1111 1111 and 4111111111111112",
    "+1 (743) 555-3824) +12 3 +1234567890123456", "é😀 +1 (743) 555-3824 😀 x@y.zz 10.0.0.1", "9" * 60000, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", "@" * 50, "....@....a.b@c.d",
    "me@x.org,you@y.net;4012-8888-8888-1881.", "1.1.1.1111.2.2", "+1" + " " * 3000 + "5", "user [at] mail [dot] com or (743) 555-3824", "1" * 13 + "." + "1.1.1",
]


def check(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r["doc_id"]], r)
        assert set(want) <= set(filter(None, r["spans"].split(",")))
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]


def query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, cands string, base string").write.parquet(f"{tmp_path}/documents.parquet")
    return pii.op10_pii(spark, str(tmp_path)).collect()


def test_tricky_texts(spark, tmp_path):
    got = query(spark, tmp_path, [(i, t, None, "x", "y") for i, t in enumerate(TRICKY)])
    assert len(got) == len(TRICKY)
    check(got, dict(enumerate(TRICKY)))


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = pii.op10_pii(spark, d).collect()
    assert len(got) == len(texts)
    check(got, texts)


def test_em_finds_the_bad_labeler():
    counts = [("ip", 1, 1, 1, -1, 400), ("ip", -1, -1, 0, 1, 300), ("ip", -1, -1, -1, -1, 200), ("ip", 1, 1, 0, 1, 300)]
    table, post = pii.reliabilities(counts)
    assert post["ip", 1, 1, 1, -1] > 0.9 > 0.1 > post["ip", -1, -1, 0, 1]
    assert table["ip"][0][1][1] > 0.9


def test_many_matches_cost_in_proportion(spark, tmp_path):
    import time

    numbers = ",".join(str(10 + i % 90) for i in range(200_000)) + " and 4111 1111 1111 1111"
    mails = " ".join(f"a{i}@b{i}.com" for i in range(20_000))
    texts = {1: numbers, 2: mails + " user [at] mail [dot] com", None: "x@y.zz"}
    began = time.time()
    got = query(spark, tmp_path, [(i, t, None, "x", "y") for i, t in texts.items()])
    assert time.time() - began < 60
    check(got, texts)
    assert {r["doc_id"]: (r["n_card"], r["n_email"]) for r in got} == {1: (1, 0), 2: (0, 20_000), None: (0, 1)}


def test_added_spans_against_plain_python(spark, tmp_path):
    """The classifier again, from the candidates that were written, in plain Python."""
    import math

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    cands = pii.candidates(rows, "doc_id", "text")
    each = [(r["doc_id"], c) for r in cands.collect() for c in r["cands"]]
    counts = {}
    for _, c in each:
        k = (c["kind"], *(c[v] for v in pii.LABELERS))
        counts[k] = counts.get(k, 0) + 1
    _, post = pii.reliabilities([(*k, n) for k, n in counts.items()])
    one, zero = {}, {}
    for _, c in each:
        p = post[(c["kind"], *(c[v] for v in pii.LABELERS))]
        for f in pii.FEATURES:
            k = c["kind"], f, c[f]
            one[k], zero[k] = one.get(k, 0) + p, zero.get(k, 0) + 1 - p
    total = {k: [sum(v for (kind, f, _), v in side.items() if kind == k and f == "v_check") for side in (one, zero)] for k in pii.KINDS}

    def sure(c):
        a, b = total[c["kind"]]
        z = math.log((a + 1) / (b + 1))
        for f in pii.FEATURES:
            k = c["kind"], f, c[f]
            z += math.log((one[k] + 1) / (a + 10)) - math.log((zero[k] + 1) / (b + 10))
        return z > math.log(pii.SURE / (1 - pii.SURE))

    base = {}
    for i, c in each:
        if c["base"]:
            base.setdefault(i, []).append((c["s"], c["e"]))
    want = sorted((i, c["kind"], c["s"], c["e"]) for i, c in each if c["base"] or (c["loose"] and sure(c) and not any(s < c["e"] and c["s"] < e for s, e in base.get(i, []))))
    got = sorted((r["doc_id"], x["kind"], x["s"], x["e"]) for r in pii.find_pii(rows).collect() for x in r["spans"])
    assert got == want
