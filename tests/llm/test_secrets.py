import hashlib
import re
import time

from tallyspark.llm import secrets

BASE = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": (r"AKIA[A-Z0-9]+", 0), "hex": (r"[0-9a-f]+", 0)}
LEAST = {"access": 20, "hex": 24}


def brute(text):
    spans = []
    for r, (k, (p, flags)) in enumerate(BASE.items()):
        spans += [(m.start(), r, m.end(), k) for m in re.finditer(p, text or "", flags) if (len(m[2]) >= 6 if k == "assign" else len(m[0]) >= LEAST[k])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


TEXTS = [
    None, "", 'Token = "abcdef" PASSWD:x1y2z3 api_key=short apikey: \'Zz9-longer\'', "é😀 AKIA" + "A1" * 8 + " AKIA12", "f" * 23 + " " + "0" * 24 + "g" + "ab" * 20,
    "password: secret=abcdef", 'key_a = "q8Zr7-Tt55kLm"\nother = key_a\ndb_pwd = other\n', "greeting: hello there", "deadbeef" * 9000, "token" + " " * 9000 + "= abcdefg", "ſecret=abcdef toKen=abcdef",
]


def test_base_and_added_spans(spark, tmp_path):
    spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op4_secrets(spark, str(tmp_path)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = brute(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), TEXTS[r["doc_id"]]
        assert set(want) <= set(filter(None, r["spans"].split(",")))
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]


def test_constants_propagate():
    t = TEXTS[6]
    (kind, s, e, score), = secrets.scan(t)
    assert (kind, t[s:e]) == ("secret", "q8Zr7-Tt55kLm") and score >= secrets.SCORE
    assert secrets.scan("note: see chapter\nlabel = 'q8Zr7-Tt55kLm'") == []


def spans(text):
    return [text[s:e] for kind, s, e, _ in secrets.scan(text) if kind == "secret"]


def test_typed_and_chained_assignments():
    for t in (
        'DB_PWD: str = "hunter2Xy9"', 'const dbPwd: string = "hunter2Xy9"', 'val dbPwd: String? = "hunter2Xy9"', "static DB_PWD: &'static str = \"hunter2Xy9\";",
        'db_pwd: Optional[Dict[str, str]] = "hunter2Xy9"', 'let db_pwd: std::string::String = "hunter2Xy9"', 'dbPwd: string | null = "hunter2Xy9"', 'db_pwd: "str" = "hunter2Xy9"',
        'def f(user: str = "bob", db_pwd: str = "hunter2Xy9"):', 'db_pwd = backup = "hunter2Xy9"', 'backup = db_pwd = "hunter2Xy9"', "a = b = db_pwd = c = 'hunter2Xy9'", 'db_pwd=backup="hunter2Xy9"',
        'a: str = "hunter2Xy9"\ndb_pwd: str = a', "note: db_pwd = hunter2Xy9", "{user: admin, db_pwd = hunter2Xy9}", "x." * 100 + 'db_pwd = "hunter2Xy9"', "db_pwd = hunter2Xy9 = {",
    ):
        assert spans(t) == ["hunter2Xy9"], t
    assert spans("db_pwd = abc=deF9x") == ["abc=deF9x"] and spans("db_pwd = abC123xyz=") == ["abC123xyz="]
    assert spans('label: str = other = "hunter2Xy9"') == [] and spans("url: http://host/aB3?x=1") == []
    assert secrets.assignments('a = "x"; b: 1, c => d') == [("a", 5, 6), ("b", 12, 13), ("c", 20, 21)]


def test_long_texts_take_linear_time():
    for unit in ("a:", "a=", "a = ", "a: b[", "a::b:", "a.", 'a: "', "a: str = "):
        began = time.perf_counter()
        secrets.assignments(unit * 100_000)
        assert time.perf_counter() - began < 10, unit


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = secrets.op4_secrets(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(",".join(brute(texts[r["doc_id"]])).encode()).hexdigest()


def test_no_rows(spark):
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []
