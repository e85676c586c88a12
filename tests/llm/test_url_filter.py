import random

from tallyspark.llm import url_filter as U

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host) :]
        for c in "?#":
            path = path.split(c, 1)[0]
        host = host.translate(LOW)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def run(spark, urls, rules, **more):
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    return {r["page_id"]: tuple(r)[1:] for r in U.url_filter(df, U.rules_frame(spark, rules), **more).collect()}


def test_against_brute_force(spark):
    r = random.Random(6)
    label = lambda: r.choice(["a", "b", "com", "net", "www", "é", ""])
    host = lambda: ".".join(label() for _ in range(r.randrange(1, 5)))
    path = lambda: "".join(r.choice(["/", "a", "b", "/en", "%", "é", "\U0010ffff"]) for _ in range(r.randrange(0, 6)))
    rules = list({(h, p): (v, h, p) for v, h, p in [(r.choice(["allow", "block"]), host(), path()) for _ in range(150)]}.values())
    urls = [r.choice(["http", "HTTPS", ""]) + "://" + r.choice([host(), host().upper()]) + r.choice(["", "/"]) + path() + r.choice(["", "?q=/a", "#f?", "?://x/"]) for _ in range(600)]
    urls += [None, "", "no scheme", "://", "a://b://c/d", "x://A.COM"] + ["http://a.b.com/en/x"] * 50
    want = {i: brute(u, rules) for i, u in enumerate(urls)}
    assert run(spark, urls, rules) == want
    assert run(spark, urls, rules, target=3) == want


def test_no_rules_and_no_pages(spark):
    assert run(spark, ["http://a.com/x"], U.RULES[:0] or [("allow", "zz", "/q")])[0] == ("a.com", "/x", None, "allow")
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.url_filter(df, U.rules_frame(spark)).collect() == []
    pages = spark.createDataFrame([(None, "http://x.net/es/1"), (None, "http://x.net/es/1")], "page_id long, url string")
    assert [r["verdict"] for r in U.url_filter(pages, U.rules_frame(spark)).collect()] == ["block", "block"]
    assert [r["rule"] for r in U.url_filter(pages, U.rules_frame(spark).limit(0)).collect()] == [None, None]
