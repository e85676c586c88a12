"""Convergence and coverage against plain loops."""

import datetime as dt
import random

from tallyspark.operators import convergence as C
from tallyspark.operators import sweep as W

D = dt.date(2026, 1, 5)
FACT = "id string, seq long, kind string, ticker string, execution_date date, shares long, price double, minutes int, source string, retracted boolean"
RANK = {"invoice": 6, "official-broker-excel": 5, "statement": 4, "csv": 1, "manual": 0}


def apart(a, b):
    return bool(a) and bool(b) and a != b


def test_pointers_reach_the_end_of_long_chains(spark):
    pairs = [(f"a{i:04d}", f"a{i + 1:04d}") for i in range(300)] + [("b", "c"), ("c", "b"), ("d", "b"), ("e", "a0299"), ("f", "f")]
    got = {r.id: r.final for r in C.final_targets(spark.createDataFrame(pairs, "id string, winner string")).collect()}
    assert got == {f"a{i:04d}": "a0300" for i in range(300)} | {"e": "a0300"}


def plain(facts, decisions, trades, earlier):
    groups = {}
    for f in facts:
        if not f[9]:
            groups.setdefault((f[3], f[2], *f[4:7]), []).append(f)
    gone = {}
    for key, rows in groups.items():
        if any(apart(a[7], b[7]) for a in rows for b in rows):
            continue
        if key[1] == "BuyExecution":
            mine = [t for t in trades if (t[0], "BuyExecution", *t[1:4]) == key and all(not apart(f[7], t[4]) for f in rows)]
            if len({f"number:{t[5]}" if t[5] else f"time:{t[4] if t[4] is not None else 'unknown'}" for t in mine}) > 1:
                continue
        best = min(rows, key=lambda f: (-RANK[f[8]], f[1], f[0]))
        gone |= {f[0]: best[0] for f in rows if RANK[f[8]] < RANK[best[8]]}
    to = dict(sorted((gone | {}).items()))
    for a, b in earlier:
        to[a] = min(b, to.get(a, b))

    def final(i):
        seen = set()
        while i in to and i not in seen:
            seen.add(i)
            i = to[i]
        return i

    dead = {f[0] for f in facts if f[9]} | set(gone)
    by_id, out = {f[0]: f for f in facts}, {}
    for i, sell, lines in decisions:
        new = []
        for lot, n in lines:
            lot = final(lot)
            old = by_id.get(lot)
            if old and old[2] == "BuyExecution" and lot in dead:
                fits = [f for f in facts if f[2] == "BuyExecution" and f[0] not in dead and f[3:7] == old[3:7] and not apart(f[7], old[7])]
                lot = min(fits, key=lambda f: (-RANK[f[8]], f[1], f[0]))[0] if fits else lot
            new.append((lot, n))
        if (final(sell), new) != (sell, lines):
            out[i] = (final(sell), new)
    return gone, out


def test_convergence_against_a_plain_loop(spark):
    r = random.Random(12)
    facts = [(f"x{i:03d}", i, r.choice(["BuyExecution", "BuyExecution", "SellExecution"]), r.choice("AB"), D + dt.timedelta(r.randrange(3)), r.choice([10, 20]), r.choice([1.5, 2.0]), r.choice([None, None, 0, 600, 660]), r.choice(list(RANK)), r.random() < 0.3) for i in range(220)]
    trades = [(r.choice("AB"), D + dt.timedelta(r.randrange(3)), r.choice([10, 20]), r.choice([1.5, 2.0]), r.choice([None, 600]), r.choice([None, "1", "2"])) for _ in range(14)]
    ids = [f[0] for f in facts]
    earlier = [(f[0], ids[min(219, i + r.randrange(1, 9))]) for i, f in enumerate(facts[:-1]) if f[9] and r.random() < 0.4]
    decisions = [(f"d{i:02d}", r.choice(ids), [(r.choice([*ids, "absent"]), r.randrange(1, 9)) for _ in range(r.randrange(4))]) for i in range(80)]
    gone, new = C.converge(
        spark.createDataFrame(facts, FACT), spark.createDataFrame(decisions, "id string, sell_execution_id string, allocations array<struct<lot_ref: string, shares: long>>"),
        spark.createDataFrame(trades, "ticker string, execution_date date, shares long, price double, minutes int, number string"), spark.createDataFrame(earlier, "id string, winner string"),
    )
    want_gone, want = plain(facts, decisions, trades, earlier)
    assert {x.id: x.winner for x in gone.collect()} == want_gone and want_gone
    got = {x.id: (x.sell_execution_id, [(a.lot_ref, a.shares) for a in x.allocations]) for x in new.collect()}
    assert got == want and want


def test_coverage_by_twins_against_a_plain_loop(spark):
    r = random.Random(13)
    row = lambda i: (1, r.randrange(12), r.choice(["BuyExecution", "SellExecution"]), D, r.choice([10, 20]), 1.5, r.choice([None, 0, 600, 660]), r.choice(list(RANK)), r.random() < 0.4)
    schema = "portfolio_id long, ticker_id long, kind string, execution_date date, shares long, price double, minutes int, source string, retracted boolean"
    facts, seen = [row(i) for i in range(160)], [row(i) for i in range(60)]
    want = {}
    for t in {f[1] for f in facts if not f[8]}:
        live = [f for f in facts if f[1] == t and not f[8]]

        def twin(f, retracted, known):
            return any(g[8] == retracted and g[1:6] == f[1:6] and RANK[g[7]] > RANK[f[7]] and not apart(f[6], g[6]) and (not known or (f[6] and g[6])) for g in facts)

        want[t] = all(RANK[f[7]] >= 5 or twin(f, False, True) or twin(f, True, False) for f in live)
    got = {x.ticker_id: x.fully_official for x in W.official_coverage(spark.createDataFrame(facts, schema)).collect()}
    assert got == want and any(want.values()) and not all(want.values())

    few = [f for f in facts if f[7] not in ("invoice", "official-broker-excel") and f[1] < 9][:14]
    have = [(1, t, 0.0 if t % 2 else 5.0) for t in range(10)]
    expected = {}
    for t in {c[1] for c in seen if c[7] == "official-broker-excel"}:
        live, official = [f for f in few if f[1] == t and not f[8]], [c for c in seen if c[1] == t and c[7] == "official-broker-excel"]
        expected[t] = all(any(c[2:6] == f[2:6] and not apart(c[6], f[6]) for c in official) for f in live) if live else t < 10 and t % 2 == 1
    got = {x.ticker_id: x.covered for x in W.session_coverage(spark.createDataFrame(few, schema), spark.createDataFrame(seen, schema), spark.createDataFrame(have, "portfolio_id long, ticker_id long, existing double")).collect()}
    assert got == expected and any(expected.values())
