"""Sums of executions in large pools, against the search over the whole pool."""

import random

from tallyspark.operators import grouped as G

ROW = "k long, role string, ord string, id string, shares double, price double"


def plain(rows):
    pool, found = [(r[3], r[4], r[5]) for r in rows if r[1] == "execution"], {}
    for sid, shares, price in sorted(((r[3], r[4], r[5]) for r in rows if r[1] == "statement"), key=lambda x: x[1]):
        if parts := G.smallest_subset(pool, shares):
            mean = sum(pool[i][1] * pool[i][2] for i in parts) / sum(pool[i][1] for i in parts)
            if abs(mean - price) <= max(mean, price) * 0.02:
                found[sid] = ",".join(pool[i][0] for i in parts)
                pool = [x for i, x in enumerate(pool) if i not in set(parts)]
    return found


def test_pools_of_any_size_are_searched(spark):
    r, rows = random.Random(8), []
    for k, sizes in enumerate(([10.0, 20.0, 30.0], [0.5, 1.25, 3.0], [7.0, 11.0, 13.0, 0.0])):
        for i in range(90):
            role = r.choice(["execution"] * 5 + ["statement"])
            rows.append((k, role, f"{i:03d}", f"{k}-{i:03d}", r.choice(sizes) * (r.choice([1, 2, 3]) if role == "statement" else 1), r.choice([100.0, 101.0, 104.0])))
    got = G.statement_aggregates(spark.createDataFrame(rows, ROW), ["k"]).collect()
    assert {x.statement_id: x.parts for x in got} == plain([x for x in rows if x[0] == 0]) | plain([x for x in rows if x[0] == 1]) | plain([x for x in rows if x[0] == 2])
    assert all(x.searched for x in got) and len({x.k for x in got}) == 3


def test_a_key_of_many_rows_costs_no_more_than_its_rows(spark):
    """10,000 statements before 30,000 executions: a search of the pool for each would be 3e8 steps and more."""
    rows = [(1, "execution", f"{i:05d}", f"e{i:05d}", float(i % 3 + 1), 100.0 + i % 2) for i in range(30_000)]
    rows += [(1, "statement", f"{i:05d}", f"s{i:05d}", float(i % 3 + 3), 101.0 if i % 2 else 900.0) for i in range(10_000)]
    got = G.statement_aggregates(spark.createDataFrame(rows, ROW), ["k"]).collect()
    assert len(got) == 5_000 and len({p for x in got for p in x.parts.split(",")}) == sum(len(x.parts.split(",")) for x in got)
