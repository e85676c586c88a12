"""Matches of candidates among existing rows: against brute force, and what is paired for them."""

import random

import pytest

from tallyspark.operators import resolve as R

SCHEMA = "id string, portfolio_id long, ticker_id long, kind string, execution_date string, shares long, price double, minutes int, number string"


def brute(own, existing):
    out = set()
    for c in own:
        same = [e for e in existing if e[1:4] == c[1:4] and None not in c[1:4]]
        by_number = [e[0] for e in same if c[8] is not None and e[8] == c[8]]
        fits = []
        for e in same:
            clash = c[7] and e[7] and c[7] != e[7] or c[8] is not None and e[8] is not None and c[8] != e[8]
            if e[1:6] == c[1:6] and None not in c[1:6] and not clash:
                k = 1 if round(c[6] * 10000) == round(e[6] * 10000) else 2
                fits.append((k, 0.0 if k == 1 else abs(c[6] - e[6]), e[0]))
        if by_number:
            out.add((c[0], min(by_number), 0))
        elif fits:
            out.add((c[0], min(fits)[2], min(fits)[0]))
    return out


def rows(r, prefix, n):
    return [(f"{prefix}{i:03}", r.choice([1, 1, 2, None]), r.choice([1, 2]), "BuyExecution", r.choice(["a", "a", "b", None]), r.choice([10, 20]), r.choice([1.0, 1.00001, 1.5, 2.0, 3.0]), r.choice([None, 0, 60, 120]), r.choice([None, None, *"pqrstuv"])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    own, existing = rows(r, "c", 150), rows(r, "e", 120)
    got = R.duplicate_matches(spark.createDataFrame(own, SCHEMA), spark.createDataFrame(existing, SCHEMA), R.CONTENT)
    assert {tuple(x) for x in got.collect()} == brute(own, existing)


def test_pairs_follow_prices_not_numbers(spark, tmp_path):
    """600 rows of one key a side, each with its own number: 360,000 pairs if rows are paired."""
    key = (1, 1, "BuyExecution", "a", 10)
    side = lambda p: spark.createDataFrame([(f"{p}{i}", *key, 1.0 + i % 3, None, f"{p}{i}" if i % 2 else None) for i in range(600)], SCHEMA)
    df = R.duplicate_matches(side("c"), side("e"), R.CONTENT)
    assert df.count() == 600
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    made, todo = [], [plan]
    while todo:
        p = todo.pop()
        if "QueryStage" in p.getClass().getSimpleName():
            todo.append(p.plan())
        elif p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        if "Join" in p.getClass().getSimpleName():
            made.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert made and max(made) <= 600
