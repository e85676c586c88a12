"""Repair of official sales, against walking all lots for each sale."""

import random
import time

from tallyspark.operators.grouped import DUST, repair_official_sells


def by_walking(lots, decided, sells):
    left = {i: s for i, s, _ in lots}
    for i, s in decided:
        if i in left:
            left[i] = max(0.0, left[i] - s)
    out = {}
    for sid, need, at in sells:
        lines = []
        for i, _, lot_at in lots:
            if need > DUST and left[i] > DUST and (at is None or lot_at is None or lot_at <= at):
                lines.append((i, min(left[i], need)))
                need -= lines[-1][1]
        out[sid] = None if need > DUST else lines
        for i, take in out[sid] or []:
            left[i] -= take
    return out


def test_against_walking():
    rng = random.Random(2)
    for n in range(400):
        at = lambda: rng.choice((None, *range(9))) if n % 3 else rng.randrange(9)
        order = (lambda x: (x[2] is not None, x[2] or 0)) if n % 4 else (lambda x: 0)
        share = lambda: rng.choice((0.0, 1e-7, 0.1, 0.2, 0.3, 1.5, 7.0))
        lots = sorted([(f"l{i}", share() * 2, at()) for i in range(rng.randrange(12))], key=order)
        sells = sorted([(f"s{i}", share(), at()) for i in range(rng.randrange(12))], key=order)
        decided = [(f"l{rng.randrange(14)}", share()) for _ in range(rng.randrange(4))]
        assert repair_official_sells(lots, decided, sells) == by_walking(lots, decided, sells)


def test_sales_and_lots_are_not_paired():
    """40,000 lots and as many sales: walking all lots for each would be 1.6e9 steps."""
    lots = [(f"l{i}", 10.0, float(i)) for i in range(40_000)]
    sells = [(f"s{i}", 15.0 if i % 2 else 1e9, float(i)) for i in range(40_000)]
    began = time.process_time()
    got = repair_official_sells(lots, [], sells)
    assert got["s0"] is None and got["s3"] == [("l1", 5.0), ("l2", 10.0)] and time.process_time() - began < 20
