"""Order-dependent and combinatorial operators: kernels over one key's rows, run by Spark.

Rows are dealt out by key and sorted within their partition, and Python walks them as a stream,
a key at a time: what a key allocates next depends on all it allocated before, so a key can't
be split, but small keys cost no more than their rows. A kernel keeps its key's rows only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque, namedtuple
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..scratch import durable
from ..shipping import ship

DUST = 1e-6
MOST_SUBSET_ROWS = 16  # fixed: larger groups get no suggestion


def _by_key(df: DataFrame, keys: list[str], find, made: str, order: tuple[str, ...] = ("ord", "id")) -> DataFrame:
    """``find`` gets a key's rows in order and gives a list of tuples, the columns of ``made``."""
    ship(df.sparkSession)
    fields = [*(df.schema[k] for k in keys), *StructType.fromDDL(made).fields]
    types, names, columns = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields], df.columns

    def run(batches):
        row = namedtuple("Row", columns)
        place = [columns.index(k) for k in keys]
        rows = (row(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        found = []
        for key, own in groupby(rows, lambda r: tuple(r[i] for i in place)):
            found += [(*key, *x) for x in find(list(own))]
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types)], names=names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types)], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, StructType(fields))


def _with_roles(rows: DataFrame, keys: list[str], needed: tuple[str, str]) -> DataFrame:
    """Rows of keys that hold both roles; only these need a kernel."""
    both, known = Window.partitionBy(*keys), F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    held = [F.count_if(F.col("role") == role).over(both) for role in needed]
    return rows.filter(known).withColumns({"_a": held[0], "_b": held[1]}).filter("_a > 0 AND _b > 0").drop("_a", "_b")


def replay_allocations(lots: list[tuple], decisions: list[tuple]) -> list[tuple]:
    """(sell_id, lot_id, shares, fees, taxes) of decisions in their order.

    ``lots``: (lot_id, shares). ``decisions``: (sell_id, sell_shares, fees, taxes, lot_id,
    shares) in sell-time order. A line that asks for more than its lot still has is left out
    whole; fees and taxes are shared out by shares.
    """
    left = dict(lots)
    out = []
    for sell_id, sold, fees, taxes, lot_id, shares in decisions:
        if lot_id in left and 0 < shares <= left[lot_id] + DUST:
            left[lot_id] -= shares
            part = shares / sold if sold else 0.0
            out.append((sell_id, lot_id, shares, fees * part, taxes * part))
    return out


def allocate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Explicit allocation of all keys. Rows: keys, kind ('lot' or 'line'), ord, id (of the lot
    or the sell), lot_id, sell_shares, shares, fees, taxes."""

    def find(rows: list) -> list[tuple]:
        lots = [(r.lot_id, r.shares) for r in rows if r.kind == "lot"]
        return replay_allocations(lots, [(r.id, r.sell_shares, r.fees, r.taxes, r.lot_id, r.shares) for r in rows if r.kind == "line"])

    return _by_key(rows, keys, find, "sell_id string, lot_id string, shares double, fees double, taxes double", ("ord", "id", "lot_id"))


def match_greedy(candidates: list[tuple], evidence: list[tuple], tolerance: float = 0.05) -> dict:
    """Candidate id to evidence id, each evidence used once, both in their order.

    Candidates: (id, side, shares, price, minutes, day); evidence the same and its total value.
    Dated evidence must be of the candidate's day and have its value within the tolerance,
    undated evidence its shares, and a price within it. Times that both know must be equal;
    midnight is a time like any other.
    """
    if not evidence:
        return {}
    ids, sides, shares, prices, minutes, days, totals = (np.array(x, dtype=object) for x in zip(*evidence))
    number = lambda x: np.array([np.nan if v is None else v for v in x], float)
    shares, prices, minutes, totals = map(number, (shares, prices, minutes, totals))
    dated = np.array([d is not None for d in days])
    free = np.ones(len(ids), bool)
    near = lambda a, b: np.abs(a - b) <= np.maximum(a, b) * tolerance
    out = {}
    for cid, side, n, price, at, day in candidates:
        alike = free & (sides == side)
        if at is not None:
            alike &= np.isnan(minutes) | (minutes == at)
        with np.errstate(invalid="ignore"):
            fits = np.where(dated, (days == day) & near(totals, n * price), (shares == n) & near(prices, price))
        hit = np.flatnonzero(alike & fits)
        if len(hit):
            free[hit[0]] = False
            out[cid] = ids[hit[0]]
    return out


def order_evidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, evidence_id): matches, and orphan evidence with a null id. Rows: keys, role
    ('candidate' or 'evidence'), ord, id, side, shares, price, minutes, day, total."""

    def find(rows: list) -> list[tuple]:
        candidates = [(r.id, r.side, r.shares, r.price, r.minutes, r.day) for r in rows if r.role == "candidate"]
        evidence = [(r.id, r.side, r.shares, r.price, r.minutes, r.day, r.total) for r in rows if r.role == "evidence"]
        got = match_greedy(candidates, evidence)
        used = set(got.values())
        return [*got.items(), *((None, e[0]) for e in evidence if e[0] not in used)]

    met = _by_key(_with_roles(rows, keys, ("candidate", "evidence")), keys, find, "id string, evidence_id string")
    alone = rows.filter("role = 'evidence'").join(rows.filter("role = 'candidate'").select(*keys).distinct(), keys, "left_anti")
    return met.unionByName(alone.select(*keys, F.lit(None).cast("string").alias("id"), F.col("id").alias("evidence_id")))


def smallest_subset(pool: list[tuple], total: float) -> list[int] | None:
    """Places of the fewest pool rows (id, shares, price) whose shares add up to the total.

    One choice is kept for each sum, the first of the fewest rows, so the work is the pool's size
    times the number of sums up to the total. A choice is its last row and the choice before it.
    """
    want = round(total * 1e6)
    kept: dict[int, tuple] = {0: (0, None, None)}
    for i, (_, shares, _) in enumerate(pool):
        step = round(shares * 1e6)
        for had, choice in list(kept.items()):
            now, n = had + step, choice[0] + 1
            if now <= want and (now not in kept or n < kept[now][0]):
                kept[now] = (n, i, choice)
    if want <= 0 or want not in kept:
        return None
    places, choice = [], kept[want]
    while choice[0]:
        places.append(choice[1])
        choice = choice[2]
    return places[::-1]


def statement_aggregates(rows: DataFrame, keys: list[str], tolerance: float = 0.02) -> DataFrame:
    """(keys, statement_id, searched, parts): statement rows that are sums of executions, each used
    once; statements by rising shares. The executions' mean price must be within the tolerance
    of the statement's. All executions are searched, however many are left. Rows: keys, role
    ('statement' or 'execution'), ord, id, shares, price.

    The first of the fewest rows are the first of each size, so of executions of one size no more
    are looked at than the statement's shares hold, and the work follows sizes and shares, never the
    key's rows; statements of equal shares look once until a sum is found."""

    def find(rows: list) -> list[tuple]:
        pool = [(r.id, r.shares, r.price) for r in rows if r.role == "execution"]
        sizes: dict[int, deque[int]] = {}
        for i, (_, shares, _) in enumerate(pool):
            sizes.setdefault(round(shares * 1e6), deque()).append(i)
        sizes.pop(0, None)  # adds nothing
        rising = all(step > 0 for step in sizes)
        found, last, parts = [], None, None
        for sid, shares, price in sorted(((r.id, r.shares, r.price) for r in rows if r.role == "statement"), key=lambda x: x[1]):
            want = round(shares * 1e6)
            if want != last:
                near = sorted(i for step, own in sizes.items() for i in islice(own, max(want // step, 0) if rising else None))
                last, parts = want, [near[j] for j in smallest_subset([pool[i] for i in near], shares) or ()]
                mean = sum(pool[i][1] * pool[i][2] for i in parts) / sum(pool[i][1] for i in parts) if parts else None
            if parts and abs(mean - price) <= max(mean, price) * tolerance:
                found.append((sid, True, ",".join(pool[i][0] for i in parts)))
                for i in parts:
                    sizes[round(pool[i][1] * 1e6)].remove(i)
                last = None
        return found

    return _by_key(_with_roles(rows, keys, ("statement", "execution")), keys, find, "statement_id string, searched boolean, parts string")


def removal_suggestion(rows: list[tuple], units: float, avg_cost: float | None = None, existing: float = 0.0, existing_cost_micros: int | None = None) -> tuple[list, int, bool] | None:
    """The rows to remove so that existing shares and the rest come to the units, how many other
    ways there are, and whether mean cost ranked them.

    Rows: (id, signed shares, price, confidence 0..2). Of all proper subsets that one is best
    that leaves the mean cost nearest to ``avg_cost`` (by whole percents; only among buys),
    then has the least confidence, then the fewest rows, then comes first.
    """
    n = len(rows)
    if not 0 < n <= MOST_SUBSET_ROWS:
        return None
    signed = np.array([r[1] for r in rows], float)
    surplus = existing + signed.sum() - units
    if abs(surplus) < DUST:
        return None
    sums = np.zeros(1)
    for x in signed:
        sums = np.concatenate([sums, sums + x])
    masks = np.flatnonzero(np.abs(sums - surplus) < DUST)
    masks = masks[(masks > 0) & (masks < 2**n - 1)]
    if not len(masks):
        return None
    taken = (masks[:, None] >> np.arange(n)) & 1
    ranked = bool(avg_cost) and avg_cost > 0 and bool((signed > 0).all()) and (existing == 0 or existing_cost_micros is not None)
    bucket = np.zeros(len(masks))
    if ranked:
        micros = np.array([np.floor(np.floor(r[2] * 1e6 + 0.5) * r[1] + 0.5) for r in rows])
        cost, shares = (existing_cost_micros or 0) + (1 - taken) @ micros, existing + (1 - taken) @ signed
        mean = np.floor(cost / np.where(shares > 0, shares, 1) + 0.5) / 1e6
        bucket = np.where(shares > 0, np.floor(np.abs(mean - avg_cost) / avg_cost * 100 + 0.5), 2.0**53 - 1)
    best = np.lexsort((masks, taken.sum(1), taken @ np.array([r[3] for r in rows]), bucket))[0]
    return [rows[i][0] for i in np.flatnonzero(taken[best])], len(masks) - 1, ranked


def mismatch_suggestions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, searched, remove, alternatives, ranked): one row a key. Keys of more than
    ``MOST_SUBSET_ROWS`` rows aren't searched, others may have no way: both have null ``remove``.
    Rows: keys, ord, id, signed_shares, price, confidence, units, avg_cost, existing,
    existing_cost_micros."""

    def find(rows: list) -> list[tuple]:
        one = rows[0]
        got = removal_suggestion([(r.id, r.signed_shares, r.price, r.confidence) for r in rows], one.units, one.avg_cost, one.existing, one.existing_cost_micros)
        return [(True, ",".join(got[0]), got[1], got[2])] if got else [(True, None, None, None)]

    rows = durable(rows, "rows")  # it is read three times
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    few = sizes.filter(F.col("n") <= MOST_SUBSET_ROWS).drop("n")
    made = "searched boolean, remove string, alternatives long, ranked boolean"
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in made.split(", ")[1:]]
    return _by_key(rows.join(few, keys, "left_semi"), keys, find, made).unionByName(sizes.filter(F.col("n") > MOST_SUBSET_ROWS).select(*keys, F.lit(False).alias("searched"), *none))


def duplicate_lots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, remove): untouched lots that are probably read twice, of tickers with more shares
    than the broker counts. With a mean cost and few lots as ``removal_suggestion`` finds them;
    else the cheapest first, each only if the count isn't undershot. Rows: keys, ord, id, price,
    shares, remaining, computed, units, avg_cost."""

    def find(rows: list) -> list[tuple]:
        one, whole = rows[0], [r for r in rows if r.remaining == r.shares]
        if one.avg_cost is not None and 0 < len(whole) <= MOST_SUBSET_ROWS and (got := removal_suggestion([(r.id, r.shares, r.price, 2) for r in whole], one.units, one.avg_cost)):
            return [(",".join(got[0]),)]
        left, ids = one.computed, []
        for i, n in ((r.id, r.shares) for r in sorted(whole, key=lambda r: r.price)):
            if left > one.units and left - n >= one.units:
                ids.append(i)
                left -= n
        return [(",".join(ids),)] if ids else []

    return _by_key(rows, keys, find, "remove string")


def repair_official_sells(lots: list[tuple], decided: list[tuple], sells: list[tuple]) -> dict:
    """First-in first-out lines of official sales: sell id to [(lot_id, shares)], or None where
    lots dated no later don't suffice.

    ``lots``: (lot_id, shares, at) in time order; ``decided``: (lot_id, shares) that other sales
    take first; ``sells``: (sell_id, shares, at) in time order, unknown times (None) taking any.
    """
    left = {i: s for i, s, _ in lots}
    for i, s in decided:
        if i in left:
            left[i] = max(0.0, left[i] - s)
    ats = [at for _, _, at in lots]
    known = [at for at in ats if at is not None]
    place = [p for p, at in enumerate(ats) if at is not None]
    in_order, last_unknown = known == sorted(known), max((p for p, at in enumerate(ats) if at is None), default=-1)
    follow = list(range(len(lots) + 1))  # the first place from here on that may have shares left
    sums = [0.0] * (len(lots) + 1)  # a binary indexed tree of what is left: what the first lots can give at most
    slack = DUST + 1e-9 * sum(left.values())

    def add(p: int, x: float) -> None:
        p += 1
        while p < len(sums):
            sums[p] += x
            p += p & -p

    def upto(p: int) -> float:
        total = 0.0
        while p > 0:
            total += sums[p]
            p -= p & -p
        return total

    def open_from(p: int) -> int:
        while True:
            root = p
            while follow[root] != root:
                root = follow[root]
            while follow[p] != root:
                follow[p], p = root, follow[p]
            if root == len(lots) or left[lots[root][0]] > DUST:
                return root
            follow[root] = p = root + 1

    for p, (i, _, _) in enumerate(lots):
        add(p, left[i])
    out = {}
    for sid, need, at in sells:
        n = bisect_right(known, at) if at is not None and in_order else 0
        end = max(place[n - 1] if n else -1, last_unknown) + 1 if at is not None and in_order else len(lots)
        if need > DUST and need - upto(end) > slack:
            out[sid] = None
            continue
        lines = []
        p = open_from(0)
        while need > DUST and p < end:
            i, _, lot_at = lots[p]
            if at is None or lot_at is None or lot_at <= at:
                take = min(left[i], need)
                lines.append((p, i, take))
                need -= take
            p = open_from(p + 1)
        if need > DUST:
            out[sid] = None
            continue
        for p, i, take in lines:
            left[i] -= take
            add(p, -take)
        out[sid] = [(i, take) for _, i, take in lines]
    return out


def match_consuming(canonical: list[tuple], stored: list[tuple], tolerance: float = 0.01) -> dict:
    """Canonical id to stored id, each stored row used once; numbered rows choose first: by
    number, then by the price to four places, then by the closest price within the tolerance.
    Rows: (id, number, price)."""
    used, out = set(), {}
    for cid, number, price in sorted(canonical, key=lambda r: r[1] is None):
        best = None
        for k, (sid, snumber, sprice) in enumerate(stored):
            if sid in used:
                continue
            same = number is not None and number == snumber
            if not same and abs(price - sprice) > max(price, sprice) * tolerance:
                continue
            rank = (0 if same else 1 if round(price * 1e4) == round(sprice * 1e4) else 2, abs(price - sprice), k)
            if best is None or rank < best[0]:
                best = (rank, sid)
        if best:
            used.add(best[1])
            out[cid] = best[1]
    return out


def repaired_official_sells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sell_id, lot_id, shares): lines of official sales, first in first out; a sale that
    its lots can't serve has one row without a lot. Rows: keys, role ('lot', 'decided' or
    'sell'), ord (time order), id, lot_id (of decided lines), shares, at."""

    def find(rows: list) -> list[tuple]:
        part = lambda role, *cols: [tuple(getattr(r, c) for c in cols) for r in rows if r.role == role]
        got = repair_official_sells(part("lot", "id", "shares", "at"), part("decided", "lot_id", "shares"), part("sell", "id", "shares", "at"))
        return [(sid, lot, n) for sid, lines in got.items() for lot, n in (lines if lines is not None else [(None, None)])]

    with_sells = rows.filter("role = 'sell'").select(*keys).distinct()
    return _by_key(rows.join(with_sells, keys, "left_semi"), keys, find, "sell_id string, lot_id string, shares double")


def matched_canonical(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, stored_id): canonical rows and the stored row that each takes, every stored row
    once. Rows: keys, role ('canonical' or 'stored'), ord, id, number, price."""

    def find(rows: list) -> list[tuple]:
        part = lambda role: [(r.id, r.number, r.price) for r in rows if r.role == role]
        return list(match_consuming(part("canonical"), part("stored")).items())

    return _by_key(_with_roles(rows, keys, ("canonical", "stored")), keys, find, "id string, stored_id string")
