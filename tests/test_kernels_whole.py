"""The kernels' queries over whole tables against plain loops over the same rows."""

from itertools import groupby

from tallyspark.operators import grouped as G
from tallyspark.plans import misc_queries as M


def by_key(rows, keys, order=("ord", "id")):
    rows = sorted((r.asDict() for r in rows.collect()), key=lambda r: (*(str(r[k]) for k in keys), *(r[o] for o in order)))
    return [(k, list(g)) for k, g in groupby(rows, lambda r: tuple(r[x] for x in keys))]


def result(df, keys, columns):
    return sorted((tuple(map(str, (r[k] for k in keys))), *(r[c] for c in columns)) for r in df.collect())


def near(a, b, share):
    return abs(a - b) <= max(a, b) * share


def test_allocation_replay(spark, sf):
    keys, want = ["portfolio_id", "ticker_id"], []
    for k, rows in by_key(M._allocation_rows(spark, sf), keys, ("ord", "id", "lot_id")):
        left = {r["lot_id"]: r["shares"] for r in rows if r["kind"] == "lot"}
        for r in rows:
            if r["kind"] == "line" and r["lot_id"] in left and 0 < r["shares"] <= left[r["lot_id"]] + 1e-6:
                left[r["lot_id"]] -= r["shares"]
                want.append((tuple(map(str, k)), r["id"], r["lot_id"], r["shares"], r["fees"] * (r["shares"] / r["sell_shares"])))
    assert result(M.QUERIES["allocation_replay"](spark, sf), keys, ["sell_id", "lot_id", "shares", "fees"]) == sorted(want) and want


def test_order_evidence(spark, sf):
    keys, want = ["portfolio_id", "ticker_id", "side"], []
    for k, rows in by_key(M._evidence_rows(spark, sf), keys):
        used = set()
        for c in (r for r in rows if r["role"] == "candidate"):
            for i, e in enumerate(rows):
                if e["role"] != "evidence" or i in used or (c["minutes"] is not None and e["minutes"] is not None and c["minutes"] != e["minutes"]):
                    continue
                if (e["day"] == c["day"] and near(e["total"], c["shares"] * c["price"], 0.05)) if e["day"] else (e["shares"] == c["shares"] and near(e["price"], c["price"], 0.05)):
                    used.add(i)
                    want.append((tuple(map(str, k)), c["id"], e["id"]))
                    break
        want += [(tuple(map(str, k)), "", e["id"]) for i, e in enumerate(rows) if e["role"] == "evidence" and i not in used]
    got = sorted((tuple(map(str, (r[x] for x in keys))), r["id"] or "", r["evidence_id"]) for r in M.QUERIES["order_evidence"](spark, sf).collect())
    assert got == sorted(want) and any(x[1] for x in want)


def test_official_repair(spark, sf):
    keys, want = ["portfolio_id", "ticker_id"], []
    for k, rows in by_key(M._official_rows(spark, sf), keys):
        lots = [[r["id"], r["shares"], r["at"]] for r in rows if r["role"] == "lot"]
        for r in rows:
            if r["role"] == "decided":
                lot = next(x for x in lots if x[0] == r["lot_id"])
                lot[1] = max(0.0, lot[1] - r["shares"])
        for r in (x for x in rows if x["role"] == "sell"):
            need, lines = r["shares"], []
            for lot in lots:
                if lot[2] <= r["at"] and lot[1] > 1e-6 and need > 1e-6:
                    take = min(lot[1], need)
                    lines.append((lot, take))
                    need -= take
            if need > 1e-6:
                want.append((tuple(map(str, k)), r["id"], "", -1.0))
                continue
            for lot, take in lines:
                lot[1] -= take
                want.append((tuple(map(str, k)), r["id"], lot[0], take))
    got = sorted((tuple(map(str, (r[x] for x in keys))), r["sell_id"], r["lot_id"] or "", -1.0 if r["shares"] is None else r["shares"]) for r in M.QUERIES["official_sell_repair"](spark, sf).collect())
    assert len(got) == len(want) and {x[:3] for x in got} == {x[:3] for x in want}


def test_canonical_matches(spark):
    d, keys, want = "/root/testdata/sf0.01", ["portfolio_id", "ticker_id", "kind", "execution_date", "shares"], []
    for k, rows in by_key(M._canonical_rows(spark, d), keys):
        used = set()
        for c in sorted((r for r in rows if r["role"] == "canonical"), key=lambda r: r["number"] is None):
            fits = []
            for i, s in enumerate(rows):
                same = c["number"] is not None and c["number"] == s["number"]
                if s["role"] == "stored" and i not in used and (same or near(c["price"], s["price"], 0.01)):
                    fits.append((0 if same else 1 if round(c["price"] * 1e4) == round(s["price"] * 1e4) else 2, abs(c["price"] - s["price"]), i))
            if fits:
                used.add(min(fits)[2])
                want.append((tuple(map(str, k)), c["id"], rows[min(fits)[2]]["id"]))
    assert result(M.QUERIES["canonical_matches"](spark, d), keys, ["id", "stored_id"]) == sorted(want) and len(want) > 20


def test_duplicate_lots_never_undershoot(spark, sf):
    keys = ["portfolio_id", "ticker_id"]
    groups = dict(by_key(M._duplicate_lot_rows(spark, sf), keys))
    got = {(r["portfolio_id"], r["ticker_id"]): r["remove"].split(",") for r in M.QUERIES["suspected_duplicate_lots"](spark, sf).collect()}
    for k, rows in groups.items():
        one, gone = rows[0], got.get(k, [])
        whole = {r["id"]: r for r in rows if r["remaining"] == r["shares"]}
        assert set(gone) <= set(whole)
        solver = one["avg_cost"] is not None and 0 < len(whole) <= G.MOST_SUBSET_ROWS and abs(sum(whole[i]["shares"] for i in gone) - (sum(r["shares"] for r in whole.values()) - one["units"])) < 1e-6
        if gone and not solver:
            assert one["computed"] - sum(whole[i]["shares"] for i in gone) >= one["units"]
            cheapest = min((r for r in whole.values() if one["computed"] - r["shares"] >= one["units"]), key=lambda r: r["price"])
            assert min(whole[i]["price"] for i in gone) == cheapest["price"]
    assert got


def test_statement_parts(spark):
    d, keys = "/root/testdata/sf0.01", ["portfolio_id", "ticker_id", "execution_date", "kind"]
    rows = {}
    for k, own in by_key(M._statement_rows(spark, d), keys):
        for r in own:
            rows[tuple(map(str, k)), r["id"]] = r
    got = M.QUERIES["statement_aggregates"](spark, d).collect()
    assert any(r["searched"] for r in got)
    for r in (x for x in got if x["searched"]):
        k = tuple(map(str, (r[x] for x in keys)))
        s, parts = rows[k, r["statement_id"]], [rows[k, i] for i in r["parts"].split(",")]
        assert sum(p["shares"] for p in parts) == s["shares"] and all(p["role"] == "execution" for p in parts)
        assert near(sum(p["price"] * p["shares"] for p in parts) / s["shares"], s["price"], 0.02)
