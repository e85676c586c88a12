"""Verification queries over the adapters, and their SQL, which compares row by row as the rules
are stated."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouped as G
from ..operators import ledger as L
from ..operators import sweep as W
from ..operators import verification as V
from ..scratch import durable
from ..sources import adapters as S
from .oracle import ENTRIES, with_

_ORDER = ["id", "shares"]


def _signed(s, d):
    """Entries with aggregates and orders by rule, as if their kernels had found them."""
    return S.entries(s, d).withColumn("aggregated", F.col("l_orderkey") % 11 == 0).withColumn("ordered", F.col("l_orderkey") % 7 < 3)


def _corroborated(s, d):
    """Entries with what tickers are judged by, dealt out by ticker: what looks at a content key
    or a ticker shuffles them no more."""
    return V.with_corroboration(_signed(s, d).repartition(*V.TICKER))


def _entries(s, d):
    """Entries with all signs, dealt out by ticker."""
    return V.with_corroboration(V.with_duplicates(V.with_other_ticker(_signed(s, d)).repartition(*V.TICKER), _ORDER))


def _judged(s, d):
    """Entries with all signs and what is decided of their tickers."""
    return V.verdicts(V.with_ticker(_entries(s, d), S.existing_shares(s, d), S.counted_units(s, d)))


def _tickers(s, d, session=False):
    return V.match_tickers(V.ticker_inputs(_corroborated(s, d), S.existing_shares(s, d), S.counted_units(s, d), session))


def _suggestion_rows(s, d, tickers=None):
    e = S.entries(s, d)
    signed = F.when(F.col("kind") == "BuyExecution", F.col("shares")).otherwise(-F.col("shares")).cast("double")
    rank = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    rows = e.select(*V.TICKER, F.col("l_orderkey").alias("ord"), "id", signed.alias("signed_shares"), "price", rank.alias("confidence"))
    t = (_tickers(s, d) if tickers is None else tickers).filter("reason = 'mismatch' AND NOT already_recorded").select(*V.TICKER, "units", "avg_cost", "existing")
    return rows.join(t, V.TICKER).join(S.existing_shares(s, d).drop("existing"), V.TICKER)


def _suggestions(s, d, tickers=None):
    return G.mismatch_suggestions(_suggestion_rows(s, d, tickers), V.TICKER)


def _orphans(s, d):
    """Order evidence that no row explains: the fulfilled orders of order screens whose content and
    price no row of another kind of source has."""
    e, keys = S.entries(s, d), [*V.CONTENT, "price"]
    o = e.filter("source = 'orders-screen'").join(e.filter("source IS NULL OR source <> 'orders-screen'").select(*keys).distinct(), keys, "left_anti")
    return o.groupBy(*V.TICKER).agg(F.count(F.lit(1)).alias("n_orphans"), F.sum("shares").cast("double").alias("orphan_shares"), F.max("execution_date").alias("last_orphan"))


def _on_file(s, d):
    return S.existing_shares(s, d).select(*V.TICKER, (F.col("ticker_id") % 8 < 3).alias("orders"), (F.col("ticker_id") % 16 == 4).alias("day_covered"))


def _completeness(s, d, tickers=None):
    return V.completeness(_tickers(s, d) if tickers is None else tickers, _orphans(s, d), L.last_balanced_date(S.entries(s, d), V.TICKER), _on_file(s, d))


def _reconcile(s, d):
    e = S.entries(s, d)
    net = F.sum(F.when(F.col("kind") == "BuyExecution", F.col("shares")).otherwise(-F.col("shares")))
    g = e.groupBy(*V.TICKER).agg(net.alias("shares"), F.max("execution_date").alias("last_date"), F.bool_and(V.source_of() == "official-broker-excel").alias("official"))
    counts = S.counted_units(s, d).withColumn("captured_on", F.add_months(F.lit("1997-01-01").cast("date"), (F.col("ticker_id") % 60).cast("int")))
    return V.reconcile(g.select(*V.TICKER, "shares"), counts, g.select(*V.TICKER, "last_date"), g.filter("official"))


def _resolved(s, d):
    e = S.entries(s, d)
    what = F.when(F.col("l_linenumber") < 6, "transaction").when(F.col("l_linenumber") == 6, "dividend").otherwise("verification")
    state = F.when(what == "transaction", F.element_at(F.array(*map(F.lit, ("added", "skipped", "dismissed"))), (F.col("l_suppkey") % 3 + 1).cast("int"))).when(what == "dividend", F.lit("added")).otherwise("accepted")
    rows = e.select(*V.TICKER, what.alias("what"), F.when(F.col("l_orderkey") % 23 != 0, state).alias("state"), (F.col("l_orderkey") % 29 == 0).alias("failed"))
    return V.resolved_tickers(rows, _tickers(s, d), e.filter("l_orderkey % 31 = 0 AND kind = 'SellExecution'"))


def _gate(s, d):
    """Asked about: every ticker with entries, and every part's own portfolio."""
    asked = S.entries(s, d).select(*V.TICKER).unionByName(S.trades(s, d).select("portfolio_id", F.col("trade_id").alias("ticker_id")))
    return V.commit_gate(asked, _judged(s, d))


def _diagnosis(s, d):
    t = durable(_tickers(s, d), "tickers")
    e = V.with_other_ticker(S.entries(s, d)).groupBy(*V.TICKER).agg(F.count("other_ticker").alias("n_wrong"), F.count_if(F.col("l_orderkey") % 17 == 0).alias("n_misread"))
    found = _suggestions(s, d, t).filter("remove IS NOT NULL").select(*V.TICKER, "alternatives")
    signs = e.join(found, V.TICKER, "left").join(_orphans(s, d).select(*V.TICKER, "n_orphans"), V.TICKER, "left").join(L.last_balanced_date(S.entries(s, d), V.TICKER).select(*V.TICKER, "balanced_on"), V.TICKER, "left")
    return V.diagnose(t, signs)


def _root_causes(s, d):
    t = durable(_tickers(s, d), "tickers")
    return V.root_causes(t, _suggestions(s, d, t).filter("remove IS NOT NULL"))


def _uploads(s, d):
    """Each order number is an upload; every seventh row has no day."""
    e = S.entries(s, d).withColumn("source", F.when(F.col("l_orderkey") % 12 == 3, "orders-timeline").when(F.col("l_orderkey") % 12 == 5, "position-verification").otherwise(V.source_of()))
    return e.select("portfolio_id", F.col("l_orderkey").alias("upload_id"), "source", "ticker_id", F.when(F.col("l_linenumber") != 7, F.col("execution_date")).alias("execution_date"), "id", F.concat_ws("|", "id", F.col("ticker_id").cast("string"), F.col("execution_date").cast("string")).alias("ord"))


def _covered(s, d):
    probes = S.entries(s, d).select("portfolio_id", "ticker_id", F.add_months("execution_date", 3).alias("day")).distinct()
    return V.covered_days(probes, V.coverage_claims(_uploads(s, d)).filter("upload_id % 40 = 4"))


def _verified(s, d):
    return _judged(s, d).withColumn("upload_id", F.when(F.col("l_linenumber") != 2, F.col("l_orderkey"))).withColumn("fees", F.col("l_linenumber") * 1.5).withColumn("taxes", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 0.5))


def _evidence(s, d):
    v = _verified(s, d)
    donors = v.select(F.col("id").alias("other_id"), F.col("source").alias("other_source"))
    e = V.with_evidence(v.join(donors, "other_id", "left"))
    return e.select("id", "portfolio_id", "ticker_id", "verdict", F.array_join(F.transform("evidence", lambda x: F.concat_ws("=", x["type"], x["other"])), ",").alias("evidence"))


def _graph(s, d):
    """Nodes and edges, from rows that are written once with their tickers' reasons."""
    v = durable(_verified(s, d).select(*V.TICKER, "id", "other_id", "upload_id", "reason", "verdict"), "verified")
    return V.evidence_graph(v, v.select(*V.TICKER, "reason").distinct(), _orphans(s, d))


def _edges(s, d):
    return _graph(s, d)[1].groupBy("portfolio_id", "edge").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


def _placeholders(s, d):
    """Open lots of the ledger: every other ticker's are opening balances."""
    t = _tickers(s, d).withColumn("already_recorded", F.col("existing") == F.col("units")).withColumn("net", F.col("existing") + F.col("units"))
    lots = S.existing_shares(s, d).filter("existing > 0").select(*V.TICKER, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("id"), (F.col("existing") / 2).alias("shares"), (F.col("existing") / 2).alias("remaining"), F.when((F.col("ticker_id") % 2 == 0) | (F.col("id") == "a"), "Opening balance of 2025").alias("notes"))
    return V.placeholder_lots(t, lots)


def _intelligence(s, d):
    of_ticker = ["existing", "buy", "sell", "net", "units", "reason", "matched"]
    v = durable(_verified(s, d).select(*V.CONTENT, "price", "minutes", "id", "source", "fees", "taxes", "verdict", *of_ticker), "verified")
    tickers = v.groupBy(*V.TICKER).agg(*[F.first(c).alias(c) for c in of_ticker])
    return V.intelligence(V.canonical_transactions(v.repartition(*V.TICKER)), v, _completeness(s, d, tickers))


def _completed(s, d):
    e = S.entries(s, d).withColumn("fees", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linenumber") * 1.5)).withColumn("taxes", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 0.5))
    return V.completed(e).groupBy("portfolio_id", "source", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("n_filled").alias("n_filled"), F.sum(F.col("fees") * 2).cast("bigint").alias("fees"), F.sum(F.col("taxes") * 2).cast("bigint").alias("taxes"), F.count("minutes").alias("n_minutes"), F.sum(F.col("number").cast("bigint")).alias("numbers"))


QUERIES = {
    "completed_rows": _completed,
    "inventory_diagnosis": _diagnosis,
    "coverage_claims": lambda s, d: V.coverage_claims(_uploads(s, d)),
    "covered_days": _covered,
    "evidence_edges": _edges,
    "evidence_lists": _evidence,
    "evidence_nodes": lambda s, d: _graph(s, d)[0].groupBy("portfolio_id", "kind", "label").agg(F.count(F.lit(1)).alias("n")),
    "canonical_transactions": lambda s, d: V.canonical_transactions(_verified(s, d)),
    "evidence_intelligence": _intelligence,
    "placeholder_lots": _placeholders,
    "ticker_split": lambda s, d: W.ticker_split(_tickers(s, d), _resolved(s, d)),
    "corroborated_rows": lambda s, d: _entries(s, d).groupBy("portfolio_id", V.source_of().alias("source")).agg(*[F.count_if(c).alias(f"n_{c}") for c in ("cross_verified", "other_document", "duplicate")], F.count("other_ticker").alias("n_other_ticker"), F.sum("other_ticker").alias("other_tickers"), F.count(F.lit(1)).alias("n")),
    "ticker_match_status": _tickers,
    "session_ticker_status": lambda s, d: _tickers(s, d, True),
    "verdict_histogram": lambda s, d: V.verdict_counts(_judged(s, d)),
    "commit_gate": _gate,
    "resolved_tickers": _resolved,
    "completeness": _completeness,
    "reconciled_positions": _reconcile,
    "merge_suggestions": lambda s, d: V.merge_suggestions(S.entries(s, d).withColumn("shares", F.lit(10)).withColumn("price", F.lit(1.0)).withColumn("execution_date", F.trunc("execution_date", "year")).withColumn("confidence", F.when(F.col("ticker_id") % 5 != 0, "low").otherwise("high"))),
    "mismatch_suggestions": _suggestions,
    "root_causes": _root_causes,
}

_C = "portfolio_id, ticker_id, kind, execution_date, shares"
_ON = " AND ".join(f"a.{c} = b.{c}" for c in _C.split(", "))
_SAME = "coalesce(a.number = b.number, NOT coalesce(a.minutes <> b.minutes, false) AND abs(a.price - b.price) <= greatest(a.price, b.price) * 0.02)"
_FLAGS = f"""dk AS (SELECT {_C} FROM v_entries GROUP BY ALL HAVING count(DISTINCT source) >= 2 OR (bool_or(source = 'invoice') AND bool_or(source IS NULL))),
cv AS (SELECT DISTINCT a.rid FROM v_entries a JOIN v_entries b ON {_ON} SEMI JOIN dk d ON {_ON.replace('b.', 'd.')} WHERE a.source IS DISTINCT FROM b.source AND {_SAME}),
od AS (SELECT a.rid, min(b.id) AS oid FROM v_entries a JOIN v_entries b ON {_ON} WHERE b.source IS NOT NULL AND a.source IS DISTINCT FROM b.source AND NOT coalesce(nullif(a.minutes, 0) <> nullif(b.minutes, 0), false) GROUP BY 1),
sv AS (SELECT * FROM v_entries QUALIFY row_number() OVER (PARTITION BY {_C} ORDER BY coalesce(source, '~') <> 'invoice', CASE WHEN kind = 'BuyExecution' THEN -price ELSE price END, id, shares) = 1),
du AS (SELECT a.rid FROM v_entries a JOIN sv b ON {_ON} WHERE a.id <> b.id AND {_SAME}),
ot AS (SELECT a.rid, arg_min(b.ticker_id, b.id) AS t FROM v_entries a JOIN v_entries b ON a.portfolio_id = b.portfolio_id AND a.kind = b.kind AND a.execution_date = b.execution_date AND a.shares = b.shares AND a.ticker_id <> b.ticker_id
  WHERE a.confidence <> 'high' AND abs(a.price - b.price) <= greatest(a.price, b.price) * 0.10 GROUP BY 1),
e AS (SELECT v.*, cv.rid IS NOT NULL AS c, od.rid IS NOT NULL AS o, oid, du.rid IS NOT NULL AS u, ot.t AS t, l_orderkey % 11 = 0 AS ag, l_orderkey % 7 < 3 AS od FROM v_entries v LEFT JOIN cv USING (rid) LEFT JOIN od USING (rid) LEFT JOIN du USING (rid) LEFT JOIN ot USING (rid))"""


def _match(session: bool) -> str:
    own = "coalesce(source, '~') IN ('invoice', 'official-broker-excel') OR " if session else ""
    ordered = own + ("c OR ag OR od" if session else "od")
    return f"""i AS (SELECT portfolio_id, ticker_id, existing, coalesce(buy, 0.0) AS buy, coalesce(sell, 0.0) AS sell, coalesce(k, 0) AS k, units, avg_cost, coalesce(ai, false) AS ai, coalesce(ao, false) AS ao, coalesce(av, false) AS av, coalesce(ar, false) AS ar
  FROM (SELECT portfolio_id, ticker_id, CAST(coalesce(sum(shares) FILTER (kind = 'BuyExecution'), 0) AS DOUBLE) AS buy, CAST(coalesce(sum(shares) FILTER (kind = 'SellExecution'), 0) AS DOUBLE) AS sell, count(*) AS k, bool_and(coalesce(source, '~') = 'invoice') AS ai,
    bool_and(coalesce(source, '~') = 'official-broker-excel') AS ao, bool_and({own}c OR ag) AS av, bool_and({ordered}) AS ar FROM e GROUP BY 1, 2) FULL JOIN v_existing USING (portfolio_id, ticker_id) LEFT JOIN v_units USING (portfolio_id, ticker_id)),
w AS (SELECT *, existing + buy - sell AS net, CASE WHEN NOT {"(k > 0 OR abs(existing) >= 1e-6)" if session else "buy + sell > 0"} THEN 'no-shares-to-verify' WHEN ao THEN 'broker-excel-verified' WHEN existing + buy - sell < -1e-6 THEN 'no-verification'
  WHEN units IS NULL THEN CASE WHEN ai THEN 'invoice-verified' WHEN av THEN 'cross-verified' WHEN ar THEN 'orders-verified' WHEN abs(existing + buy - sell) < 1e-6 THEN 'closed-position' ELSE 'no-verification' END
  WHEN abs(existing + buy - sell - units) < 1e-6 THEN 'matched' ELSE 'mismatch' END AS reason FROM i),
tm AS (SELECT portfolio_id, ticker_id, existing, buy, sell, net, CASE WHEN NOT (reason = 'no-verification' AND net < -1e-6) THEN units END AS units, CASE WHEN NOT (reason = 'no-verification' AND net < -1e-6) THEN avg_cost END AS avg_cost, reason,
  reason NOT IN ('no-verification', 'closed-position', 'mismatch') AS matched, CASE WHEN reason = 'mismatch' THEN CASE WHEN net > units THEN 'buy' ELSE 'sell' END WHEN reason = 'no-verification' THEN CASE WHEN net >= 0 THEN 'buy' ELSE 'sell' END END AS side,
  coalesce(reason = 'mismatch' AND abs(existing - units) < 1e-6, false) AS already_recorded, coalesce(reason = 'broker-excel-verified' AND abs(net - units) >= 1e-6, false) AS secondary_mismatch FROM w)"""


_E = with_(ENTRIES, _FLAGS)
_T = with_(ENTRIES, _FLAGS, _match(False))
#: All proper subsets of up to 16 rows whose shares net to the surplus, ranked as stated.
_SUB = """rw AS (SELECT e.portfolio_id, e.ticker_id, row_number() OVER k - 1 AS i, count(*) OVER (PARTITION BY e.portfolio_id, e.ticker_id) AS n, id, CASE WHEN kind = 'BuyExecution' THEN shares ELSE -shares END AS s, kind = 'BuyExecution' AS b, price, shares,
    CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS cf, tm.units, tm.avg_cost, tm.net, tm.existing, x.existing_cost FROM e JOIN tm USING (portfolio_id, ticker_id) JOIN v_existing x USING (portfolio_id, ticker_id) WHERE tm.reason = 'mismatch' AND NOT tm.already_recorded
    WINDOW k AS (PARTITION BY e.portfolio_id, e.ticker_id ORDER BY l_orderkey, id)),
mk AS (SELECT portfolio_id, ticker_id, unnest(range(1, (1 << n) - 1)) AS mask FROM (SELECT DISTINCT portfolio_id, ticker_id, CAST(n AS INTEGER) AS n FROM rw WHERE n <= 16)),
sl AS (SELECT portfolio_id, ticker_id, mask, bool_and(b) AND any_value(avg_cost) > 0 AS ranked, any_value(avg_cost) AS ac, count(*) FILTER (mask >> i & 1 = 1) AS cnt, sum(cf) FILTER (mask >> i & 1 = 1) AS conf, string_agg(id, ',' ORDER BY i) FILTER (mask >> i & 1 = 1) AS remove,
    any_value(existing_cost) + coalesce(sum(CAST(floor(CAST(floor(price * 1e6 + 0.5) AS BIGINT) * shares + 0.5) AS BIGINT)) FILTER (mask >> i & 1 = 0), 0) AS kc, any_value(existing) + coalesce(sum(shares) FILTER (mask >> i & 1 = 0), 0) AS ks
  FROM rw JOIN mk USING (portfolio_id, ticker_id) GROUP BY 1, 2, 3 HAVING abs(coalesce(sum(s) FILTER (mask >> i & 1 = 1), 0) - (any_value(net) - any_value(units))) < 1e-6),
bs AS (SELECT *, CASE WHEN NOT coalesce(ranked, false) THEN 0 WHEN ks <= 0 THEN 9007199254740991 ELSE floor(abs(floor(kc / ks + 0.5) / 1e6::DOUBLE - ac) / ac * 100 + 0.5) END AS bucket FROM sl),
sg AS (SELECT portfolio_id, ticker_id, remove, CAST(k - 1 AS BIGINT) AS alternatives, coalesce(ranked, false) AS ranked FROM (SELECT *, count(*) OVER (PARTITION BY portfolio_id, ticker_id) AS k, row_number() OVER (PARTITION BY portfolio_id, ticker_id ORDER BY bucket, conf, cnt, mask) AS r FROM bs) WHERE r = 1)"""
_BAL = """bal AS (SELECT portfolio_id, ticker_id, CASE WHEN d < l THEN d END AS balanced_on FROM (SELECT portfolio_id, ticker_id, max(execution_date) FILTER (bb = 0) AS d, max(execution_date) AS l FROM (
  SELECT *, sum(q) OVER (PARTITION BY portfolio_id, ticker_id ORDER BY execution_date ROWS UNBOUNDED PRECEDING) AS bb FROM (SELECT portfolio_id, ticker_id, execution_date, sum(CASE WHEN kind = 'BuyExecution' THEN shares ELSE -shares END) AS q FROM v_entries GROUP BY 1, 2, 3)) GROUP BY 1, 2)),
orp AS (SELECT portfolio_id, ticker_id, count(*) AS n, CAST(sum(shares) AS DOUBLE) AS osh, max(execution_date) AS od FROM v_entries o WHERE source = 'orders-screen' AND NOT EXISTS (SELECT 1 FROM v_entries x WHERE x.source IS DISTINCT FROM 'orders-screen' AND (x.portfolio_id, x.ticker_id, x.kind, x.execution_date, x.shares, x.price) = (o.portfolio_id, o.ticker_id, o.kind, o.execution_date, o.shares, o.price)) GROUP BY 1, 2),
cj AS (SELECT tm.*, coalesce(n, 0) AS n, osh, od, balanced_on AS bd, ticker_id % 8 < 3 AS orders, ticker_id % 16 = 4 AS dc, abs(net) >= 1e-6 AS is_open, abs(net - coalesce(units, 0.0)) AS gap, existing + buy + sell AS vol,
  CASE WHEN reason = 'matched' THEN 'Verified' WHEN reason IN ('invoice-verified', 'broker-excel-verified', 'cross-verified', 'orders-verified') THEN 'Complete' WHEN reason = 'no-shares-to-verify' THEN 'Unknown' ELSE 'Incomplete' END AS class
  FROM tm LEFT JOIN orp USING (portfolio_id, ticker_id) LEFT JOIN bal USING (portfolio_id, ticker_id)),
ck AS (SELECT *, CASE WHEN n > 0 THEN 'Broker Statement' WHEN is_open AND reason = 'no-verification' THEN 'My Position' WHEN bd IS NULL OR NOT is_open OR reason = 'mismatch' THEN 'Orders History' ELSE 'Transactions' END AS best,
  CASE WHEN n > 0 THEN 'Invoice' WHEN is_open AND reason = 'no-verification' THEN 'Orders History' ELSE 'Broker Statement' END AS alt FROM cj),
cl AS (SELECT *, best <> 'My Position' AND CASE best WHEN 'Orders History' THEN orders WHEN 'Broker Statement' THEN n > 0 AND dc WHEN 'Transactions' THEN n > 0 AND dc ELSE false END AS swap, CASE WHEN alt = 'Broker Statement' AND n > 0 AND dc THEN 'Invoice' ELSE alt END AS nxt FROM ck)"""
_BUY = "sum(CASE WHEN kind = 'BuyExecution' THEN shares ELSE -shares END)"

_VERDICT = "CASE WHEN u AND NOT c THEN 'Rejected' WHEN t IS NOT NULL AND NOT (o OR ag OR od) THEN 'Rejected' WHEN matched AND t IS NULL THEN 'Verified' ELSE 'Needs Review' END"
_VD = f"vd AS (SELECT e.*, tm.reason, {_VERDICT} AS verdict, CASE WHEN l_linenumber <> 2 THEN l_orderkey END AS up FROM e JOIN tm USING (portfolio_id, ticker_id))"
_RES = """rs AS (SELECT *, CASE WHEN l_linenumber < 6 THEN 't' WHEN l_linenumber = 6 THEN 'd' ELSE 'v' END AS what FROM e),
rg AS (SELECT portfolio_id, ticker_id, count(*) FILTER (what = 't') AS n, bool_and(l_orderkey % 23 <> 0 AND l_orderkey % 29 <> 0) AS done, bool_or(l_orderkey % 31 = 0 AND kind = 'SellExecution') AS un FROM rs GROUP BY 1, 2),
rd AS (SELECT portfolio_id, ticker_id, coalesce(matched, false) AND n > 0 AND done AND NOT un AS resolved FROM rg LEFT JOIN tm USING (portfolio_id, ticker_id))"""
_UP = """ups AS (SELECT portfolio_id, l_orderkey AS up, CASE l_orderkey % 12 WHEN 3 THEN 'orders-timeline' WHEN 5 THEN 'position-verification' ELSE coalesce(source, '~') END AS source, ticker_id, CASE WHEN l_linenumber <> 7 THEN execution_date END AS d, concat_ws('|', id, ticker_id, execution_date) AS o FROM v_entries),
cc AS (SELECT portfolio_id, up, source, arg_min(ticker_id, o) AS ticker_id, arg_min(d, o) AS f, arg_min(d, o) AS l FROM ups WHERE source IN ('invoice', 'position-verification') AND d IS NOT NULL GROUP BY 1, 2, 3
  UNION ALL SELECT portfolio_id, up, source, arg_min(ticker_id, o), min(d), max(d) FROM ups WHERE source = 'orders-screen' GROUP BY 1, 2, 3
  UNION ALL SELECT portfolio_id, up, source, ticker_id, min(d), max(d) FROM ups WHERE source = 'official-broker-excel' AND d IS NOT NULL GROUP BY 1, 2, 3, 4
  UNION ALL SELECT portfolio_id, up, source, NULL, min(d), max(d) FROM ups WHERE source IN ('orders-timeline', 'statement', 'csv') AND d IS NOT NULL GROUP BY 1, 2, 3)"""
_CANON = f"""cn AS (SELECT {_C}, price, CASE WHEN bool_or(nullif(minutes, 0) IS NULL) OVER (PARTITION BY {_C}, price) THEN NULL ELSE minutes END AS cluster, id, source, verdict, l_linenumber,
  CASE coalesce(source, '~') WHEN 'invoice' THEN 6 WHEN 'official-broker-excel' THEN 5 WHEN 'statement' THEN 4 WHEN 'orders-screen' THEN 3 WHEN 'csv' THEN 1 END AS rk FROM vd),
ct AS (SELECT {_C}, price, cluster, count(*) AS n, min(id) AS first_id, CASE WHEN bool_or(verdict = 'Verified') THEN 'Verified' WHEN bool_or(verdict = 'Needs Review') THEN 'Needs Review' ELSE 'Rejected' END AS status FROM cn GROUP BY ALL)"""

_DONOR = lambda c: f"arg_min(b.{c}, (b.source <> 'invoice', b.id)) FILTER (b.{c} IS NOT NULL)"
ORACLES = {
    "completed_rows": with_(ENTRIES).rstrip() + f""", q AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber * 1.5::DOUBLE END AS fees, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 0.5::DOUBLE END AS taxes FROM v_entries WHERE source IS NOT NULL),
p AS (SELECT a.rid, {_DONOR('fees')} AS ff, {_DONOR('taxes')} AS ft, {_DONOR('minutes')} AS fm, {_DONOR('number')} AS fn FROM q a JOIN q b ON {_ON} WHERE a.source <> b.source AND {_SAME} GROUP BY 1),
r AS (SELECT q.*, p.rid AS donor, ff, ft, fm, fn FROM q LEFT JOIN p ON p.rid = q.rid)
SELECT portfolio_id, source, CASE WHEN donor IS NOT NULL THEN 'high' ELSE confidence END AS confidence, count(*) AS n, CAST(sum(CASE WHEN fees IS NULL AND ff IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN taxes IS NULL AND ft IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN minutes IS NULL AND fm IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN number IS NULL AND fn IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_filled,
  CAST(sum(coalesce(fees, ff) * 2) AS BIGINT) AS fees, CAST(sum(coalesce(taxes, ft) * 2) AS BIGINT) AS taxes, count(coalesce(minutes, fm)) AS n_minutes, CAST(sum(CAST(coalesce(number, fn) AS BIGINT)) AS BIGINT) AS numbers FROM r GROUP BY 1, 2, 3""",
    "inventory_diagnosis": _T.rstrip() + ",\n" + _SUB + ",\n" + _BAL + """,
sn AS (SELECT portfolio_id, ticker_id, count(t) AS nw, count(*) FILTER (l_orderkey % 17 = 0) AS nm FROM e GROUP BY 1, 2)
SELECT portfolio_id, ticker_id, units AS expected, net AS calculated, net - units AS difference, coalesce(nullif(concat_ws(',', CASE WHEN sg.alternatives = 0 THEN 'duplicate-row:high' WHEN sg.alternatives > 0 THEN 'duplicate-row:medium' END, CASE WHEN orp.n > 0 THEN 'missing-import:medium' END, CASE WHEN nw > 0 THEN 'wrong-ticker:medium' END,
  CASE WHEN nm > 0 THEN 'misread-date:medium' END, CASE WHEN balanced_on IS NOT NULL THEN 'after-balance:high' END), ''), CASE side WHEN 'sell' THEN 'missing-buy:low' WHEN 'buy' THEN 'extra-buy:low' ELSE '' END) AS hypotheses
FROM tm LEFT JOIN sg USING (portfolio_id, ticker_id) LEFT JOIN orp USING (portfolio_id, ticker_id) LEFT JOIN sn USING (portfolio_id, ticker_id) LEFT JOIN bal USING (portfolio_id, ticker_id) WHERE abs(net) >= 1e-6 AND reason <> 'broker-excel-verified' AND abs(net - units) >= 1e-6""",
    "coverage_claims": with_(ENTRIES, _UP) + """SELECT portfolio_id, up AS upload_id, CASE WHEN source = 'invoice' THEN 'invoice' WHEN source = 'position-verification' THEN 'my-position' WHEN source IN ('orders-screen', 'official-broker-excel') THEN 'orders' WHEN source = 'orders-timeline' THEN 'transactions' ELSE 'statement' END AS document,
  CASE WHEN source = 'invoice' THEN 'exact-execution' WHEN source = 'position-verification' THEN 'current-holdings' WHEN source IN ('orders-screen', 'official-broker-excel') THEN 'ticker-history' ELSE 'date-range' END AS claim, ticker_id, f AS first_day, l AS last_day FROM cc""",
    "covered_days": with_(ENTRIES, _UP) + """SELECT portfolio_id, ticker_id, day, EXISTS (SELECT 1 FROM cc WHERE cc.portfolio_id = p.portfolio_id AND source IN ('orders-timeline', 'statement', 'csv') AND up % 40 = 4 AND day BETWEEN f AND l) AS covered
FROM (SELECT DISTINCT portfolio_id, ticker_id, CAST(execution_date + INTERVAL 3 MONTH AS DATE) AS day FROM v_entries) p""",
    "evidence_lists": _T.rstrip() + ",\n" + _VD + """ SELECT vd.id, vd.portfolio_id, vd.ticker_id, verdict, concat_ws(',', CASE WHEN u AND NOT c THEN 'matched-ledger' END, CASE WHEN dn.source IS NOT NULL THEN concat('matched-', dn.source, '=', oid) END, CASE WHEN ag THEN 'matched-statement-aggregate' END, CASE WHEN od THEN 'matched-order' END,
  CASE WHEN tm.matched THEN concat('matched-position=', tm.reason) ELSE concat('contradicted-position-mismatch=', tm.reason) END, CASE WHEN t IS NOT NULL THEN concat('contradicted-wrong-ticker=', t) END) AS evidence
FROM vd JOIN tm USING (portfolio_id, ticker_id) LEFT JOIN v_entries dn ON dn.id = oid""",
    "evidence_edges": _T.rstrip() + ",\n" + _VD + ",\n" + _BAL + """,
ed AS (SELECT portfolio_id, 'sourced-from' AS edge, concat('row:', id) AS src, concat('document:', up) AS dst FROM vd WHERE up IS NOT NULL UNION ALL SELECT portfolio_id, 'corroborates', concat('row:', id), concat('row:', oid) FROM vd WHERE oid IS NOT NULL
  UNION ALL SELECT portfolio_id, 'reconciles-against', concat('row:', id), concat('ticker:', portfolio_id, ':', ticker_id) FROM vd UNION ALL SELECT portfolio_id, 'missing', concat('ticker:', portfolio_id, ':', ticker_id), concat('ticker:', portfolio_id, ':', ticker_id) FROM (SELECT *, unnest(range(n)) FROM orp))
SELECT portfolio_id, edge, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM ed GROUP BY 1, 2""",
    "evidence_nodes": _T.rstrip() + ",\n" + _VD + " SELECT portfolio_id, 'transaction' AS kind, verdict AS label, count(*) AS n FROM vd GROUP BY 1, 3 UNION ALL SELECT portfolio_id, 'document', NULL, count(DISTINCT up) FROM vd GROUP BY 1 UNION ALL SELECT portfolio_id, 'ticker-position', reason, count(*) FROM tm GROUP BY 1, 3",
    "canonical_transactions": _T.rstrip() + ",\n" + _VD + ",\n" + _CANON + """
SELECT ct.*, f.source AS best_source, f.l_linenumber * 1.5::DOUBLE AS fees, CASE WHEN f.l_linenumber % 2 = 0 THEN f.l_linenumber * 0.5::DOUBLE END AS taxes
FROM ct JOIN (SELECT * FROM cn QUALIFY row_number() OVER (PARTITION BY """ + _C + """, price, cluster ORDER BY rk DESC, id) = 1) f ON ct.portfolio_id = f.portfolio_id AND ct.ticker_id = f.ticker_id AND ct.kind = f.kind AND ct.execution_date = f.execution_date AND ct.shares = f.shares AND ct.price = f.price AND ct.cluster IS NOT DISTINCT FROM f.cluster""",
    "placeholder_lots": _T + """SELECT portfolio_id, ticker_id, 'a,b' AS lots FROM tm WHERE existing = units AND existing > 0 AND ticker_id % 2 = 0""",
    "ticker_split": _T.rstrip() + ",\n" + _RES + " SELECT portfolio_id, count(*) FILTER (NOT coalesce(resolved, false)) AS n_active, count(*) FILTER (resolved) AS n_completed, count(*) FILTER (NOT coalesce(resolved, false) AND matched) AS n_matched, count(*) FILTER (NOT coalesce(resolved, false) AND NOT matched) AS n_unmatched FROM tm LEFT JOIN rd USING (portfolio_id, ticker_id) GROUP BY 1",
    "corroborated_rows": _E + "SELECT portfolio_id, coalesce(source, '~') AS source, count(*) FILTER (c) AS n_cross_verified, count(*) FILTER (o) AS n_other_document, count(*) FILTER (u) AS n_duplicate, count(t) AS n_other_ticker, CAST(sum(t) AS BIGINT) AS other_tickers, count(*) AS n FROM e GROUP BY 1, 2",
    "ticker_match_status": _T + "SELECT * FROM tm",
    "session_ticker_status": with_(ENTRIES, _FLAGS, _match(True)) + "SELECT * FROM tm",
    "verdict_histogram": _T.rstrip() + ",\n" + _VD + " SELECT portfolio_id, verdict, count(*) AS n FROM vd GROUP BY 1, 2",
    "commit_gate": _T.rstrip() + ",\n" + _VD + """, ak AS (SELECT portfolio_id, ticker_id FROM v_entries UNION SELECT p_partkey % 8, p_partkey FROM part)
SELECT portfolio_id, ticker_id, EXISTS (SELECT 1 FROM vd x WHERE x.portfolio_id = ak.portfolio_id AND x.ticker_id = ak.ticker_id) AND NOT EXISTS (SELECT 1 FROM vd x WHERE x.portfolio_id = ak.portfolio_id AND x.ticker_id = ak.ticker_id AND verdict = 'Needs Review') AS commit FROM ak""",
    "resolved_tickers": _T.rstrip() + ",\n" + _RES + " SELECT * FROM rd",
    "completeness": _T.rstrip() + ",\n" + _BAL + """
SELECT portfolio_id, ticker_id, class, CAST(CASE class WHEN 'Verified' THEN 100 WHEN 'Complete' THEN 90 WHEN 'Unknown' THEN 0 ELSE greatest(0, floor((CASE WHEN n > 0 THEN 60 ELSE 85 END) * (1 - CASE WHEN vol > 0 THEN least(1.0, gap / vol) ELSE 1.0 END) + 0.5)) END AS INTEGER) AS score,
  CASE WHEN class = 'Incomplete' THEN bd END AS gap_from, CASE WHEN class = 'Incomplete' AND bd IS NOT NULL THEN od END AS gap_to, CAST(CASE WHEN class = 'Incomplete' THEN CASE WHEN n > 0 THEN n WHEN units IS NOT NULL THEN 1 END END AS BIGINT) AS missing_transactions,
  CASE WHEN class = 'Incomplete' THEN CASE WHEN n > 0 THEN nullif(osh, 0) WHEN units IS NOT NULL THEN gap END END AS missing_shares, CASE WHEN class = 'Incomplete' THEN CASE WHEN swap THEN nxt ELSE best END END AS ask_for,
  CASE WHEN class = 'Incomplete' THEN CASE WHEN swap THEN CASE WHEN nxt <> 'Invoice' THEN 'Invoice' END ELSE alt END END AS or_for, CAST(CASE WHEN class = 'Incomplete' THEN CASE WHEN n > 0 THEN 90 WHEN bd IS NOT NULL THEN 60 ELSE 25 END END AS INTEGER) AS confidence FROM cl""",
    "reconciled_positions": with_(ENTRIES) + f"""SELECT portfolio_id, ticker_id, shares, units, NOT stale AND shares > units AND shares >= -1e-6 AND abs(shares - units) >= 1e-6 AS mismatch, NOT stale AND ((shares < units AND abs(shares - units) >= 1e-6) OR shares < -1e-6) AS shortfall, stale
FROM (SELECT portfolio_id, ticker_id, CAST({_BUY} AS DOUBLE) AS shares, any_value(units) AS units, max(execution_date) > any_value(CAST(DATE '1997-01-01' + to_months(CAST(ticker_id % 60 AS INTEGER)) AS DATE)) AS stale
  FROM v_entries JOIN v_units USING (portfolio_id, ticker_id) GROUP BY 1, 2 HAVING NOT bool_and(coalesce(source, '~') = 'official-broker-excel'))""",
    "merge_suggestions": with_(ENTRIES).rstrip() + """, g AS (SELECT portfolio_id, ticker_id, count(*) AS n, list_sort(list(concat_ws('|', kind, execution_date))) AS l, ticker_id % 5 <> 0 AS low FROM v_entries GROUP BY 1, 2)
SELECT a.portfolio_id, a.ticker_id, arg_min(b.ticker_id, (b.low, b.ticker_id)) AS merge_into, any_value(a.n) AS n FROM g a JOIN g b ON a.portfolio_id = b.portfolio_id AND a.l = b.l AND a.ticker_id <> b.ticker_id WHERE a.low GROUP BY 1, 2""",
    "mismatch_suggestions": _T.rstrip() + ",\n" + _SUB + "\nSELECT portfolio_id, ticker_id, true AS searched, remove, alternatives, ranked FROM sg UNION ALL SELECT DISTINCT portfolio_id, ticker_id, n <= 16, NULL, NULL, NULL FROM rw WHERE (portfolio_id, ticker_id) NOT IN (SELECT (portfolio_id, ticker_id) FROM sg)",
    "root_causes": _T.rstrip() + ",\n" + _SUB + """
SELECT CASE WHEN reason = 'mismatch' THEN CASE WHEN already_recorded THEN 'MM-1' WHEN remove IS NOT NULL THEN 'MM-2' ELSE 'MM-3' END WHEN side = 'sell' THEN 'NV-1' WHEN buy < 1e-6 THEN 'NV-2' ELSE 'NV-3' END AS cause, count(*) AS n
FROM tm LEFT JOIN sg USING (portfolio_id, ticker_id) WHERE NOT matched GROUP BY 1""",
}
ORACLES["evidence_intelligence"] = (
    _T.rstrip() + ",\n" + _VD + ",\n" + _CANON + f"""
SELECT portfolio_id, ticker_id, nc AS n_confirmed, nr AS n_review, nj AS n_rejected, br AS best_rank, k.class, k.score, k.ask_for
FROM (SELECT portfolio_id, ticker_id, count(*) FILTER (status = 'Verified') AS nc, count(*) FILTER (status = 'Needs Review') AS nr, count(*) FILTER (status = 'Rejected') AS nj FROM ct GROUP BY 1, 2)
JOIN (SELECT portfolio_id, ticker_id, CAST(max(rk) AS INTEGER) AS br FROM cn GROUP BY 1, 2) USING (portfolio_id, ticker_id) JOIN ({ORACLES["completeness"]}) k USING (portfolio_id, ticker_id)"""
)
