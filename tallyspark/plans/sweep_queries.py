"""Sweep queries over the adapters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sweep as W
from ..sources import adapters as S
from .ledger_queries import _id
from .oracle import DENSE, ENTRIES, FACTS, with_

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _invoices(s, d):
    f = S.dense_facts(s, d).withColumn("id", _id())
    keys = ["portfolio_id", "ticker_id", "kind", "execution_date"]
    return W.unique_invoice_matches(f.filter("source = 'csv'").select("id", *keys), f.filter("source = 'invoice'").select("id", *keys), keys)


def _twins(s, d):
    """Entries without line numbers in their prices, at two times or none; one order in ten is retracted."""
    e = S.entries(s, d).withColumn("price", F.floor(F.col("price") / 500) * 500.0).withColumn("source", F.coalesce("source", F.lit("manual")))
    return e.withColumn("minutes", F.when(F.col("l_linenumber") % 3 == 0, 600).when(F.col("l_linenumber") % 3 == 1, 660)).withColumn("retracted", F.col("l_orderkey") % 10 == 8)


def _session(s, d):
    """Later order numbers are a session's candidates, earlier ones facts."""
    t = _twins(s, d)
    return W.session_coverage(t.filter("l_orderkey % 2 = 0"), t.filter("l_orderkey % 2 = 1"), S.existing_shares(s, d))


QUERIES = {
    "completed_fields": lambda s, d: W.completed_fields(S.dense_facts(s, d), _ORDER).select("portfolio_id", "ticker_id", *_ORDER[:4], "source", "filled"),
    "official_coverage": lambda s, d: W.official_coverage(_twins(s, d)),
    "session_coverage": _session,
    "unique_invoice_matches": _invoices,
    "sweep_report": lambda s, d: W.sweep_report(S.dense_facts(s, d)),
    "closed_positions": lambda s, d: W.closed_positions(S.facts(s, d)),
}

_C = "portfolio_id, ticker_id, kind, execution_date, shares"
_D = with_(DENSE)
_TW = with_(ENTRIES).rstrip() + """, tw AS (SELECT portfolio_id, ticker_id, l_orderkey, coalesce(source, 'manual') AS source, concat_ws('|', portfolio_id, ticker_id, kind, execution_date, shares, floor(price / 500) * 500) AS k, CASE l_linenumber % 3 WHEN 0 THEN 600 WHEN 1 THEN 660 END AS t, l_orderkey % 10 = 8 AS gone,
  CASE coalesce(source, 'manual') WHEN 'invoice' THEN 6 WHEN 'official-broker-excel' THEN 5 WHEN 'statement' THEN 4 WHEN 'orders-screen' THEN 3 WHEN 'csv' THEN 1 ELSE 0 END AS rank FROM v_entries)
"""
ORACLES = {
    "completed_fields": _D + f"""SELECT portfolio_id, ticker_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, source, filled FROM (
  SELECT u.*, d.minutes AS filled, row_number() OVER (PARTITION BY u.rid ORDER BY CASE WHEN d.source = 'invoice' THEN 0 ELSE 1 END, d.l_orderkey, d.l_linenumber, d.l_partkey, d.l_suppkey, d.l_extendedprice, d.minutes) AS r
  FROM (SELECT *, row_number() OVER () AS rid FROM v_facts WHERE nullif(minutes, 0) IS NULL) u JOIN v_facts d USING ({_C}) WHERE nullif(d.minutes, 0) IS NOT NULL AND d.source <> u.source) WHERE r = 1""",
    "official_coverage": _TW + """SELECT portfolio_id, ticker_id, bool_and(rank >= 5 OR sh OR cv) AS fully_official, count(*) FILTER (rank >= 5) AS n_official, count(*) FILTER (rank < 5 AND sh) AS n_shadowed, count(*) FILTER (rank < 5 AND NOT sh AND cv) AS n_covered, count(*) AS n FROM (
  SELECT *, EXISTS (SELECT 1 FROM tw b WHERE NOT b.gone AND b.k = a.k AND b.rank > a.rank AND a.t IS NOT NULL AND b.t = a.t) AS sh, EXISTS (SELECT 1 FROM tw b WHERE b.gone AND b.k = a.k AND b.rank > a.rank AND coalesce(a.t = b.t, true)) AS cv FROM tw a WHERE NOT gone) GROUP BY 1, 2""",
    "session_coverage": _TW + """, o AS (SELECT * FROM tw WHERE l_orderkey % 2 = 1 AND source = 'official-broker-excel'), l AS (SELECT *, EXISTS (SELECT 1 FROM o WHERE o.k = x.k AND coalesce(o.t = x.t, true)) AS met FROM tw x WHERE l_orderkey % 2 = 0 AND NOT gone)
SELECT portfolio_id, ticker_id, coalesce(a, abs(existing) < 1e-6, false) AS covered FROM (SELECT DISTINCT portfolio_id, ticker_id FROM o) LEFT JOIN (SELECT portfolio_id, ticker_id, bool_and(met AND rank < 5) AS a FROM l GROUP BY 1, 2) USING (portfolio_id, ticker_id) LEFT JOIN v_existing USING (portfolio_id, ticker_id)""",
    "unique_invoice_matches": _D.rstrip() + """, f AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM v_facts)
SELECT p.id, i.invoice_id FROM f p JOIN (SELECT portfolio_id, ticker_id, kind, execution_date, min(id) AS invoice_id FROM f WHERE source = 'invoice' GROUP BY 1, 2, 3, 4 HAVING count(*) = 1) i USING (portfolio_id, ticker_id, kind, execution_date) WHERE p.source = 'csv'""",
    "sweep_report": _D + f"""SELECT portfolio_id, count(DISTINCT ticker_id) AS n_tickers, count(*) AS n_facts, CAST(any_value(ng) AS BIGINT) AS n_groups, count(*) FILTER (rank < top) AS n_superseded
FROM (SELECT *, max(rank) OVER (PARTITION BY {_C}) AS top FROM v_facts) LEFT JOIN (SELECT portfolio_id, count(*) AS ng FROM (SELECT {_C} FROM v_facts GROUP BY ALL HAVING count(*) > 1) GROUP BY 1) USING (portfolio_id) GROUP BY 1""",
    "closed_positions": with_(FACTS) + """SELECT portfolio_id, ticker_id, CAST(net AS BIGINT) AS net, net = 0 OR (official AND net <= 0) AS closed FROM (
  SELECT portfolio_id, ticker_id, sum(CASE WHEN kind = 'BuyExecution' THEN shares ELSE -shares END) AS net, bool_and(source = 'official-broker-excel') AS official FROM v_facts GROUP BY 1, 2)""",
}
