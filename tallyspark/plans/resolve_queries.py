"""Entity-resolution queries over the adapters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import resolve as R
from ..operators import verification as V
from ..sources import adapters as S
from .ledger_queries import _M
from .oracle import CASH, DENSE, ENTRIES, FACTS, with_

_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _id():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in _ID])


def _verifications(s, d):
    """Each order is a count of its customer's ticker, by its date; some are of one day."""
    o = S.table(s, d, "orders")
    return R.latest_verifications(o.select((F.col("o_custkey") % 10).alias("portfolio_id"), (F.col("o_custkey") % 40).alias("ticker_id"), F.floor(F.col("o_totalprice") / 100).cast("bigint").alias("units"), F.trunc("o_orderdate", "month").alias("captured_on"), F.col("o_orderkey").alias("ord")))


def _dense(s, d):
    """Dense facts as entries: every third line has a transaction number, one in five alike."""
    return S.dense_facts(s, d).withColumn("id", _id()).withColumn("number", F.when(F.col("l_linenumber") % 3 == 0, (F.col("l_orderkey") % 5).cast("string")))


def _matches(s, d):
    f = S.dense_facts(s, d).select("portfolio_id", "ticker_id", "kind", "execution_date", "shares", "price", "minutes", _id().alias("id"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_orderkey")).alias("number"), "source")
    low, high = f.filter("source IN ('csv', 'manual', 'orders-screen')"), f.filter("source IN ('invoice', 'official-broker-excel', 'statement')")
    best = high.groupBy("id").agg(*[F.min(c).alias(c) for c in (*R.CONTENT, "price", "minutes", "number")])
    own = low.groupBy("id").agg(*[F.min(c).alias(c) for c in (*R.CONTENT, "price", "minutes", "number")])
    return R.duplicate_matches(own, best, R.CONTENT)


def _order_hints(s, d):
    e = S.entries(s, d)
    orders = e.filter("source = 'orders-screen'").select("portfolio_id", "ticker_id", "kind", "shares", "price", "minutes", F.when(F.col("l_linenumber") % 2 == 0, F.col("execution_date")).alias("day"), (F.col("shares") * F.col("price")).alias("total"))
    return R.order_ticker_hints(e.filter("source = 'csv'"), orders).groupBy("suggested_ticker").agg(F.count(F.lit(1)).alias("n"))


def _compare(s, d):
    t = L.fifo_timeline(S.facts(s, d), ["portfolio_id", "ticker_id"], S.FACT_ORDER)
    fifo = L.fifo_open_lots(t, ["portfolio_id", "ticker_id"], []).groupBy("portfolio_id", "ticker_id").agg(F.sum("remaining").cast("double").alias("shares"), F.lit(0).cast("bigint").alias("cost_micros"))
    net = S.facts(s, d).groupBy("portfolio_id", "ticker_id").agg(F.sum(F.when(F.col("kind") == "BuyExecution", F.col("shares")).otherwise(-F.col("shares"))).cast("double").alias("shares"), F.lit(0).cast("bigint").alias("cost_micros")).filter("ticker_id % 7 <> 0")
    return R.compare_positions(fifo, net, ["portfolio_id", "ticker_id"])


QUERIES = {
    "duplicate_groups": lambda s, d: R.duplicate_groups(S.dense_facts(s, d)),
    "duplicate_survivors": lambda s, d: V.with_duplicates(_dense(s, d), ["id", "shares"]).filter("duplicate").select(*R.CONTENT, *_ID, "source", "number"),
    "duplicate_matches": _matches,
    "cross_source_verified": lambda s, d: V.with_corroboration(_dense(s, d)).groupBy(*R.CONTENT).agg(F.count_if("cross_verified").alias("n_verified"), F.count_distinct("source").alias("n_sources"), F.min("other_id").alias("first_other")).filter("n_verified > 0"),
    "authority_winner": lambda s, d: R.authority_winner(S.dense_facts(s, d)),
    "official_suppression": lambda s, d: R.official_suppression(S.dense_facts(s, d)).groupBy("portfolio_id", "ticker_id", "source").agg(F.count(F.lit(1)).alias("n")),
    "time_clusters": lambda s, d: R.time_clusters(S.dense_facts(s, d)),
    "date_misread_pairs": lambda s, d: R.date_misreads(S.facts(s, d), _id()),
    "wrong_ticker_pairs": lambda s, d: R.wrong_tickers(S.facts(s, d), _id()),
    "order_ticker_hints": _order_hints,
    "duplicate_dividends": lambda s, d: R.duplicate_dividends(S.cash_events(s, d).filter("kind = 'DividendPayment'").withColumn("ticker_id", F.col("portfolio_id") % 8).withColumn("amount", F.floor(F.col("amount") / 5) * 5.0)),
    "latest_verification": _verifications,
    "snapshot_hash": lambda s, d: R.snapshot_hash(S.facts(s, d), ["source", "portfolio_id", "ticker_id", "shares", "execution_date", "minutes"]),
    "position_comparison": _compare,
}

_F, _D = with_(FACTS), with_(DENSE)
_C = "portfolio_id, ticker_id, kind, execution_date, shares"
_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_P4 = "CAST(floor(price * 10000 + 0.5) AS BIGINT)"
_V = """va AS (SELECT o_custkey % 10 AS portfolio_id, o_custkey % 40 AS ticker_id, CAST(floor(o_totalprice / 100) AS BIGINT) AS units, CAST(date_trunc('month', o_orderdate) AS DATE) AS captured_on, o_orderkey AS ord FROM orders),
vv AS (SELECT portfolio_id, ticker_id, units, captured_on FROM va QUALIFY row_number() OVER (PARTITION BY portfolio_id, ticker_id ORDER BY captured_on DESC, ord) = 1)"""
_TIME = "nullif(minutes, 0)"
_READ = f"rd AS (SELECT *, {_KEY} AS id, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_orderkey % 5 AS VARCHAR) END AS number, row_number() OVER () AS r FROM v_facts)"
#: One execution read twice: by number where both have one, else no other time and prices within 2 %.
_SAME = "CASE WHEN a.number IS NOT NULL AND b.number IS NOT NULL THEN a.number = b.number ELSE coalesce(a.minutes = b.minutes, true) AND abs(a.price - b.price) <= greatest(a.price, b.price) * 0.02 END"


def _on(a: str) -> str:
    return ", ".join(f"{a}.{c}" for c in _C.split(", "))


_ONE = "id, min(portfolio_id) AS portfolio_id, min(ticker_id) AS ticker_id, min(kind) AS kind, min(execution_date) AS execution_date, min(shares) AS shares, min(price) AS price, min(minutes) AS minutes, min(CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey END) AS number"

ORACLES = {
    "duplicate_groups": _D + f"SELECT {_C}, count(*) AS n, count(DISTINCT source) AS n_sources, min({_P4}) AS low4, max({_P4}) AS high4 FROM v_facts GROUP BY ALL HAVING count(*) > 1",
    "duplicate_survivors": with_(DENSE, _READ) + f"""SELECT {_on('a')}, a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.source, a.number FROM rd a
JOIN (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY {_C} ORDER BY CASE source WHEN 'invoice' THEN 0 ELSE 1 END, CASE kind WHEN 'BuyExecution' THEN -price ELSE price END, id, shares) = 1) b USING ({_C})
WHERE (a.id, a.shares) <> (b.id, b.shares) AND {_SAME}""",
    "duplicate_matches": _D.rstrip() + f""", f AS (SELECT *, {_KEY} AS id FROM v_facts), a AS (SELECT {_ONE} FROM f WHERE source IN ('csv', 'manual', 'orders-screen') GROUP BY id),
b AS (SELECT {_ONE} FROM f WHERE source IN ('invoice', 'official-broker-excel', 'statement') GROUP BY id),
bn AS (SELECT a.id, min(b.id) AS m FROM a JOIN b ON a.portfolio_id = b.portfolio_id AND a.ticker_id = b.ticker_id AND a.kind = b.kind AND a.number = b.number GROUP BY 1),
j AS (SELECT a.id, b.id AS m, CASE WHEN floor(a.price * 10000 + 0.5) = floor(b.price * 10000 + 0.5) THEN 1 ELSE 2 END AS k, CASE WHEN floor(a.price * 10000 + 0.5) = floor(b.price * 10000 + 0.5) THEN 0 ELSE abs(a.price - b.price) END AS d
  FROM a JOIN b ON a.portfolio_id = b.portfolio_id AND a.ticker_id = b.ticker_id AND a.kind = b.kind AND a.execution_date = b.execution_date AND a.shares = b.shares
  WHERE NOT coalesce(a.number <> b.number, false) AND NOT coalesce(nullif(a.minutes, 0) <> nullif(b.minutes, 0), false)), c AS (SELECT id, m, k FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, d, m) = 1)
SELECT id, coalesce(bn.m, c.m) AS match_id, CAST(CASE WHEN bn.m IS NOT NULL THEN 0 ELSE k END AS INTEGER) AS match_class FROM bn FULL JOIN c USING (id)""",
    "cross_source_verified": with_(DENSE, _READ).rstrip() + f""", k2 AS (SELECT {_C} FROM rd GROUP BY ALL HAVING count(DISTINCT source) >= 2),
vr AS (SELECT DISTINCT a.r FROM rd a JOIN rd b USING ({_C}) SEMI JOIN k2 USING ({_C}) WHERE a.source <> b.source AND {_SAME}),
ot AS (SELECT a.r, min(b.id) AS o FROM rd a JOIN rd b USING ({_C}) WHERE a.source <> b.source AND NOT coalesce({_TIME.replace('minutes', 'a.minutes')} <> {_TIME.replace('minutes', 'b.minutes')}, false) GROUP BY 1)
SELECT {_C}, count(vr.r) AS n_verified, count(DISTINCT source) AS n_sources, min(o) AS first_other FROM rd LEFT JOIN vr ON vr.r = rd.r LEFT JOIN ot ON ot.r = rd.r GROUP BY ALL HAVING count(vr.r) > 0""",
    "authority_winner": _D + f"SELECT {_C}, top_rank, n, n_superseded FROM (SELECT {_C}, max(rank) AS top_rank, count(*) AS n, count(*) - count(*) FILTER (rank = m) AS n_superseded FROM (SELECT *, max(rank) OVER (PARTITION BY {_C}) AS m FROM v_facts) GROUP BY ALL) WHERE n > 1",
    "official_suppression": _D + "SELECT portfolio_id, ticker_id, source, count(*) AS n FROM v_facts f WHERE source <> 'official-broker-excel' AND EXISTS (SELECT 1 FROM v_facts o WHERE o.source = 'official-broker-excel' AND o.portfolio_id = f.portfolio_id AND o.kind = f.kind AND o.ticker_id = f.ticker_id AND o.execution_date = f.execution_date) GROUP BY 1, 2, 3",
    "time_clusters": _D + f"SELECT {_C}, count(*) AS n, CASE WHEN count(*) FILTER ({_TIME} IS NULL) > 0 THEN 1 ELSE count(DISTINCT {_TIME}) END AS n_clusters FROM v_facts GROUP BY ALL HAVING count(*) > 1",
    "date_misread_pairs": _F.rstrip() + f""", f AS (SELECT *, {_KEY} AS id FROM v_facts)
SELECT a.id, arg_min(b.execution_date, b.id) AS other_date, count(*) AS n FROM f a JOIN f b ON a.portfolio_id = b.portfolio_id AND a.ticker_id = b.ticker_id AND a.kind = b.kind AND a.shares = b.shares AND date_trunc('month', a.execution_date) = date_trunc('month', b.execution_date)
WHERE a.source <> 'official-broker-excel' AND (day(a.execution_date) // 10 <> day(b.execution_date) // 10) <> (day(a.execution_date) % 10 <> day(b.execution_date) % 10) AND abs(a.price - b.price) <= greatest(a.price, b.price) * 0.01 GROUP BY 1""",
    "wrong_ticker_pairs": _F.rstrip() + f""", f AS (SELECT *, {_KEY} AS id FROM v_facts)
SELECT a.id, arg_min(b.ticker_id, b.id) AS suggested_ticker FROM f a JOIN f b ON a.portfolio_id = b.portfolio_id AND a.kind = b.kind AND a.shares = b.shares AND a.execution_date = b.execution_date AND a.ticker_id <> b.ticker_id
WHERE a.confidence <> 'high' AND abs(a.price - b.price) <= greatest(a.price, b.price) * 0.10 GROUP BY 1""",
    "order_ticker_hints": with_(ENTRIES).rstrip() + """, o AS (SELECT portfolio_id, ticker_id, kind, shares, price, minutes, CASE WHEN l_linenumber % 2 = 0 THEN execution_date END AS day, shares * price AS total FROM v_entries WHERE source = 'orders-screen'),
m AS (SELECT e.id, e.ticker_id, o.ticker_id AS t FROM v_entries e JOIN o ON e.portfolio_id = o.portfolio_id AND e.kind = o.kind AND NOT coalesce(e.minutes <> o.minutes, false)
  AND CASE WHEN o.day IS NOT NULL THEN o.day = e.execution_date AND abs(o.total - e.shares * e.price) <= greatest(o.total, e.shares * e.price) * 0.05 ELSE o.shares = e.shares AND abs(o.price - e.price) <= greatest(o.price, e.price) * 0.05 END WHERE e.source = 'csv' AND e.confidence <> 'high')
SELECT suggested_ticker, count(*) AS n FROM (SELECT id, min(t) AS suggested_ticker FROM m GROUP BY 1 HAVING NOT bool_or(t = ticker_id) AND min(t) = max(t)) GROUP BY 1""",
    "duplicate_dividends": with_(CASH) + """SELECT seq, first_seq, ticker_id, day, cents FROM (SELECT *, min(seq) OVER (PARTITION BY ticker_id, day, cents) AS first_seq FROM (
  SELECT seq, portfolio_id % 8 AS ticker_id, CAST(ts AS DATE) AS day, CAST(floor(floor(amount / 5) * 5 * 100 + 0.5) AS BIGINT) AS cents FROM v_cash WHERE kind = 'DividendPayment')) WHERE seq <> first_seq""",
    "latest_verification": with_(_V) + "SELECT * FROM vv",
    "snapshot_hash": _F.rstrip() + ", h AS (SELECT kind, sha256(concat_ws('|', source, portfolio_id, ticker_id, shares, execution_date, coalesce(CAST(minutes AS VARCHAR), '~'))) AS h FROM v_facts),\nk AS (SELECT kind AS category, count(*) AS n, sha256(concat_ws(',', " + ", ".join(f"sum(CAST(concat('0x', substr(h, {1 + 8 * i}, 8)) AS BIGINT))" for i in range(8)) + ")) AS digest FROM h GROUP BY 1)\nSELECT * FROM k UNION ALL SELECT '*', CAST(sum(n) AS BIGINT), sha256(string_agg(concat(category, '=', digest), ',' ORDER BY category)) FROM k",
    "position_comparison": _M + """SELECT portfolio_id, ticker_id, CASE WHEN b.shares IS NULL THEN 'only-left' WHEN a.shares IS NULL THEN 'only-right' WHEN abs(a.shares - b.shares) > 1e-6 THEN 'shares-differ' ELSE 'match' END AS result
FROM (SELECT portfolio_id, ticker_id, sum(remaining) AS shares FROM openl WHERE remaining > 0 GROUP BY 1, 2) a
FULL JOIN (SELECT portfolio_id, ticker_id, sum(CASE WHEN kind = 'BuyExecution' THEN shares ELSE -shares END) AS shares FROM v_facts WHERE ticker_id % 7 <> 0 GROUP BY 1, 2) b USING (portfolio_id, ticker_id)""",
}
