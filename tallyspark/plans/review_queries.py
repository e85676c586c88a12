"""Review queries over the adapters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import half_up
from ..operators import ledger as L
from ..operators import review as V
from ..sources import adapters as S
from .ledger_queries import _M, _id, _timeline
from .oracle import DENSE, FACTS, with_
from .resolve_queries import _V, _verifications

KEYS = ["portfolio_id", "ticker_id", "kind", "execution_date", "shares"]


def _dup_trades(s, d):
    return V.duplicate_trades(S.dense_facts(s, d).withColumn("touched", F.col("l_suppkey") % 4), KEYS, "touched")


def _issues(s, d):
    f = S.facts(s, d).withColumn("key", F.concat_ws("-", F.col("portfolio_id").cast("string"), F.col("ticker_id").cast("string"))).withColumn("id", _id())
    lots = f.filter("kind = 'BuyExecution'").groupBy("key", "id").agg(F.sum("shares").alias("shares"), F.min(F.col("price") - 901).alias("price"), F.min("execution_date").alias("on"))
    sells = f.filter("kind = 'SellExecution'").groupBy("key", "id").agg(F.sum("shares").alias("shares"), F.min("execution_date").alias("on"))
    got = L.fifo_matches(_timeline(s, d), ["portfolio_id", "ticker_id"], _id(), _id()).select("sell_id", "lot_id", F.col("matched").alias("shares"))
    return V.lot_issues(lots, sells, got, "2001-10-15").groupBy("key", "issue").agg(F.count(F.lit(1)).alias("n"))


def _row():
    """An id that stays unique on all tables."""
    return F.concat_ws("-", _id(), half_up(F.col("l_extendedprice") * 100).cast("string"))


def _manager(s, d, table):
    """First-in first-out lines; one in seven is recorded twice, and one in eleven goes to the last lot."""
    f = S.facts(s, d).withColumn("key", F.concat_ws("-", F.col("portfolio_id").cast("string"), F.col("ticker_id").cast("string"))).withColumn("id", _row())
    side = lambda k: f.filter(F.col("kind") == k).select("key", "id", F.col("execution_date").alias("on"), "minutes", "shares", "price", F.lit(1.5).alias("fees"), F.lit(None).cast("double").alias("taxes"))
    lots, sells = side("BuyExecution"), side("SellExecution")
    got = L.fifo_matches(_timeline(s, d), ["portfolio_id", "ticker_id"], _row(), _row()).withColumn("key", F.concat_ws("-", F.col("portfolio_id").cast("string"), F.col("ticker_id").cast("string")))
    last = lots.groupBy("key").agg(F.max_by("id", F.struct("on", "id")).alias("last_id"))
    got = got.join(last, "key").select("sell_id", F.when(F.col("matched") % 11 == 0, F.col("last_id")).otherwise(F.col("lot_id")).alias("lot_id"), F.col("matched").alias("shares"), F.explode(F.when(F.col("matched") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"), F.col("lot_id").alias("was"))
    t = V.lot_manager(lots, sells, got.withColumn("ord", F.concat_ws("|", "was", F.col("n").cast("string"))))[table]
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["id"], x["on"].cast("string"), x["shares"].cast("bigint").cast("string"))), ",").alias(c)
    return t.select(*[listed(c) if c in ("closed_by", "lines") else F.col(c).cast("bigint").alias(c) if c in ("allocated", "remaining", "net", "bought", "available", "pending") else F.col(c) for c in t.columns])


def _rebuild(s, d):
    f = S.dense_facts(s, d)
    return V.rebuild_differences(f.filter("source <> 'manual'"), f.filter("source <> 'csv'"), KEYS)


def _imports(s, d):
    f = S.dense_facts(s, d)
    return V.import_decisions(f.filter("l_suppkey % 2 = 0"), f.filter("l_suppkey % 2 = 1"), ["ticker_id", "kind", "execution_date", "shares"])


def _smart(s, d):
    lots = S.facts(s, d).filter("kind = 'BuyExecution'")
    return V.smart_order(lots, ["portfolio_id", "ticker_id"], S.FACT_ORDER).select("portfolio_id", "ticker_id", "l_orderkey", "l_linenumber", F.col("take_order").cast("int").alias("take_order"))


def _defaults(s, d):
    """Tickers of a part and year, of which many are in one portfolio only; every third is chosen."""
    f = S.facts(s, d).select("portfolio_id", (F.col("l_partkey") * 100 + F.year("execution_date") - 1990).alias("ticker_id"))
    return V.default_portfolios(f, f.filter("ticker_id % 3 = 0").select("ticker_id", (F.col("ticker_id") + 100).alias("choice")).distinct())


QUERIES = {
    "lot_statuses": lambda s, d: _manager(s, d, "lots"),
    "sale_statuses": lambda s, d: _manager(s, d, "sells"),
    "lot_positions": lambda s, d: _manager(s, d, "positions"),
    "lot_timeline": lambda s, d: _manager(s, d, "timeline"),
    "allocation_issues": lambda s, d: _manager(s, d, "issues"),
    "duplicate_trades": _dup_trades,
    "lot_issues": _issues,
    "rebuild_differences": _rebuild,
    "import_decisions": _imports,
    "invalidated_verifications": lambda s, d: V.invalidated_verifications(S.facts(s, d), _verifications(s, d)),
    "default_portfolios": _defaults,
    "pending_confirmations": lambda s, d: V.pending_confirmations(S.facts(s, d).withColumn("pending", F.col("l_partkey") % 3 == 0)),
    "smart_lot_order": _smart,
    "authority_retractions": lambda s, d: V.authority_retractions(S.dense_facts(s, d), KEYS),
    "tracking_window": lambda s, d: V.tracked_counts(S.facts(s, d), ["source"], "execution_date", "1998-01-01", "2000-12-30"),
}

_C = "portfolio_id, ticker_id, kind, execution_date, shares"
_DD = with_(DENSE)
_LM = _M.rstrip().replace("l_suppkey) AS id", "l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS id") + """, lk AS (SELECT *, concat_ws('-', portfolio_id, ticker_id) AS key FROM run), l_ AS (SELECT * FROM lk WHERE kind = 'BuyExecution'), s_ AS (SELECT * FROM lk WHERE kind = 'SellExecution'),
m1 AS (SELECT concat_ws('-', portfolio_id, ticker_id) AS key, lot_id, sell_id, sum(m) AS sh FROM mt WHERE m > 0 GROUP BY ALL), la AS (SELECT key, arg_max(id, (execution_date, id)) AS last_id FROM l_ GROUP BY 1),
al AS (SELECT sell_id, CASE WHEN sh % 11 = 0 THEN last_id ELSE lot_id END AS lot_id, CAST(sh AS BIGINT) AS sh, concat(lot_id, '|', n) AS ord FROM m1 JOIN la USING (key) CROSS JOIN (VALUES (1), (2)) v(n) WHERE n = 1 OR sh % 7 = 0),
ln AS (SELECT al.*, s.key, s.execution_date AS son, l.execution_date AS lon FROM al JOIN s_ s ON s.id = sell_id JOIN l_ l ON l.id = lot_id),
lt AS (SELECT l_.*, coalesce(u, 0) AS u, coalesce(n, 0) AS n, coalesce(c, '') AS c FROM l_ LEFT JOIN (SELECT lot_id AS id, sum(sh) AS u, count(*) AS n, string_agg(concat(sell_id, ':', son, ':', sh), ',' ORDER BY ord, sell_id) AS c FROM ln GROUP BY 1) USING (id)),
st AS (SELECT s_.*, coalesce(u, 0) AS u, coalesce(n, 0) AS n, coalesce(c, '') AS c FROM s_ LEFT JOIN (SELECT sell_id AS id, sum(sh) AS u, count(*) AS n, string_agg(concat(lot_id, ':', lon, ':', sh), ',' ORDER BY ord, lot_id) AS c FROM ln GROUP BY 1) USING (id)),
po AS (SELECT key, CAST(coalesce(b, 0) AS BIGINT) AS bought, CAST(coalesce(av, 0) AS BIGINT) AS available, CAST(coalesce(al, 0) AS BIGINT) AS allocated, CAST(coalesce(pe, 0) AS BIGINT) AS pending FROM (SELECT key, sum(shares) AS b, sum(shares - u) AS av FROM lt GROUP BY 1) FULL JOIN (SELECT key, sum(shares - u) AS pe, sum(u) AS al FROM st GROUP BY 1) USING (key))
"""
ORACLES = {
    "lot_statuses": _LM + """SELECT key, id, execution_date AS "on", shares, price, CAST(floor((price * shares + 1.5::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS cost_micros, CAST(u AS BIGINT) AS allocated, CAST(shares - u AS BIGINT) AS remaining, CASE WHEN shares <= u THEN 'closed' WHEN u > 0 THEN 'partial' ELSE 'open' END AS status, c AS closed_by FROM lt""",
    "sale_statuses": _LM + """SELECT key, id, execution_date AS "on", shares, price, CAST(u AS BIGINT) AS allocated, CAST(shares - u AS BIGINT) AS remaining, CASE WHEN shares <= u THEN 'completed' WHEN u > 0 THEN 'partial' ELSE 'pending' END AS status, c AS lines FROM st""",
    "lot_positions": _LM + "SELECT * FROM po",
    "lot_timeline": _LM + """SELECT key, id, CASE kind WHEN 'BuyExecution' THEN 'BUY' ELSE 'SELL' END AS type, execution_date AS "on", minutes, shares, price, n AS n_lines, CAST(sum(CASE WHEN kind = 'BuyExecution' THEN shares ELSE -shares END) OVER (PARTITION BY key ORDER BY execution_date, coalesce(minutes, 0), kind, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS net FROM (SELECT * FROM lt UNION ALL SELECT * FROM st)""",
    "allocation_issues": _LM + """SELECT key, CAST(NULL AS VARCHAR) AS id, id AS lot_id, 'negative-remaining' AS code FROM lt WHERE u > shares UNION ALL SELECT key, id, NULL, 'over-allocation' FROM st WHERE u > shares UNION ALL SELECT key, id, NULL, 'missing-allocation' FROM st WHERE u < shares AND u = 0
UNION ALL SELECT key, sell_id, lot_id, 'duplicate-allocation' FROM ln GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT key, sell_id, lot_id, 'chronological-violation' FROM ln WHERE lon > son UNION ALL SELECT key, NULL, NULL, 'inventory-mismatch' FROM po WHERE allocated > bought""",
    "duplicate_trades": _DD + f"SELECT {_C}, count(*) AS n, count(*) - greatest(1, count(*) FILTER (l_suppkey % 4 <> 0)) AS n_removable, count(DISTINCT nullif(l_suppkey % 4, 0)) >= 2 AS ambiguous FROM v_facts GROUP BY ALL HAVING count(*) > 1",
    "lot_issues": _M.rstrip() + """, k AS (SELECT *, concat_ws('-', portfolio_id, ticker_id) AS key, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM v_facts),
b AS (SELECT key, id, sum(shares) AS shares, min(price - 901) AS price, min(execution_date) AS o FROM k WHERE kind = 'BuyExecution' GROUP BY 1, 2), s AS (SELECT key, id, sum(shares) AS shares, min(execution_date) AS o FROM k WHERE kind = 'SellExecution' GROUP BY 1, 2),
ul AS (SELECT lot_id AS id, sum(m) AS used FROM mt WHERE m > 0 GROUP BY 1), us AS (SELECT sell_id AS id, sum(m) AS used FROM mt WHERE m > 0 GROUP BY 1), fl AS (SELECT key, min(o) AS f FROM b GROUP BY 1),
bb AS (SELECT b.*, coalesce(used, 0) AS used FROM b LEFT JOIN ul USING (id)), ss AS (SELECT s.*, coalesce(used, 0) AS used, f FROM s LEFT JOIN us USING (id) LEFT JOIN fl USING (key)),
i AS (SELECT key, 'over-allocated' AS issue FROM bb WHERE used > shares UNION ALL SELECT key, 'future-lot' FROM bb WHERE o > DATE '2001-10-15' UNION ALL SELECT key, 'no-cost' FROM bb WHERE price <= 0
  UNION ALL SELECT key, 'unallocated' FROM ss WHERE used = 0 UNION ALL SELECT key, 'partly-allocated' FROM ss WHERE used > 0 AND used < shares UNION ALL SELECT key, 'before-any-lot' FROM ss WHERE f IS NULL OR o < f)
SELECT key, issue, count(*) AS n FROM i GROUP BY 1, 2""",
    "rebuild_differences": _DD + f"""SELECT {_C}, greatest(0, coalesce(a, 0) - coalesce(b, 0)) AS to_add, greatest(0, coalesce(b, 0) - coalesce(a, 0)) AS to_remove
FROM (SELECT {_C}, count(*) AS a FROM v_facts WHERE source <> 'manual' GROUP BY ALL) FULL JOIN (SELECT {_C}, count(*) AS b FROM v_facts WHERE source <> 'csv' GROUP BY ALL) USING ({_C}) WHERE coalesce(a, 0) <> coalesce(b, 0)""",
    "import_decisions": _DD + """SELECT source, CASE WHEN live IS NULL THEN 'new' WHEN rank > live THEN 'upgrade' ELSE 'skip' END AS decision, count(*) AS n
FROM (SELECT * FROM v_facts WHERE l_suppkey % 2 = 0) LEFT JOIN (SELECT ticker_id, kind, execution_date, shares, max(rank) AS live FROM v_facts WHERE l_suppkey % 2 = 1 GROUP BY ALL) USING (ticker_id, kind, execution_date, shares) GROUP BY 1, 2""",
    "invalidated_verifications": with_(FACTS, _V) + """SELECT portfolio_id, ticker_id, units, captured_on, CAST(net AS BIGINT) AS net FROM (
  SELECT portfolio_id, ticker_id, units, captured_on, sum(CASE WHEN execution_date <= captured_on THEN CASE WHEN kind = 'BuyExecution' THEN shares ELSE -shares END ELSE 0 END) AS net FROM vv JOIN v_facts USING (portfolio_id, ticker_id) GROUP BY ALL) WHERE net <> units""",
    "default_portfolios": with_(FACTS) + """SELECT ticker_id, CASE WHEN ticker_id % 3 = 0 THEN ticker_id + 100 WHEN n = 1 THEN only_one END AS portfolio_id
FROM (SELECT l_partkey * 100 + year(execution_date) - 1990 AS ticker_id, count(DISTINCT portfolio_id) AS n, min(portfolio_id) AS only_one FROM v_facts GROUP BY 1)""",
    "pending_confirmations": with_(FACTS) + """SELECT portfolio_id, ticker_id, what, count(*) AS n, CAST(sum(shares) AS BIGINT) AS shares FROM (
  SELECT portfolio_id, ticker_id, 'buy' AS what, shares FROM v_facts WHERE l_partkey % 3 = 0 AND kind = 'BuyExecution'
  UNION ALL SELECT portfolio_id, ticker_id, 'sell', sum(shares) FROM v_facts WHERE l_partkey % 3 = 0 AND kind = 'SellExecution' GROUP BY portfolio_id, ticker_id, l_orderkey) GROUP BY 1, 2, 3""",
    "smart_lot_order": with_(FACTS) + """SELECT portfolio_id, ticker_id, l_orderkey, l_linenumber, CAST(r AS INTEGER) AS take_order FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, ticker_id
  ORDER BY execution_date, CASE WHEN minutes IS NULL THEN 1 ELSE 0 END, coalesce(minutes, 0), l_orderkey, l_linenumber, l_partkey, l_suppkey, shares, l_extendedprice) AS r FROM v_facts WHERE kind = 'BuyExecution')""",
    "authority_retractions": _DD + f"SELECT source, count(*) AS n_retracted FROM v_facts JOIN (SELECT {_C}, max(rank) AS top FROM v_facts GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT nullif(minutes, 0)) <= 1) USING ({_C}) WHERE rank < top GROUP BY 1",
    "tracking_window": with_(FACTS) + "SELECT source, count(*) FILTER (execution_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31') AS n_inside, count(*) FILTER (execution_date NOT BETWEEN DATE '1998-01-01' AND DATE '2000-12-31') AS n_outside FROM v_facts GROUP BY 1",
}
