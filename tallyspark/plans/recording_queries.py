"""Recording queries over the adapters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import recording as R
from ..sources import adapters as S
from ..sources import sinks as K
from .oracle import ALLOCATIONS, FACTS, LOTS, TRADES, with_

_M = lambda x: f"CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"


def _requests(s, d):
    """One line of every order over its parts' lots, some of them faulty."""
    a = S.allocations(s, d)
    lines = a.filter("line_no < 4").select(F.col("sell_group_id").alias("sell_id"), F.when(F.col("trade_id") % 50 == 0, -F.col("trade_id")).otherwise(F.col("trade_id")).alias("lot_id"), F.when(F.col("trade_id") % 31 == 0, 0.0).otherwise(F.col("shares_closed") * F.when(F.col("trade_id") % 7 == 0, 40).otherwise(1)).alias("shares"))
    lots = A.open_lots(S.trades(s, d), a).select(F.col("trade_id").alias("lot_id"), F.col("remaining_shares").alias("remaining"), F.date_add("execution_date", (F.col("trade_id") % 900).cast("int")).alias("bought_on"))
    sells = a.groupBy(F.col("sell_group_id").alias("sell_id")).agg(F.sum("shares_closed").alias("sold"), F.min("execution_date").alias("sold_on"))
    held = a.filter("line_no = 1").select(F.col("sell_group_id").alias("sell_id"), F.col("trade_id").alias("lot_id"), F.col("shares_closed").alias("shares"))
    return lines, lots, sells, held


def _decisions(s, d):
    lines, lots, sells, held = _requests(s, d)
    faults = R.allocation_faults(lines, lots, sells, held)
    live = sells.filter("sell_id % 3 = 0").select("sell_id", (F.col("sell_id") + 1_000_000).alias("decision_id"))
    return R.allocation_decisions(lines, faults, live, sells.filter("sell_id % 9 = 0").select("sell_id")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("sell_id").alias("sells"), F.sum("target_id").alias("targets"), F.sum(F.size("lines").cast("bigint")).alias("n_lines"))


def _moving(s, d):
    """Every trade asks for a portfolio; of a group the smallest trade's request counts."""
    req = S.trades(s, d).select("trade_id", (F.col("trade_id") % 5).alias("target"))
    return R.moves(S.trades(s, d), S.allocations(s, d), req)


def _ops(s, d):
    e = S.table(s, d, "events")
    kinds = ("set", "dividend", "delete-dividend", "adjust", "deposit", "withdrawal", "split", "rights-issue", "other")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("portfolio_id"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 9 + 1).cast("int")).alias("op"), (F.col("value") - F.when(F.col("event_id") % 19 == 0, 1000).otherwise(0)).alias("amount"), F.date_add(F.lit("2025-12-20").cast("date"), (F.col("event_id") % 40).cast("int")).alias("day"))


def _pending(s, d):
    p = S.table(s, d, "part")
    pending = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.when(F.col("p_partkey") % 5 == 0, "verified").otherwise("needs-confirmation").alias("status"), F.col("p_size").cast("double").alias("shares"), F.col("p_retailprice").alias("price"), F.lit(None).cast("string").alias("number"))
    li = S.table(s, d, "lineitem")
    conf = li.select(F.col("l_partkey").alias("id"), F.struct("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("ord"), F.col("l_quantity").alias("c_shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("c_price"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey").cast("string")).alias("c_number"))
    sold = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 2).alias("sell_group_id"))
    return R.pending_states(pending, conf, sold)


def _corrections(s, d):
    req = S.trades(s, d).select(F.when(F.col("trade_id") % 40 == 0, -F.col("trade_id") - 1).otherwise(F.col("trade_id")).alias("trade_id"), F.date_add(F.lit("1994-12-01").cast("date"), (F.col("trade_id") % 3000).cast("int")).alias("new_date"))
    return R.date_corrections(S.trades(s, d), S.allocations(s, d), req, "1995-01-01", "2002-01-01")


def _projection(s, d):
    keys = ["portfolio_id", "ticker_id", "kind", "execution_date", "shares"]
    f = S.dense_facts(s, d).withColumn("ord", F.struct(*S.FACT_ORDER)).withColumn("id", F.concat_ws("-", *[F.col(c).cast("string") for c in S.FACT_ORDER[:4]]))
    e = f.filter("source <> 'manual'").withColumnRenamed("id", "event_id")
    return R.projection(e, f.filter("source <> 'csv'").withColumnRenamed("id", "trade_id"), keys).groupBy("portfolio_id", "kind", "action").agg(F.count(F.lit(1)).alias("n"), F.max("rank").cast("bigint").alias("deepest"))


def _quarantine(s, d):
    t = S.trades(s, d).select("trade_id", (F.col("shares") * F.when(F.col("trade_id") % 17 == 0, 0).otherwise(1)).alias("shares"), F.when(F.col("trade_id") % 23 != 0, F.col("entry_price")).alias("entry_price"), (F.col("fees") - F.when(F.col("trade_id") % 29 == 0, 100).otherwise(0)).alias("fees"))
    return K.quarantine(t, ["shares", "entry_price"], ["fees"])[1].select("trade_id", "fault")


def _patched(s, d):
    c = S.table(s, d, "customer")
    return K.set_columns(c.select("c_custkey", "c_acctbal", "c_mktsegment"), c.filter("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 8 == 0, -F.col("c_acctbal")).alias("c_acctbal")), "c_custkey")


QUERIES = {
    "buy_effects": lambda s, d: R.buy_effects(S.trades(s, d)).groupBy("portfolio_id", "type", "timestamp").agg(F.count(F.lit(1)).alias("n"), F.sum("cash_micros").alias("cash_micros"), F.min("ticker").alias("first_ticker")),
    "allocation_faults": lambda s, d: R.allocation_faults(*_requests(s, d)).groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.sum("sell_id").alias("sells"), F.sum("lot_id").alias("lots")),
    "allocation_decisions": _decisions,
    "moved_trades": lambda s, d: _moving(s, d)[0],
    "moved_cash": lambda s, d: _moving(s, d)[1],
    "trade_deletions": lambda s, d: R.deletions(A.open_lots(S.trades(s, d), S.allocations(s, d).filter("sell_group_id % 100 = 0")), S.trades(s, d).select((F.col("trade_id") * 2).alias("trade_id"))),
    "renamed_tickers": lambda s, d: R.renamed(S.trades(s, d).select("trade_id", "ticker"), s.createDataFrame([("brand#1", "One.ca"), ("BRAND#2.CA", " "), ("Brand#3", "brand#3"), ("brand#4", "Four")], "old string, new string")).groupBy("ticker", "was_renamed").agg(F.count(F.lit(1)).alias("n")),
    "date_corrections": _corrections,
    "cash_operations": lambda s, d: R.cash_operations(_ops(s, d), s.range(50).select(F.col("id").alias("portfolio_id"), (F.col("id") * 1_000_000).alias("cash_micros")), "2026-01-01")[1],
    "cash_operation_faults": lambda s, d: R.cash_operations(_ops(s, d), s.range(1).select(F.col("id").alias("portfolio_id"), F.lit(0).cast("bigint").alias("cash_micros")), "2026-01-01")[0].groupBy("op", "fault", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("cash_micros").alias("cash_micros")),
    "pending_executions": _pending,
    "projection_actions": _projection,
    "quarantined_trades": _quarantine,
    "patched_columns": _patched,
}

_COST = f"{_M('shares * entry_price')} + {_M('fees')} + {_M('taxes')}"
_REQ = """ln AS (SELECT sell_group_id AS sell_id, CASE WHEN trade_id % 50 = 0 THEN -trade_id ELSE trade_id END AS lot_id, CASE WHEN trade_id % 31 = 0 THEN 0.0 ELSE shares_closed * CASE WHEN trade_id % 7 = 0 THEN 40 ELSE 1 END END AS shares FROM v_allocations WHERE line_no < 4),
lt AS (SELECT trade_id AS lot_id, rem AS remaining, CAST(execution_date + CAST(trade_id % 900 AS INTEGER) AS DATE) AS b FROM lots), se AS (SELECT sell_group_id AS sell_id, sum(shares_closed) AS sold, min(execution_date) AS o FROM v_allocations GROUP BY 1),
hl AS (SELECT sell_group_id AS sell_id, trade_id AS lot_id, sum(shares_closed) AS own FROM v_allocations WHERE line_no = 1 GROUP BY 1, 2),
ft AS (SELECT DISTINCT sell_id, lot_id, CASE WHEN shares <= 0 THEN 'shares must be positive' WHEN times > 1 THEN 'lot named twice' WHEN remaining IS NULL THEN 'no such lot' WHEN b > o THEN 'lot is later than the sale' WHEN shares > remaining + coalesce(own, 0) THEN 'more than the lot has' END AS fault
    FROM (SELECT *, count(*) OVER (PARTITION BY sell_id, lot_id) AS times FROM ln) JOIN se USING (sell_id) LEFT JOIN lt USING (lot_id) LEFT JOIN hl USING (sell_id, lot_id)
  UNION ALL SELECT sell_id, NULL, 'more than the sale closed' FROM (SELECT sell_id, sum(shares) AS q FROM ln GROUP BY 1) JOIN se USING (sell_id) WHERE q > sold),
fa AS (SELECT * FROM ft WHERE fault IS NOT NULL)"""
_L = with_(TRADES, ALLOCATIONS, LOTS, _REQ)
_MOVE = with_(TRADES, ALLOCATIONS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
aa AS (SELECT a.* FROM v_allocations a), li AS (SELECT DISTINCT x.trade_id AS a, y.trade_id AS b FROM aa x JOIN aa y USING (portfolio_id, sell_group_id) WHERE x.trade_id <> y.trade_id),
rc(seed, node) AS (SELECT trade_id, trade_id FROM v_trades UNION SELECT seed, b FROM rc JOIN li ON a = node),
mv AS (SELECT node AS trade_id, t.portfolio_id AS source, min(seed) % 5 AS target FROM rc JOIN v_trades t ON t.trade_id = node GROUP BY 1, 2 HAVING source <> target)"""
_OPS = """op AS (SELECT event_id AS seq, user_id AS portfolio_id, (['set', 'dividend', 'delete-dividend', 'adjust', 'deposit', 'withdrawal', 'split', 'rights-issue', 'other'])[event_id % 9 + 1] AS op, value - CASE WHEN event_id % 19 = 0 THEN 1000 ELSE 0 END AS amount,
  CAST(DATE '2025-12-20' + CAST(event_id % 40 AS INTEGER) AS DATE) AS day FROM events),
oo AS (SELECT *, CASE WHEN op = 'dividend' AND NOT amount > 0 THEN 'dividend must be positive' WHEN op = 'dividend' AND day < DATE '2026-01-01' THEN 'before tracking' WHEN op = 'other' THEN 'unknown operation' END AS fault FROM op),
om AS (SELECT *, CASE WHEN fault IS NULL AND op <> 'set' THEN CAST(floor(amount * 1e6 + 0.5) AS BIGINT) * CASE WHEN op IN ('dividend', 'adjust', 'deposit') THEN 1 WHEN op IN ('delete-dividend', 'withdrawal') THEN -1 ELSE 0 END END AS m FROM oo)"""

ORACLES = {
    "buy_effects": with_(TRADES) + f"SELECT portfolio_id, 'Buy' AS type, '1995-01-01T00:00' AS timestamp, count(*) AS n, CAST(-sum({_COST}) AS BIGINT) AS cash_micros, min(ticker) AS first_ticker FROM v_trades GROUP BY 1",
    "allocation_faults": _L + "SELECT fault, count(*) AS n, CAST(sum(sell_id) AS BIGINT) AS sells, CAST(sum(lot_id) AS BIGINT) AS lots FROM fa GROUP BY 1",
    "allocation_decisions": _L.rstrip() + """, gd AS (SELECT * FROM ln WHERE sell_id NOT IN (SELECT sell_id FROM fa)), nd AS (SELECT sell_id FROM gd UNION SELECT sell_id FROM se WHERE sell_id % 9 = 0)
SELECT 'Retraction' AS kind, count(*) AS n, CAST(sum(sell_id) AS BIGINT) AS sells, CAST(sum(sell_id + 1000000) AS BIGINT) AS targets, CAST(NULL AS BIGINT) AS n_lines FROM nd WHERE sell_id % 3 = 0
UNION ALL SELECT 'SellAllocationDecision', count(DISTINCT sell_id), (SELECT CAST(sum(sell_id) AS BIGINT) FROM (SELECT DISTINCT sell_id FROM gd)), NULL, count(*) FROM gd""",
    "moved_trades": _MOVE + " SELECT * FROM mv",
    "moved_cash": _MOVE.rstrip() + f""", nt AS (SELECT mv.trade_id, source, target, {_COST} - coalesce(p, 0) AS net FROM mv JOIN v_trades USING (trade_id) LEFT JOIN (SELECT trade_id, sum({_M('shares_closed * exit_price')} - {_M('fees')} - {_M('taxes')}) AS p FROM aa GROUP BY 1) USING (trade_id))
SELECT portfolio_id, CAST(sum(c) AS BIGINT) AS cash_micros FROM (SELECT source AS portfolio_id, net AS c FROM nt UNION ALL SELECT target, -net FROM nt) GROUP BY 1""",
    "trade_deletions": with_(TRADES) + f"""SELECT q.trade_id, portfolio_id, CASE WHEN shares IS NULL THEN 'no such trade' WHEN l_partkey IS NOT NULL THEN 'shares are closed against it' END AS fault, CASE WHEN l_partkey IS NULL THEN {_COST} END AS cash_micros
FROM (SELECT trade_id * 2 AS trade_id FROM v_trades) q LEFT JOIN v_trades t USING (trade_id) LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 100 = 0) ON l_partkey = q.trade_id AND shares IS NOT NULL""",
    "renamed_tickers": with_(TRADES) + "SELECT CASE ticker WHEN 'BRAND#1' THEN 'ONE' WHEN 'BRAND#4' THEN 'FOUR' ELSE ticker END AS ticker, ticker IN ('BRAND#1', 'BRAND#4') AS was_renamed, count(*) AS n FROM v_trades GROUP BY ALL",
    "date_corrections": with_(TRADES, ALLOCATIONS) + """SELECT q AS trade_id, nd AS new_date, CASE WHEN nd < DATE '1995-01-01' THEN 'before tracking' WHEN nd > DATE '2002-01-01' THEN 'in the future' WHEN q < 0 THEN 'no such trade' WHEN nd > f THEN 'after its first sale' END AS fault
FROM (SELECT CASE WHEN trade_id % 40 = 0 THEN -trade_id - 1 ELSE trade_id END AS q, CAST(DATE '1994-12-01' + CAST(trade_id % 3000 AS INTEGER) AS DATE) AS nd FROM v_trades) LEFT JOIN (SELECT trade_id, min(execution_date) AS f FROM v_allocations GROUP BY 1) ON trade_id = q""",
    "cash_operations": "WITH " + _OPS + """, ls AS (SELECT portfolio_id, max(seq) AS fs, arg_max(amount, seq) AS base FROM om WHERE op = 'set' GROUP BY 1), sm AS (SELECT portfolio_id, sum(m) AS c FROM om LEFT JOIN ls USING (portfolio_id) WHERE fault IS NULL AND (fs IS NULL OR seq > fs) GROUP BY 1)
SELECT portfolio_id, CAST(coalesce(CAST(floor(base * 1e6 + 0.5) AS BIGINT), c0, 0) + coalesce(c, 0) AS BIGINT) AS cash_micros FROM (SELECT id AS portfolio_id, id * 1000000 AS c0 FROM range(50) x(id)) FULL JOIN ls USING (portfolio_id) LEFT JOIN sm USING (portfolio_id)""",
    "cash_operation_faults": "WITH " + _OPS + """ SELECT op, fault, CASE WHEN fault IS NULL THEN CASE op WHEN 'dividend' THEN 'Dividend' WHEN 'adjust' THEN 'CashAdjustment' WHEN 'deposit' THEN 'Deposit' WHEN 'withdrawal' THEN 'Withdrawal' WHEN 'split' THEN 'Split' WHEN 'rights-issue' THEN 'RightsIssue' END END AS event,
  count(*) AS n, CAST(sum(m) AS BIGINT) AS cash_micros FROM om GROUP BY 1, 2, 3""",
    "pending_executions": """WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN p_partkey % 5 = 0 THEN 'verified' ELSE 'needs-confirmation' END AS status, CAST(p_size AS DOUBLE) AS shares, p_retailprice AS price FROM part),
c AS (SELECT l_partkey AS id, count(*) AS k, min(struct_pack(a := l_orderkey, b := l_suppkey, q := l_quantity, e := l_extendedprice)) AS m FROM lineitem GROUP BY 1), j AS (SELECT *, status = 'needs-confirmation' AND k IS NOT NULL AS ok, id % 3 = 0 AS sold FROM p LEFT JOIN c USING (id))
SELECT id, side, CASE WHEN ok THEN 'verified' ELSE status END AS verification, CASE WHEN (side = 'BUY' AND ok) OR ((ok OR status = 'verified') AND sold) THEN 'executed' ELSE 'pending' END AS execution, CASE WHEN ok THEN m.q ELSE shares END AS shares, CASE WHEN ok THEN m.e / m.q ELSE price END AS price,
  CASE WHEN ok AND m.a % 2 = 0 THEN CAST(m.a AS VARCHAR) END AS number, coalesce(k, 0) > CASE WHEN ok THEN 1 ELSE 0 END AS refused FROM j""",
    "projection_actions": with_(FACTS.replace("v_facts AS (", "v_fine AS (") + """, v_facts AS (
SELECT * REPLACE (CAST(date_trunc('month', execution_date) AS DATE) AS execution_date, (shares % 4 + 1) * 10 AS shares) FROM v_fine)""") + """SELECT portfolio_id, kind, action, CAST(sum(n) AS BIGINT) AS n, max(d) AS deepest FROM (
  SELECT portfolio_id, kind, unnest(['keep', 'create', 'delete']) AS action, unnest([least(a, b), greatest(a - b, 0), greatest(b - a, 0)]) AS n, unnest([least(a, b), a, b]) AS d
  FROM (SELECT portfolio_id, ticker_id, kind, execution_date, shares, count(*) FILTER (source <> 'manual') AS a, count(*) FILTER (source <> 'csv') AS b FROM v_facts GROUP BY 1, 2, 3, 4, 5)) WHERE n > 0 GROUP BY 1, 2, 3""",
    "quarantined_trades": with_(TRADES) + """SELECT * FROM (SELECT trade_id, concat_ws('; ', CASE WHEN trade_id % 17 = 0 THEN 'shares must be positive' END, CASE WHEN trade_id % 23 = 0 THEN 'entry_price must be positive' END, CASE WHEN fees - CASE WHEN trade_id % 29 = 0 THEN 100 ELSE 0 END < 0 THEN 'fees must not be negative' END) AS fault FROM v_trades) WHERE fault <> ''""",
    "patched_columns": "SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
}
