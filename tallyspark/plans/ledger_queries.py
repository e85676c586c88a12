"""Ledger queries over the adapters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import ledger as L
from ..sources import adapters as S
from .oracle import ALLOCATIONS, CASH, FACTS, LOTS, REALIZED, TRADES, with_

KEYS = ["portfolio_id", "ticker_id"]


def _timeline(s, d):
    return L.fifo_timeline(S.facts(s, d), KEYS, S.FACT_ORDER)


def _id():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def _lot(s, d):
    return A.open_lots(S.trades(s, d), S.allocations(s, d))


def _realized(s, d):
    return A.realized(S.allocations(s, d), S.trades(s, d))


def _control_facts(s, d):
    """Facts with control facts that retract, rename and reassign some of them."""
    f = S.table(s, d, "orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("seq"),
        F.expr("CASE o_orderkey % 10 WHEN 7 THEN 'Correction' WHEN 8 THEN 'Retraction' WHEN 9 THEN 'PortfolioAssignment' ELSE 'BuyExecution' END").alias("kind"),
        F.concat(F.lit("T"), (F.col("o_custkey") % 40).cast("string")).alias("ticker"), (F.col("o_custkey") % 8).alias("portfolio_id"),
        F.concat(F.lit("f"), (F.col("o_orderkey") - F.col("o_custkey") % 50 - 1).cast("string")).alias("target_id"),
        F.when(F.col("o_orderkey") % 10 == 7, F.concat(F.lit("N"), (F.col("o_custkey") % 5).cast("string"))).alias("patch_ticker"), (F.col("o_custkey") % 3).alias("assigned_portfolio_id"),
    )
    return f


def _relevant(s, d):
    f = L.relevant_facts(_control_facts(s, d))
    return f.groupBy("current_portfolio", "current_ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


def _propose(s, d):
    lots = L.fifo_open_lots(_timeline(s, d), KEYS, ["execution_date", "cb", "l_orderkey", "l_linenumber"])
    o = S.table(s, d, "orders").groupBy((F.col("o_custkey") % 10).alias("portfolio_id"), F.floor(F.col("o_custkey") / 10 % 40).cast("bigint").alias("ticker_id"))
    need = o.agg((F.count(F.lit(1)) * 5).alias("need"), F.to_date(F.max("o_orderdate")).alias("sell_date"))
    return L.propose_fifo(lots, need, KEYS, ["cb"]).select(*KEYS, "l_orderkey", "l_linenumber", "take")


def _unallocated(s, d):
    sells = S.facts(s, d).filter("kind = 'SellExecution'").groupBy(*KEYS, "execution_date").agg(F.sum("shares").alias("shares")).withColumn("sell_id", F.concat_ws("-", *[F.col(c).cast("string") for c in (*KEYS, "execution_date")]))
    got = L.fifo_matches(_timeline(s, d), KEYS, _id(), F.concat_ws("-", *[F.col(c).cast("string") for c in (*KEYS, "execution_date")])).select("sell_id", F.col("matched").alias("shares"))
    return L.unallocated_sells(sells.select("sell_id", "shares"), got)


def _holdings(s, d):
    """Every third sale has two explicit lines over lots of its month, some asking for too much."""
    f = S.facts(s, d).withColumn("id", _id()).withColumn("at", F.concat_ws("T", F.date_format("execution_date", "yyyy-MM-dd"), F.lpad(F.coalesce("minutes", F.lit(0)).cast("string"), 4, "0")))
    side = lambda k: f.filter(F.col("kind") == k).groupBy(*KEYS, "id").agg(F.min("at").alias("at"), F.sum("shares").alias("shares"), F.min("price").alias("price"))
    lots, sells = side("BuyExecution").withColumn("fees", F.lit(1.5)).withColumn("taxes", F.lit(None).cast("double")), side("SellExecution")
    month = F.substring("at", 1, 7).alias("month")
    first = lots.groupBy(*KEYS, month).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    pick = sells.filter("shares % 3 = 0").select(*KEYS, month, F.col("id").alias("sell_id"), "shares").join(first, [*KEYS, "month"])
    lines = pick.select("sell_id", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.col("lo").alias("lot_id"), F.col("shares").alias("s")), F.struct(F.lit(2).alias("n"), F.col("hi").alias("lot_id"), F.floor(F.col("shares") / 3).alias("s")))).alias("x"))
    alloc = lines.select(F.concat_ws("|", "sell_id", F.col("x.n").cast("string")).alias("ord"), "sell_id", F.col("x.lot_id").alias("lot_id"), F.col("x.s").cast("bigint").alias("shares"))
    return L.holdings(lots, sells, alloc, KEYS)


QUERIES = {
    "holdings": _holdings,
    "cash_projection": lambda s, d: L.cash_projection(S.cash_events(s, d)),
    "fifo_open_lots": lambda s, d: L.fifo_open_lots(_timeline(s, d), KEYS, ["execution_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]),
    "fifo_matches": lambda s, d: L.fifo_matches(_timeline(s, d), KEYS, _id(), _id()),
    "fifo_proposal": _propose,
    "last_balanced_date": lambda s, d: L.last_balanced_date(S.facts(s, d), KEYS),
    "sell_orders": lambda s, d: L.sell_orders(S.facts(s, d)),
    "unallocated_sells": _unallocated,
    "split_tickers": lambda s, d: L.split_tickers(S.facts(s, d)),
    "timeline_by_day": lambda s, d: L.timeline_by_day(S.cash_events(s, d)),
    "event_flow": lambda s, d: S.cash_events(s, d).filter(F.col("kind").isin("Deposit", "Withdrawal", "DividendPayment")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")),
    "sell_outcomes": lambda s, d: L.sell_outcomes(_realized(s, d), _lot(s, d)),
    "relevant_facts": _relevant,
}

_ORDER = "execution_date, CASE WHEN kind = 'BuyExecution' THEN 0 ELSE 1 END, l_orderkey, l_linenumber, l_partkey, l_suppkey, shares, l_extendedprice"
_RUN = f"""run AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
  sum(CASE WHEN kind = 'BuyExecution' THEN shares ELSE 0 END) OVER w AS cb, sum(CASE WHEN kind = 'SellExecution' THEN shares ELSE 0 END) OVER w AS cs FROM v_facts
  WINDOW w AS (PARTITION BY portfolio_id, ticker_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)),
eff AS (SELECT *, cs - greatest(0, max(cs - cb) OVER (PARTITION BY portfolio_id, ticker_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)) AS eff FROM run),
lastf AS (SELECT portfolio_id, ticker_id, max(eff) AS e FROM eff GROUP BY 1, 2),
openl AS (SELECT f.*, CAST(greatest(0, cb - greatest(cb - shares, e)) AS BIGINT) AS remaining FROM eff f JOIN lastf USING (portfolio_id, ticker_id) WHERE kind = 'BuyExecution'),
sl AS (SELECT *, coalesce(lag(eff) OVER (PARTITION BY portfolio_id, ticker_id ORDER BY cs), 0) AS prev FROM eff WHERE kind = 'SellExecution'),
mt AS (SELECT b.portfolio_id, b.ticker_id, b.id AS lot_id, s.id AS sell_id, s.execution_date AS sold, least(b.cb, s.eff) - greatest(b.cb - b.shares, s.prev) AS m
  FROM eff b JOIN sl s ON b.portfolio_id = s.portfolio_id AND b.ticker_id = s.ticker_id AND b.kind = 'BuyExecution' AND b.cb > s.prev AND b.cb - b.shares < s.eff AND s.eff > s.prev)"""
_F = with_(FACTS)
_M = _F.rstrip() + ",\n" + _RUN + "\n"

ORACLES = {
    "cash_projection": with_(CASH) + """SELECT portfolio_id, CAST(coalesce(CAST(floor(any_value(ra) * 1e6 + 0.5) AS BIGINT), 0) + coalesce(sum(CASE WHEN kind <> 'CashReset' AND (rs IS NULL OR seq > rs)
  THEN CAST(floor(amount * 1e6 + 0.5) AS BIGINT) * CASE WHEN kind IN ('BuyExecution', 'Withdrawal') THEN -1 ELSE 1 END END), 0) AS BIGINT) AS cash_micros, count(*) FILTER (rs IS NULL OR seq > rs) AS n_after
FROM v_cash LEFT JOIN (SELECT portfolio_id, max(seq) AS rs, arg_max(amount, seq) AS ra FROM v_cash WHERE kind = 'CashReset' GROUP BY 1) USING (portfolio_id) GROUP BY 1""",
    "fifo_open_lots": _M + "SELECT portfolio_id, ticker_id, execution_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, shares, remaining FROM openl WHERE remaining > 0",
    "fifo_matches": _M + "SELECT portfolio_id, ticker_id, lot_id, sell_id, CAST(sum(m) AS BIGINT) AS matched FROM mt WHERE m > 0 GROUP BY ALL",
    "fifo_proposal": _M + """SELECT portfolio_id, ticker_id, l_orderkey, l_linenumber, CAST(take AS BIGINT) AS take FROM (
  SELECT *, least(remaining, greatest(0, need - coalesce(sum(remaining) OVER (PARTITION BY portfolio_id, ticker_id ORDER BY execution_date, cb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take
  FROM openl JOIN (SELECT o_custkey % 10 AS portfolio_id, o_custkey // 10 % 40 AS ticker_id, count(*) * 5 AS need, CAST(max(o_orderdate) AS DATE) AS sell_date FROM orders GROUP BY 1, 2) USING (portfolio_id, ticker_id)
  WHERE remaining > 0 AND execution_date <= sell_date) WHERE take > 0""",
    "last_balanced_date": _F + """SELECT portfolio_id, ticker_id, CASE WHEN max(execution_date) FILTER (b = 0) < max(execution_date) THEN max(execution_date) FILTER (b = 0) END AS balanced_on, CAST(sum(net) AS BIGINT) AS net_shares
FROM (SELECT *, sum(net) OVER (PARTITION BY portfolio_id, ticker_id ORDER BY execution_date) AS b FROM (
  SELECT portfolio_id, ticker_id, execution_date, sum(CASE WHEN kind = 'BuyExecution' THEN shares ELSE -shares END) AS net FROM v_facts GROUP BY 1, 2, 3)) GROUP BY 1, 2""",
    "sell_orders": _F + "SELECT portfolio_id, ticker_id, execution_date, CAST(floor(price * 10000 + 0.5) AS BIGINT) AS price4, CAST(coalesce(minutes, -1) AS INTEGER) AS at, CAST(sum(shares) AS BIGINT) AS shares, count(*) AS n FROM v_facts WHERE kind = 'SellExecution' GROUP BY 1, 2, 3, 4, 5",
    "unallocated_sells": _M + """SELECT concat_ws('-', portfolio_id, ticker_id, execution_date) AS sell_id, shares, CAST(coalesce(a, 0) AS BIGINT) AS allocated
FROM (SELECT portfolio_id, ticker_id, execution_date, CAST(sum(shares) AS BIGINT) AS shares FROM v_facts WHERE kind = 'SellExecution' GROUP BY 1, 2, 3)
LEFT JOIN (SELECT portfolio_id, ticker_id, sold AS execution_date, sum(m) AS a FROM mt WHERE m > 0 GROUP BY 1, 2, 3) USING (portfolio_id, ticker_id, execution_date) WHERE coalesce(a, 0) < shares - 0.000001""",
    "split_tickers": _F + "SELECT ticker_id, count(*) AS n_portfolios, string_agg(portfolio_id, ',' ORDER BY portfolio_id) AS portfolios FROM (SELECT DISTINCT ticker_id, portfolio_id FROM v_facts) GROUP BY 1 HAVING count(*) > 1",
    "timeline_by_day": with_(CASH) + "SELECT CAST(ts AS DATE) AS day, kind, count(*) AS n, CAST(sum(CAST(floor(amount * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS amount_micros FROM v_cash GROUP BY 1, 2",
    "event_flow": with_(CASH) + "SELECT kind, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM v_cash WHERE kind IN ('Deposit', 'Withdrawal', 'DividendPayment') GROUP BY 1",
    "sell_outcomes": with_(TRADES, ALLOCATIONS, REALIZED, LOTS) + """SELECT sell_group_id, CAST(sum(pnl + r.cost) AS BIGINT) AS proceeds_micros, CAST(sum(pnl) AS BIGINT) AS pnl_micros,
  CASE WHEN count(*) = 1 AND bool_and(rem <= 0) THEN 'Sell' ELSE 'PartialSell' END AS event FROM r JOIN lots USING (trade_id) GROUP BY 1""",
    "relevant_facts": """WITH f AS (SELECT o_orderkey AS seq, 'f' || o_orderkey AS id, CASE o_orderkey % 10 WHEN 7 THEN 'Correction' WHEN 8 THEN 'Retraction' WHEN 9 THEN 'PortfolioAssignment' ELSE 'BuyExecution' END AS kind,
  'T' || (o_custkey % 40) AS ticker, o_custkey % 8 AS portfolio_id, 'f' || (o_orderkey - o_custkey % 50 - 1) AS target_id, CASE WHEN o_orderkey % 10 = 7 THEN 'N' || (o_custkey % 5) END AS patch, o_custkey % 3 AS assigned FROM orders),
t AS (SELECT target_id AS id, arg_max(patch, seq) AS nt FROM f WHERE kind = 'Correction' GROUP BY 1), p AS (SELECT target_id AS id, arg_max(assigned, seq) AS np FROM f WHERE kind = 'PortfolioAssignment' GROUP BY 1)
SELECT coalesce(np, portfolio_id) AS current_portfolio, coalesce(nt, ticker) AS current_ticker, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM f LEFT JOIN t USING (id) LEFT JOIN p USING (id)
WHERE kind NOT IN ('Correction', 'Retraction', 'PortfolioAssignment') AND id NOT IN (SELECT target_id FROM f WHERE kind = 'Retraction') GROUP BY 1, 2""",
    "holdings": with_(FACTS).rstrip() + """, k AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, concat(strftime(execution_date, '%Y-%m-%d'), 'T', lpad(CAST(coalesce(minutes, 0) AS VARCHAR), 4, '0')) AS tm FROM v_facts),
g AS (SELECT portfolio_id, ticker_id, kind, id, min(tm) AS tm, CAST(sum(shares) AS BIGINT) AS sh, min(price) AS price FROM k GROUP BY 1, 2, 3, 4), fm AS (SELECT portfolio_id, ticker_id, left(tm, 7) AS mo, min(id) AS lo, max(id) AS hi FROM g WHERE kind = 'BuyExecution' GROUP BY 1, 2, 3),
al AS (SELECT concat(id, '|', n) AS o, id AS sell_id, CASE n WHEN 1 THEN lo ELSE hi END AS lot_id, CASE n WHEN 1 THEN sh ELSE sh // 3 END AS s FROM g JOIN fm ON g.portfolio_id = fm.portfolio_id AND g.ticker_id = fm.ticker_id AND left(g.tm, 7) = fm.mo CROSS JOIN (VALUES (1), (2)) v(n) WHERE g.kind = 'SellExecution' AND sh % 3 = 0),
ad AS (SELECT al.*, least(s, greatest(0, l.sh - coalesce(sum(s) OVER (PARTITION BY lot_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS got FROM al JOIN (SELECT id, sh FROM g WHERE kind = 'BuyExecution') l ON l.id = lot_id),
r AS (SELECT g.*, sh - coalesce(gone, 0) AS q FROM g LEFT JOIN (SELECT lot_id AS id, 'BuyExecution' AS kind, sum(got) AS gone FROM ad GROUP BY 1 UNION ALL SELECT sell_id, 'SellExecution', sum(got) FROM ad GROUP BY 1) USING (id, kind)),
t AS (SELECT *, sum(CASE WHEN kind = 'BuyExecution' THEN q ELSE 0 END) OVER w AS cb, sum(CASE WHEN kind = 'SellExecution' THEN q ELSE 0 END) OVER w AS cs FROM r WHERE q > 0 WINDOW w AS (PARTITION BY portfolio_id, ticker_id ORDER BY tm, kind <> 'BuyExecution', id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, cs - greatest(0, max(cs - cb) OVER (PARTITION BY portfolio_id, ticker_id ORDER BY tm, kind <> 'BuyExecution', id ROWS UNBOUNDED PRECEDING)) AS eff FROM t),
o AS (SELECT *, greatest(0, cb - greatest(cb - q, max(eff) OVER (PARTITION BY portfolio_id, ticker_id))) AS rem FROM e)
SELECT portfolio_id, ticker_id, id, CAST(rem AS BIGINT) AS remaining, CAST(floor(CAST(floor((price * sh + 1.5::DOUBLE) * 1e6 + 0.5) AS BIGINT) * rem / sh + 0.5) AS BIGINT) AS cost_micros FROM o WHERE kind = 'BuyExecution' AND rem > 0""",
}
