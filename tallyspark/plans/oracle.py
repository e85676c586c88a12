"""The adapters as SQL, for the second engine's side of each comparison."""

TRADES = """v_trades AS (
SELECT p_partkey AS trade_id, p_partkey % 8 AS portfolio_id, upper(p_brand) AS ticker, p_type AS sector, CAST(1000.0 AS DOUBLE) AS shares,
       p_retailprice AS entry_price, CAST(p_size AS DOUBLE) AS fees, CAST(0.5 AS DOUBLE) AS taxes, CAST('1995-01-01' AS DATE) AS execution_date, p_name AS tags FROM part)"""
ALLOCATIONS = """v_allocations AS (
SELECT l_orderkey AS sell_group_id, l_linenumber AS line_no, l_partkey AS trade_id, l_partkey % 8 AS portfolio_id, l_quantity AS shares_closed,
       l_extendedprice / l_quantity AS exit_price, l_discount * 10 AS fees, l_tax * 10 AS taxes, CAST(l_shipdate AS DATE) AS execution_date FROM lineitem)"""
FACTS = """v_facts AS (
SELECT CASE WHEN l_returnflag = 'R' THEN 'SellExecution' ELSE 'BuyExecution' END AS kind,
       CASE l_orderkey % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'official-broker-excel' WHEN 2 THEN 'statement' WHEN 3 THEN 'orders-screen' WHEN 4 THEN 'csv' ELSE 'manual' END AS source,
       CASE l_orderkey % 6 WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 0 END AS rank,
       l_suppkey % 10 AS portfolio_id, l_partkey % 40 AS ticker_id, CAST(l_quantity AS BIGINT) AS shares, l_extendedprice / l_quantity AS price,
       CAST(l_shipdate AS DATE) AS execution_date, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber * 60 END AS minutes,
       CASE l_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""
DENSE = FACTS.replace("v_facts AS (", "v_fine AS (") + """, v_facts AS (
SELECT * REPLACE (CAST(date_trunc('month', execution_date) AS DATE) AS execution_date, (shares % 4 + 1) * 10 AS shares, CAST((floor(price / 250) + 1) * 250.0 + l_linenumber AS DOUBLE) AS price) FROM v_fine)"""
ENTRIES = FACTS + """, v_entries AS (
SELECT portfolio_id, l_partkey AS ticker_id, kind, CAST(date_trunc('year', execution_date) AS DATE) AS execution_date, (shares % 2 + 1) * 10 AS shares, CAST((floor(price / 500) + 1) * 500.0 + l_linenumber AS DOUBLE) AS price,
       CASE WHEN l_linenumber % 4 = 0 THEN 600 END AS minutes, CASE WHEN l_linenumber = 3 THEN CAST(l_orderkey % 5 AS VARCHAR) END AS number, nullif(source, 'manual') AS source,
       confidence, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey, l_linenumber, l_suppkey,
       row_number() OVER () AS rid FROM v_facts),
v_existing AS (SELECT DISTINCT portfolio_id, ticker_id, CAST(ticker_id % 3 * 10 AS DOUBLE) AS existing, ticker_id % 3 * 10000000000 AS existing_cost FROM v_entries),
v_units AS (SELECT DISTINCT portfolio_id, ticker_id, CAST(ticker_id % 5 * 10 AS DOUBLE) AS units, CASE WHEN ticker_id % 2 = 0 THEN 1000.0::DOUBLE + ticker_id % 7 * 50 END AS avg_cost FROM v_entries WHERE (ticker_id + portfolio_id) % 3 <> 0)"""
CASH = """v_cash AS (
SELECT event_id AS seq, user_id AS portfolio_id, CASE event_type WHEN 'purchase' THEN 'Withdrawal' WHEN 'signup' THEN 'Deposit' WHEN 'click' THEN 'DividendPayment'
       WHEN 'error' THEN 'CashReset' ELSE 'CashAdjustment' END AS kind, value AS amount, ts FROM events)"""
PRICES = """v_prices AS (
SELECT l_partkey % 40 AS ticker_id, CAST(l_shipdate AS DATE) AS price_date, CAST(floor(avg(l_extendedprice / l_quantity) * 100 + 0.5) AS BIGINT) / CAST(100.0 AS DOUBLE) AS close FROM lineitem GROUP BY 1, 2)"""
REALIZED = """r AS (
SELECT a.portfolio_id, a.trade_id, t.ticker, t.sector, t.tags, a.sell_group_id, a.shares_closed, a.execution_date AS exit_date,
       CAST(floor(((a.exit_price - (a.fees + a.taxes) / a.shares_closed) - (t.entry_price + (t.fees + t.taxes) / t.shares)) * a.shares_closed * 1e6 + 0.5) AS BIGINT) AS pnl,
       CAST(floor((t.entry_price + (t.fees + t.taxes) / t.shares) * a.shares_closed * 1e6 + 0.5) AS BIGINT) AS cost,
       ((a.exit_price - (a.fees + a.taxes) / a.shares_closed) - (t.entry_price + (t.fees + t.taxes) / t.shares)) / (t.entry_price + (t.fees + t.taxes) / t.shares) * 100 AS pct,
       date_diff('day', t.execution_date, a.execution_date) AS days
FROM v_allocations a JOIN v_trades t USING (trade_id))"""
LOTS = """lots AS (
SELECT t.*, greatest(shares - coalesce(closed, 0.0), 0.0) AS rem,
       CAST(floor(CAST(floor((shares * entry_price + fees + taxes) * 1e6 + 0.5) AS BIGINT) * greatest(shares - coalesce(closed, 0.0), 0.0) / shares + 0.5) AS BIGINT) AS cost
FROM v_trades t LEFT JOIN (SELECT trade_id, sum(shares_closed) AS closed FROM v_allocations GROUP BY 1) c USING (trade_id)),
px AS (SELECT ticker, max(struct_pack(d := CAST(l_shipdate AS DATE), p := l_extendedprice / l_quantity)).p AS price
       FROM lineitem JOIN (SELECT p_partkey, upper(p_brand) AS ticker FROM part) ON l_partkey = p_partkey GROUP BY 1),
cash AS (SELECT p AS portfolio_id, (p + 1) * 5000000000000 AS cash FROM range(7) x(p))"""


LEDGER = FACTS + """, v_lines AS (
SELECT concat_ws('-', 'x', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS id, l_orderkey AS seq, kind, source, concat('T', ticker_id) AS ticker, portfolio_id, execution_date, minutes, shares, price, confidence FROM v_facts),
v_orders AS (SELECT seq, min(id) AS first_id, min(id) FILTER (kind = 'SellExecution') AS sell_id, arg_min(portfolio_id, id) FILTER (kind = 'SellExecution') AS sell_portfolio, arg_min(ticker, id) FILTER (kind = 'SellExecution') AS sell_ticker,
  list({'lot_ref': id, 'shares': shares} ORDER BY id) FILTER (kind = 'BuyExecution') AS lots FROM v_lines GROUP BY 1),
v_control AS (SELECT concat('c-', seq) AS id, seq, kind, CASE WHEN kind = 'SellAllocationDecision' THEN sell_portfolio END AS portfolio_id, CASE WHEN kind = 'SellAllocationDecision' THEN sell_ticker END AS ticker,
  CASE WHEN kind <> 'SellAllocationDecision' THEN CASE WHEN c % 4 = 0 THEN concat('c-', seq - c % 50 - 1) ELSE first_id END END AS target_id, CASE WHEN kind = 'Correction' THEN concat('T', c % 40) END AS patch_ticker,
  CASE WHEN kind = 'PortfolioAssignment' THEN c % 10 END AS assigned, CASE WHEN kind = 'SellAllocationDecision' THEN sell_id END AS sell_execution_id, CASE WHEN kind = 'SellAllocationDecision' THEN coalesce(lots, []) END AS allocations
  FROM (SELECT o_orderkey AS seq, o_custkey AS c, CASE o_orderkey % 10 WHEN 6 THEN 'SellAllocationDecision' WHEN 7 THEN 'Correction' WHEN 8 THEN 'Retraction' ELSE 'PortfolioAssignment' END AS kind FROM orders WHERE o_orderkey % 10 >= 6) LEFT JOIN v_orders USING (seq)
  WHERE kind <> 'SellAllocationDecision' OR sell_id IS NOT NULL),
v_ledger AS (SELECT * FROM v_lines UNION ALL BY NAME SELECT * FROM v_control)"""

DENSE_LEDGER = DENSE + ", v_lines AS (" + LEDGER.split("v_lines AS (")[1].replace("shares, price, confidence FROM v_facts", "shares, floor(price / 250) * 250.0::DOUBLE AS price, confidence FROM v_facts")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r6(x: str) -> str:
    return f"CAST(floor(({x}) * 1000000.0 + 0.5) AS BIGINT) / 1000000.0::DOUBLE"


WIN = r6("count(*) FILTER (pnl > 0) / count(*) * 100")
PF = "CASE WHEN coalesce(sum(-pnl) FILTER (pnl < 0), 0) > 0 THEN " + r6("coalesce(sum(pnl) FILTER (pnl > 0), 0) / sum(-pnl) FILTER (pnl < 0)") + " WHEN coalesce(sum(pnl) FILTER (pnl > 0), 0) > 0 THEN 'infinity'::DOUBLE ELSE 0.0 END"


def mean_pct(cond: str) -> str:
    return "coalesce(" + r6(f"sum(CAST(floor(pct * 1e6 + 0.5) AS BIGINT)) FILTER ({cond})::DOUBLE / count(*) FILTER ({cond}) / 1e6") + ", 0.0)"
