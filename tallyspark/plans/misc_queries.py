"""Scans, text functions, event windows and grouped kernels over the driver's tables, with SQL
where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import text as X
from ..operators import grouped as G
from ..sources import adapters as S
from ..sources import readers as D
from ..sources import sinks as K
from ..streaming import facts as W
from .oracle import FACTS, with_

_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _id():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in _ID])


def _t(s, d, name):
    return S.table(s, d, name)


#: Companies of the fuzzy lookup: fixed test values, part names cut short or misspelt.
COMPANIES = [(1, "SMALL WIDGETT", "SWID"), (2, "RED ANVL", "RANV"), (3, "NEW BOLT", "NBLT"), (4, "BLUE GIZMOS", "BGIZ"), (5, "BLUE BOLD", "BBLD")]


def _fuzzy(s, d):
    names = _t(s, d, "part").select(F.upper("p_name").alias("name"))
    return X.fuzzy_lookup(names, s.createDataFrame(COMPANIES, "ord int, company string, ticker string"))


def _order_lines(s, d):
    li = _t(s, d, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("Buy")
    line = F.format_string("ref %d %s %d ABC @ %.2f %s", F.col("l_orderkey"), side, F.col("l_quantity").cast("int"), F.col("l_extendedprice") / F.col("l_quantity"), F.date_format("l_shipdate", "dd/MM/yyyy"))
    docs = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return X.extract_orders(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"), F.count_if(F.col("side") == "SELL").alias("n_sell"), F.max("day").alias("last_day"))


def _scalars(s, d):
    c = _t(s, d, "customer")
    h = (F.col("c_custkey") % 24).cast("int")
    clock = F.format_string("%02d:%02d%s", F.when(h % 12 == 0, 12).otherwise(h % 12), (F.col("c_custkey") % 60).cast("int"), F.when(h < 12, "AM").otherwise("PM"))
    return c.select(
        "c_custkey", E.to_micros("c_acctbal").alias("micros"), E.money_mul(E.to_micros("c_acctbal"), F.lit(0.5)).alias("half_micros"), E.round4(F.col("c_acctbal") / 7).alias("r4"),
        E.time_to_minutes(clock).cast("int").alias("minutes"), E.normalize_ticker(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(".ca "))).alias("ticker"), E.company_key(F.concat("c_name", F.lit(", Co."))).alias("company"),
        E.clamp(F.col("c_acctbal") / 100, 0.0, 50.0).alias("clamped"), E.excel_date(F.lit(36000) + F.col("c_custkey") % 1000).alias("day"), E.within("c_acctbal", F.col("c_acctbal") * 1.005, 0.01).alias("near"),
    )


def _search(s, d):
    o = _t(s, d, "orders")
    return D.scan(o, equals={"o_orderstatus": "F", "o_custkey": None}, isin={"o_orderpriority": ["1-URGENT", "2-HIGH"]}, below={"o_totalprice": 100000.0}).select("o_orderkey", "o_custkey", "o_totalprice")


def _allocation_rows(s, d):
    f = S.facts(s, d).withColumn("id", _id())
    keys = ["portfolio_id", "ticker_id"]
    buys = f.filter("kind = 'BuyExecution'").groupBy(*keys, "id").agg(F.min("execution_date").alias("on"), F.sum("shares").cast("double").alias("shares"))
    sells = f.filter("kind = 'SellExecution'").groupBy(*keys, "id").agg(F.min("execution_date").alias("on"), F.sum("shares").cast("double").alias("shares"))
    near = sells.withColumn("month", F.trunc("on", "month")).join(buys.groupBy(*keys, F.trunc("on", "month").alias("month")).agg(F.min("id").alias("lot_id")), [*keys, "month"])
    zero = F.lit(0.0)
    lot = buys.select(*keys, F.lit("lot").alias("kind"), F.unix_date("on").alias("ord"), "id", F.col("id").alias("lot_id"), zero.alias("sell_shares"), "shares", zero.alias("fees"), zero.alias("taxes"))
    line = near.select(*keys, F.lit("line").alias("kind"), F.unix_date("on").alias("ord"), "id", "lot_id", F.col("shares").alias("sell_shares"), (F.col("shares") / 2).alias("shares"), F.lit(10.0).alias("fees"), F.lit(4.0).alias("taxes"))
    return lot.unionByName(line)


def _evidence_rows(s, d):
    """Rows of order screens are evidence, half of them undated; csv and statement rows candidates."""
    f = S.dense_facts(s, d).withColumn("id", _id())
    role = F.when(F.col("source").isin("orders-screen"), "evidence").when(F.col("source").isin("csv", "statement"), "candidate")
    dated = (role == "candidate") | (F.col("l_linenumber") % 2 == 0)
    r = f.select("portfolio_id", "ticker_id", F.col("kind").alias("side"), role.alias("role"), F.col("l_orderkey").alias("ord"), "id", F.col("shares").cast("double").alias("shares"), "price", F.col("minutes").cast("double").alias("minutes"), F.when(dated, F.date_format("execution_date", "yyyy-MM-dd")).alias("day"), (F.col("shares") * F.col("price")).alias("total"))
    return r.filter("role IS NOT NULL")


def _statement_rows(s, d):
    f = S.dense_facts(s, d).withColumn("id", _id())
    role = F.when(F.col("source") == "statement", "statement").when(F.col("source").isin("csv", "orders-screen", "invoice"), "execution")
    r = f.select("portfolio_id", "ticker_id", "execution_date", "kind", role.alias("role"), F.col("l_orderkey").alias("ord"), "id", F.when(role == "statement", F.col("shares") * 2).otherwise(F.col("shares")).cast("double").alias("shares"), "price").filter("role IS NOT NULL")
    return r


def _official_rows(s, d):
    """Official sales over official lots; other sales have taken theirs from the first lot of the month."""
    f = S.facts(s, d).withColumn("id", _id()).withColumn("at", F.unix_date("execution_date").cast("double")).withColumn("shares", F.col("shares").cast("double"))
    keys = ["portfolio_id", "ticker_id"]
    cols = [*keys, "role", "at", "id", "lot_id", "shares"]
    lots = f.filter("kind = 'BuyExecution'").select(*keys, F.lit("lot").alias("role"), "at", "id", F.lit(None).cast("string").alias("lot_id"), "shares")
    sells = f.filter("kind = 'SellExecution'")
    official = sells.filter("source = 'official-broker-excel'").select(*keys, F.lit("sell").alias("role"), "at", "id", F.lit(None).cast("string").alias("lot_id"), "shares")
    first = f.filter("kind = 'BuyExecution'").groupBy(*keys, F.trunc("execution_date", "month").alias("month")).agg(F.min("id").alias("lot_id"))
    other = sells.filter("source <> 'official-broker-excel'").withColumn("month", F.trunc("execution_date", "month")).join(first, [*keys, "month"]).select(*keys, F.lit("decided").alias("role"), "at", "id", "lot_id", (F.col("shares") / 2).alias("shares"))
    return lots.select(*cols).unionByName(official.select(*cols)).unionByName(other.select(*cols)).withColumn("ord", F.col("at"))


def _canonical_rows(s, d):
    f = S.dense_facts(s, d).withColumn("id", _id())
    role = F.when(F.col("source").isin("csv", "manual"), "stored").otherwise("canonical")
    return f.select("portfolio_id", "ticker_id", "kind", "execution_date", "shares", role.alias("role"), F.col("l_orderkey").alias("ord"), "id", F.when(F.col("l_linenumber") % 3 == 0, (F.col("l_orderkey") % 50).cast("string")).alias("number"), "price")


def _duplicate_lot_rows(s, d):
    """Lots of small tickers of which the ledger has more than the broker counts."""
    e = S.entries(s, d).filter("kind = 'BuyExecution'")
    keys = ["portfolio_id", "ticker_id"]
    total = e.groupBy(*keys).agg(F.sum("shares").cast("double").alias("computed"))
    lots = e.select(*keys, F.col("l_orderkey").alias("ord"), "id", "price", F.col("shares").cast("double").alias("shares"), (F.col("shares") - F.when(F.col("l_linenumber") == 7, 5).otherwise(0)).cast("double").alias("remaining"))
    return lots.join(total, keys).join(S.counted_units(s, d), keys).filter("computed > units")


def _events(s, d):
    return _t(s, d, "events")


QUERIES = {
    "scalar_functions": _scalars,
    "dynamic_search": _search,
    "point_lookup": lambda s, d: D.scan(_t(s, d, "orders"), equals={"o_orderkey": 7}).select("o_orderkey", "o_custkey"),
    "recent_events": lambda s, d: D.recent(_events(s, d), "event_id", 25).select("event_id", "user_id", "event_type"),
    "prune_newest": lambda s, d: K.newest(_events(s, d), "event_id", K.RETAIN_CASES).select("event_id", "user_id"),
    "numbered_append": lambda s, d: K.numbered(_t(s, d, "orders").select("o_orderkey"), 1000, ["o_orderkey"]),
    "upsert": lambda s, d: K.upsert(_t(s, d, "nation"), _t(s, d, "nation").filter("n_nationkey % 3 = 0").withColumn("n_name", F.lower("n_name")), "n_nationkey"),
    "text_normalize": lambda s, d: _t(s, d, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")).cast("binary"), 256).alias("digest")),
    "document_kinds": lambda s, d: _t(s, d, "documents").groupBy(X.document_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "fuzzy_lookup": _fuzzy,
    "order_lines": _order_lines,
    "source_authority": lambda s, d: S.facts(s, d).groupBy("source").agg(F.max(E.authority("source")).alias("rank"), F.count(F.lit(1)).alias("n")),
    "tumbling_windows": lambda s, d: W.tumbling(_events(s, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")),
    "sliding_windows": lambda s, d: W.sliding(_events(s, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")),
    "session_windows": lambda s, d: W.sessions(_events(s, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest")),
    "allocation_replay": lambda s, d: G.allocate(_allocation_rows(s, d), ["portfolio_id", "ticker_id"]),
    "order_evidence": lambda s, d: G.order_evidence(_evidence_rows(s, d), ["portfolio_id", "ticker_id", "side"]),
    "statement_aggregates": lambda s, d: G.statement_aggregates(_statement_rows(s, d), ["portfolio_id", "ticker_id", "execution_date", "kind"]),
    "official_sell_repair": lambda s, d: G.repaired_official_sells(_official_rows(s, d), ["portfolio_id", "ticker_id"]),
    "canonical_matches": lambda s, d: G.matched_canonical(_canonical_rows(s, d), ["portfolio_id", "ticker_id", "kind", "execution_date", "shares"]),
    "suspected_duplicate_lots": lambda s, d: G.duplicate_lots(_duplicate_lot_rows(s, d), ["portfolio_id", "ticker_id"]),
}

ORACLES = {
    "scalar_functions": """SELECT c_custkey, CAST(floor(c_acctbal * 1e6 + 0.5) AS BIGINT) AS micros, CAST(floor(CAST(floor(c_acctbal * 1e6 + 0.5) AS BIGINT) * 0.5::DOUBLE + 0.5) AS BIGINT) AS half_micros,
  CAST(floor(c_acctbal / 7 * 10000.0 + 0.5) AS BIGINT) / 10000.0::DOUBLE AS r4, CAST(c_custkey % 24 * 60 + c_custkey % 60 AS INTEGER) AS minutes, upper(c_mktsegment) AS ticker, upper(c_name) AS company,
  CAST(least(greatest(c_acctbal / 100, 0.0), 50.0) AS DOUBLE) AS clamped, CAST(DATE '1899-12-30' + CAST(36000 + c_custkey % 1000 AS INTEGER) AS DATE) AS day,
  abs(c_acctbal - c_acctbal * 1.005::DOUBLE) <= greatest(c_acctbal, c_acctbal * 1.005::DOUBLE) * 0.01::DOUBLE AS near FROM customer""",
    "dynamic_search": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice < 100000",
    "point_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7",
    "recent_events": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 25",
    "prune_newest": "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 200",
    "numbered_append": "SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders",
    "upsert": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation",
    "text_normalize": r"SELECT doc_id, sha256(translate(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), '[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '٠١٢٣٤٥٦٧٨٩٫٬', '0123456789.,')) AS digest FROM documents",
    "document_kinds": r"""SELECT CASE WHEN length(trim(text)) < 20 THEN 'unreadable' WHEN regexp_matches(text, '(?i)\binvoice\b') THEN 'invoice' WHEN regexp_matches(text, '(?i)average\s+cost') THEN 'position'
  WHEN regexp_matches(text, '(?i)account\s+statement') THEN 'statement' WHEN regexp_matches(text, '(?i)\b(filled|cancelled|pending)\b') THEN 'orders' ELSE 'unknown' END AS kind, count(*) AS n FROM documents GROUP BY 1""",
    "fuzzy_lookup": """WITH c(ord, key, ticker) AS (VALUES (1, 'SMALL WIDGETT', 'SWID'), (2, 'RED ANVL', 'RANV'), (3, 'NEW BOLT', 'NBLT'), (4, 'BLUE GIZMOS', 'BGIZ'), (5, 'BLUE BOLD', 'BBLD')),
n AS (SELECT DISTINCT upper(p_name) AS name FROM part), j AS (SELECT name, ticker, ord, name <> key AS near, levenshtein(substr(name, 1, length(key)), key) AS distance, key FROM n JOIN c ON length(name) >= length(key) * 0.7)
SELECT name, ticker, CAST(distance AS INTEGER) AS distance FROM j WHERE distance <= greatest(2, floor(length(key) * 0.15)) QUALIFY row_number() OVER (PARTITION BY name ORDER BY near, ord) = 1""",
    "order_lines": "SELECT l_orderkey AS doc_id, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS shares, count(*) FILTER (l_returnflag = 'R') AS n_sell, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem GROUP BY 1",
    "source_authority": with_(FACTS) + "SELECT source, CAST(max(rank) AS INTEGER) AS rank, count(*) AS n FROM v_facts GROUP BY 1",
    "tumbling_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "sliding_windows": """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS w FROM events) GROUP BY 1""",
    "session_windows": """SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (
  SELECT user_id, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY 1, 2) GROUP BY 1""",
}
