"""Queries that read broker documents, written here from the tables, and their SQL, which takes
the same records straight from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..sources import adapters as S

_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _t(s, d, name):
    return S.table(s, d, name)


def _month(day):
    return F.element_at(F.array(*map(F.lit, _MONTHS)), F.month(day))


def _parts(s, d):
    """Parts, dealt out over all tasks: their file is small, so one task would read all documents."""
    return _t(s, d, "part").repartition("p_partkey")


def _words(day):
    """5 Mar 1998"""
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), _month(day), F.year(day).cast("string"))


def _dictionary(s, d):
    p = _t(s, d, "part").select(F.upper("p_name").alias("company")).distinct()
    w = F.split("company", " ")
    return p.select("company", F.concat(F.substring(w[0], 1, 2), F.substring(w[1], 1, 2)).alias("ticker"), F.col("company").alias("ord"))


def _per_order(s, d, line, lead=""):
    """One document an order: its lines, sorted and joined."""
    li = _t(s, d, "lineitem").join(_t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    li = li.withColumn("day", F.to_date("l_shipdate")).withColumn("sell", F.col("l_returnflag") == "R").withColumn("unit", F.floor(F.col("l_extendedprice") / F.col("l_quantity")) + F.lit(0.25)).withColumn("code", F.concat(F.upper(F.substring("p_name", 1, 2)), F.upper(F.substring(F.element_at(F.split("p_name", " "), 2), 1, 2))))
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit(lead), F.array_join(F.array_sort(F.collect_list(line(li))), "\n")).alias("text"))


def _statement_docs(s, d):
    def line(li):
        name = F.when(li.l_linenumber % 4 == 0, F.concat(li.p_name, F.lit(" Co."))).when(li.l_linenumber % 4 == 1, F.concat(li.p_name, F.lit(" (X1)"))).otherwise(F.concat(F.lit("T+1 "), li.p_name))
        shares = F.translate(li.l_quantity.cast("int").cast("string"), "0", "O")
        return F.format_string("%s %s %s [%s @ %,.2f EGP] -%,.2f", F.date_format(li.day, "dd/MM/yyyy"), F.when(li.sell, "بيع").otherwise("Buy"), name, shares, li.unit * F.when(li.l_linenumber == 5, 2).otherwise(1), li.l_extendedprice)

    return _per_order(s, d, line, "Account statement\n")


def _statements(s, d):
    r = D.statement_rows(_statement_docs(s, d))
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"), F.sum(F.floor(F.col("price") * 100 + 0.5)).cast("bigint").alias("price_cents"), F.count_if(F.col("side") == "SELL").alias("n_sell"), F.max("day").alias("last_day"))


def _names(s, d):
    """Company names as documents have them: whole, with a legal form or a bracket, cut, misspelt, unknown."""
    p = _t(s, d, "part").select(F.upper("p_name").alias("n"), (F.col("p_partkey") % 6).alias("k"))
    return p.select(
        F.when(F.col("k") == 0, F.col("n")).when(F.col("k") == 1, F.concat("n", F.lit(", Co."))).when(F.col("k") == 2, F.concat("n", F.lit(" [RE4]"))).when(F.col("k") == 3, F.concat("n", F.lit(" TRADING")))
        .when(F.col("k") == 4, F.concat(F.substring("n", 1, 2), F.lit("#"), F.expr("substring(n, 4)"))).otherwise(F.concat(F.reverse("n"), F.lit(" FOR MARBLE"))).alias("name")
    ).distinct()


def _invoice_docs(s, d):
    p = _parts(s, d)
    text = F.format_string(
        "Tax Invoice %s Security Name Symbol Code Transaction Type Average Cost %s EGS%06dC01 %s %,.2f EGP Total Quantity Average Price Total Cost %,d %s EGP %,.2f EGP Total Fees %,.2f EGP Transaction No. ref %s",
        F.format_string("%02d-%02d-2026", (F.col("p_partkey") % 28 + 1).cast("int"), (F.col("p_partkey") % 12 + 1).cast("int")), F.col("p_name"), F.col("p_partkey").cast("int"), F.when(F.col("p_partkey") % 3 == 0, "Sell").otherwise("Buy"), F.col("p_retailprice"),
        (F.col("p_size") * 100).cast("int"), F.when(F.col("p_partkey") % 4 == 0, "0").otherwise(F.format_string("%,.2f", "p_retailprice")), F.col("p_retailprice") * F.col("p_size") * 100, F.col("p_size").cast("double"), F.format_string("B%07d", F.col("p_partkey").cast("int")),
    )
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def _invoices(s, d):
    return D.invoices(_invoice_docs(s, d)).select("doc_id", "name", "side", "shares", F.floor(F.col("price") * 100 + 0.5).cast("bigint").alias("price_cents"), "fees", "day", "number")


def _screen_docs(s, d):
    def line(li):
        status = F.when(li.l_linenumber == 2, "Cancelled").when(li.l_linenumber == 6, "").otherwise("Fulfilled")
        return F.format_string("%s %d shares @ EGP %,.2f %s, %s %s", F.when(li.sell, "Sell").otherwise("Buy"), li.l_quantity.cast("int"), li.unit, _words(li.day), F.format_string("%d:%02d PM", (li.l_linenumber).cast("int"), (li.l_linenumber * 7).cast("int")), status)

    one = _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_partkey").alias("p_partkey")).join(_t(s, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return _per_order(s, d, line).join(one, "doc_id").select("doc_id", F.concat_ws("\n", F.upper("p_name"), "text").alias("text"))


def _screens(s, d):
    r = D.orders_screen(_screen_docs(s, d), _dictionary(s, d))
    return r.groupBy("doc_id", "ticker", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"), F.sum(F.floor(F.col("price") * 100 + 0.5)).cast("bigint").alias("price_cents"), F.max("day").alias("last_day"), F.max("time").alias("last_time"))


def _timeline(s, d):
    docs = _per_order(s, d, lambda li: F.format_string("%s %s Limit @ %,.2f %,.2f %s +3.10%%", li.code, F.when(li.sell, "Sell").otherwise("Buy"), li.unit, li.unit * li.l_quantity.cast("int"), F.when(li.l_linenumber == 2, "Cancelled").when(li.l_linenumber == 3, "Pending").otherwise("Fulfilled")), "Orders\n")
    r = D.orders_timeline(docs)
    return r.groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").cast("bigint").alias("shares"), F.sum(F.floor(F.col("total") * 100 + 0.5)).cast("bigint").alias("total_cents"), F.count_if(F.col("side") == "SELL").alias("n_sell"), F.min("ticker").alias("first_ticker"), F.max("ticker").alias("last_ticker"))


def _transactions(s, d):
    docs = _per_order(s, d, lambda li: F.format_string("%s %s %s 0%d:15 AM %s%,.2f EGP", F.when(li.sell, "Sell").otherwise("Buy"), li.code, _words(li.day), li.l_linenumber.cast("int"), F.when(li.sell, "+").otherwise("-"), li.l_extendedprice), "Transactions\n")
    r = D.transactions(docs)
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("total") * 100 + 0.5)).cast("bigint").alias("total_cents"), F.count_if(F.col("side") == "SELL").alias("n_sell"), F.min("ticker").alias("first_ticker"), F.max("day").alias("last_day"), F.max("time").alias("last_time"))


def _details(s, d):
    p = _parts(s, d)
    text = F.format_string("%s Order Details Order State: %s Order Type: Market %s Price EGP %,.2f Quantity: %d shares Expiry Type Day", F.upper("p_name"), F.when(F.col("p_partkey") % 5 == 0, "Cancelled").when(F.col("p_partkey") % 5 == 1, "Pending").otherwise("Fulfilled"), F.when(F.col("p_partkey") % 3 == 0, "Sell").otherwise("Buy"), F.col("p_retailprice"), F.col("p_size").cast("int"))
    return D.order_details(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")), _dictionary(s, d)).withColumn("total", F.floor(F.col("total") * 100 + 0.5).cast("bigint"))


def _position_docs(s, d):
    p = _parts(s, d)
    value = F.col("p_retailprice") * F.col("p_size") * F.when(F.col("p_partkey") % 4 == 0, 2).otherwise(1)
    paid = F.transform(F.sequence(F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int")), lambda i: F.format_string("%d Mar 20%d EGP %,.2f", i, (F.lit(20) + i).cast("int"), (F.col("p_size") * i).cast("double")))
    text = F.format_string("%s My Current Position Units Average Cost Purchase Value %s %,.2f %,.2f Earned Cash Dividends %s", F.upper("p_name"), F.translate(F.col("p_size").cast("string"), "0", "O"), F.col("p_retailprice"), value, F.array_join(paid, " "))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


QUERIES = {
    "statement_rows": _statements,
    "name_resolution": lambda s, d: D.resolve_names(_names(s, d), _dictionary(s, d)),
    "invoice_fields": _invoices,
    "orders_screen": _screens,
    "screen_quality": lambda s, d: D.screen_quality(_screen_docs(s, d)),
    "orders_timeline": _timeline,
    "transaction_list": _transactions,
    "order_details": _details,
    "position_screens": lambda s, d: D.position_screens(_position_docs(s, d), _dictionary(s, d)),
    "dividend_rows": lambda s, d: D.dividend_rows(_position_docs(s, d)),
}

_LI = """WITH l AS (SELECT *, CAST(l_shipdate AS DATE) AS day, l_returnflag = 'R' AS sell, CAST(floor(l_extendedprice / l_quantity) + 0.25 AS DOUBLE) AS unit, upper(substr(p_name, 1, 2)) || upper(substr(string_split(p_name, ' ')[2], 1, 2)) AS code FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
_DICT = """dict AS (SELECT DISTINCT upper(p_name) AS key, upper(substr(p_name, 1, 2)) || upper(substr(string_split(p_name, ' ')[2], 1, 2)) AS ticker FROM part)"""
_HEAD = "(SELECT upper(substr(p_name, 1, 2)) || upper(substr(string_split(p_name, ' ')[2], 1, 2)))"
_CENT = lambda x: f"CAST(floor({x} * 100 + 0.5) AS BIGINT)"

ORACLES = {
    "statement_rows": _LI + f"""SELECT l_orderkey AS doc_id, count(*) AS n, sum(l_quantity) AS shares, CAST(sum(CASE WHEN abs(l_extendedprice / l_quantity - st) / st <= 0.25 THEN {_CENT('l_extendedprice / l_quantity')} ELSE {_CENT('st')} END) AS BIGINT) AS price_cents,
  count(*) FILTER (sell) AS n_sell, max(strftime(day, '%Y-%m-%d')) AS last_day FROM (SELECT *, unit * CASE WHEN l_linenumber = 5 THEN 2 ELSE 1 END AS st FROM l) GROUP BY 1""",
    "name_resolution": f"""WITH {_DICT}, nm AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN n WHEN 1 THEN n || ', Co.' WHEN 2 THEN n || ' [RE4]' WHEN 3 THEN n || ' TRADING' WHEN 4 THEN substr(n, 1, 2) || '#' || substr(n, 4) ELSE reverse(n) || ' FOR MARBLE' END AS name FROM (SELECT p_partkey, upper(p_name) AS n FROM part)),
k AS (SELECT name, trim(regexp_replace(regexp_replace(upper(name), '[.,]', '', 'g'), '\\b(LTD|CO|SAE|PLC|CORP|COMPANY)\\b', '', 'g')) AS raw FROM nm), b AS (SELECT *, trim(regexp_replace(raw, '\\s*\\[[^\\[\\]]{{1,20}}\\]\\s*$', '')) AS k FROM k),
j AS (SELECT name, b.k, d.key, d.ticker, CASE WHEN raw = d.key THEN 0 WHEN b.k = d.key THEN 1 WHEN starts_with(b.k, d.key) OR starts_with(d.key, b.k) THEN 2 WHEN length(b.k) >= length(d.key) * 0.7 AND levenshtein(substr(b.k, 1, length(d.key)), d.key) <= greatest(2, floor(length(d.key) * 0.15)) THEN 3 END AS step FROM b CROSS JOIN dict d)
SELECT name, CASE WHEN min(step) IS NULL THEN any_value(k) ELSE arg_min(ticker, (step, key)) FILTER (step IS NOT NULL) END AS ticker, CASE WHEN min(step) IS NULL THEN 'low' WHEN min(step) < 2 THEN 'high' ELSE 'medium' END AS confidence FROM j GROUP BY 1""",
    "invoice_fields": f"""SELECT p_partkey AS doc_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, p_size * 100.0::DOUBLE AS shares, {_CENT('p_retailprice')} AS price_cents, CAST(p_size AS DOUBLE) AS fees,
  printf('2026-%02d-%02d', p_partkey % 12 + 1, p_partkey % 28 + 1) AS day, printf('B%07d', p_partkey) AS number FROM part""",
    "orders_screen": _LI.rstrip() + f""", h AS (SELECT l_orderkey, arg_min(code, l_partkey) AS ticker FROM l GROUP BY 1)
SELECT l_orderkey AS doc_id, ticker, 'medium' AS confidence, count(*) AS n, sum(l_quantity) AS shares, CAST(sum({_CENT('unit')}) AS BIGINT) AS price_cents, max(strftime(day, '%Y-%m-%d')) AS last_day, max(printf('%d:%02dPM', l_linenumber, l_linenumber * 7)) AS last_time
FROM l JOIN h USING (l_orderkey) WHERE l_linenumber NOT IN (2, 6) GROUP BY 1, 2""",
    "screen_quality": _LI + """SELECT l_orderkey AS doc_id, count(*) FILTER (l_linenumber NOT IN (2, 6)) AS n_candidates, count(*) FILTER (l_linenumber = 6) AS n_incomplete, CAST(count(*) FILTER (l_linenumber NOT IN (2, 6)) AS INTEGER) AS n_fulfilled, count(*) FILTER (l_linenumber = 6) > 0 AS mismatch,
  count(*) FILTER (l_linenumber = 6) + CASE WHEN count(*) FILTER (l_linenumber = 6) > 0 THEN 1 ELSE 0 END AS problems FROM l GROUP BY 1""",
    "orders_timeline": _LI + f"""SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber = 2 THEN 'cancelled' ELSE 'fulfilled' END AS status, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS shares, CAST(sum({_CENT('unit * l_quantity')}) AS BIGINT) AS total_cents, count(*) FILTER (sell) AS n_sell, min(code) AS first_ticker, max(code) AS last_ticker
FROM l WHERE l_linenumber <> 3 GROUP BY 1, 2""",
    "transaction_list": _LI + f"SELECT l_orderkey AS doc_id, count(*) AS n, CAST(sum({_CENT('l_extendedprice')}) AS BIGINT) AS total_cents, count(*) FILTER (sell) AS n_sell, min(code) AS first_ticker, max(strftime(day, '%Y-%m-%d')) AS last_day, max(printf('0%d:15AM', l_linenumber)) AS last_time FROM l GROUP BY 1",
    "order_details": f"""SELECT p_partkey AS doc_id, {_HEAD} AS ticker, CASE WHEN p_partkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, 'market' AS order_type, CAST(p_size AS DOUBLE) AS shares, p_retailprice AS price, {_CENT('floor(p_size * p_retailprice * 100 + 0.5) / 100.0::DOUBLE')} AS total,
  CASE WHEN p_partkey % 5 = 0 THEN 'cancelled' ELSE 'fulfilled' END AS status FROM part WHERE p_partkey % 5 <> 1""",
    "position_screens": f"SELECT p_partkey AS doc_id, {_HEAD} AS ticker, CAST(p_size AS DOUBLE) AS units, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS avg_cost FROM part",
    "dividend_rows": "SELECT p_partkey AS doc_id, CAST(i - 1 AS INTEGER) AS pos, printf('20%d-03-%02d', 20 + i, i) AS day, CAST(p_size * i AS DOUBLE) AS amount FROM (SELECT *, unnest(range(1, p_partkey % 3 + 2)) AS i FROM part)",
}
