"""Import review queries over the adapters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports as I
from ..operators import resolve as R
from ..operators import verification as V
from ..sources import adapters as S
from .oracle import ENTRIES, with_
from .verification_queries import _C, _FLAGS
from .verification_queries import _entries as _flagged


def _e(s, d):
    return S.entries(s, d).withColumn("seq", F.struct("l_orderkey", "id"))


def _ledger(s, d):
    """Rows of odd orders are on the ledger; prices of every fifth read a little off."""
    return _e(s, d).filter("l_orderkey % 2 = 1").withColumn("price", F.col("price") * F.when(F.col("l_orderkey") % 5 == 0, 1.004).otherwise(1.0))


def _candidates(s, d):
    return _e(s, d).filter("l_orderkey % 2 = 0")


def _groups(s, d):
    a = _ledger(s, d).filter("kind = 'SellExecution'")
    return I.sell_groups(a.select(*I.TICKER, "id", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).alias("sell_group_id"), "execution_date", F.col("price").alias("exit_price"), "minutes", "number", "shares"))


def _resolved(s, d):
    return I.resolved_candidates(_candidates(s, d), _ledger(s, d).filter("kind = 'BuyExecution'"), _groups(s, d))


def _counted(df, *more):
    """Ids counted and summed, so that results stay small."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), *more)


def _sales(s, d):
    return _e(s, d).filter("kind = 'SellExecution'").withColumn("source", V.source_of())


def _claims(s, d):
    sales = _sales(s, d)
    req = sales.filter("l_linenumber < 3").select(F.col("id").alias("request"), *I.TICKER, "execution_date", "shares", "price", "minutes").dropDuplicates(["request"])
    return I.unclaimed_sells(sales, sales.filter("l_orderkey % 3 = 0").select(F.col("id").alias("sell_id")), req)


def _misclaimed(s, d):
    sales = _sales(s, d).withColumn("source", F.when(F.col("source") == "~", "manual").otherwise(F.col("source"))).withColumn("price", F.lit(1.0)).withColumn("shares", F.lit(10))
    return I.misclaimed(sales, sales.filter("source = 'manual' OR l_orderkey % 4 = 0").select(F.concat(F.lit("d"), "id").alias("decision_id"), F.col("id").alias("sell_id")).distinct())


def _labels(s, d):
    f = _e(s, d).withColumn("source", F.coalesce("source", F.lit("backfill"))).withColumn("retracted", F.col("l_orderkey") % 7 == 0)
    return I.group_labels(f, _ledger(s, d).filter("kind = 'BuyExecution'"))


def _preserved(s, d):
    e = _e(s, d)
    event = lambda df: df.select(*I.TICKER, F.col("id").alias("event_id"), F.array(F.col("id"), F.concat(F.lit("x"), (F.col("l_orderkey") % 10).cast("string"))).alias("sources")).distinct()
    live = e.filter("l_orderkey % 97 <> 0").select("id").unionByName(s.range(9).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("id")))
    terminal = e.filter("ticker_id % 3 = 0").select(*I.TICKER).distinct()
    return I.preserved(event(e.filter("l_linenumber < 5")), event(e.filter("l_linenumber > 2")), live, terminal, I.TICKER).groupBy(*I.TICKER).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def _lessons(s, d):
    j = S.journal(s, d).select("trade_id", F.when(F.col("trade_id") % 2 == 0, F.element_at("tags", 1)).alias("lesson"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("trade_id") % 30 + F.col("ord")).cast("int")).alias("written_on")).filter("trade_id % 4 < 3")
    return I.lessons(j.groupBy("trade_id").agg(F.max_by("lesson", "written_on").alias("lesson"), F.max("written_on").alias("written_on")), S.trades(s, d))


QUERIES = {
    "sell_groups": lambda s, d: _groups(s, d).groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("total_shares").alias("shares"), F.sum("n").alias("n"), F.min("group").alias("first_group"), F.max("group").alias("last_group")),
    "sell_differences": lambda s, d: R.sell_differences(_candidates(s, d).filter("kind = 'SellExecution'").dropDuplicates(["id"]), _groups(s, d)).groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")),
    "raised_confidence": lambda s, d: I.raised_confidence(_flagged(s, d)).groupBy("portfolio_id", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("raised").alias("n_raised")),
    "already_allocated": lambda s, d: _counted(I.already_allocated(_candidates(s, d).filter("kind = 'SellExecution'").dropDuplicates(["id"]), _groups(s, d)).filter("allocated > 0"), F.sum("allocated").alias("allocated")),
    "resolved_candidates": lambda s, d: _counted(_resolved(s, d)),
    "reuploads": lambda s, d: _counted(I.reuploads(_e(s, d), _e(s, d).filter("l_orderkey % 4 = 1").select("id").distinct())),
    "unclaimed_sells": _claims,
    "misclaimed_sells": _misclaimed,
    "group_labels": lambda s, d: _labels(s, d).select("portfolio_id", F.explode("labels").alias("label")).groupBy("portfolio_id", "label").agg(F.count(F.lit(1)).alias("n")),
    "label_summary": lambda s, d: I.label_summary(_labels(s, d)),
    "import_groups": lambda s, d: I.import_groups({"buys": _e(s, d).filter("kind = 'BuyExecution'"), "sells": _e(s, d).filter("kind = 'SellExecution'"), "verifications": S.counted_units(s, d), "dividends": _e(s, d).filter("l_linenumber = 6"), "evidence": _e(s, d).filter("source = 'orders-screen'")}),
    "pending_duplicates": lambda s, d: _counted(I.pending_duplicates(_flagged(s, d).filter("duplicate"), _resolved(s, d), _e(s, d).filter("l_orderkey % 6 = 0"))),
    "preserved_events": _preserved,
    "applied_rebuild": lambda s, d: I.applied_rebuild(_e(s, d).select("id", F.when(F.col("l_orderkey") % 3 > 0, F.col("portfolio_id")).alias("portfolio")), _e(s, d).select("id", (F.col("l_orderkey") % 5 > 0).alias("known"), (F.col("l_linenumber") == 2).alias("blocked")), _e(s, d).select("id", F.when(F.col("l_linenumber") < 4, F.array(F.lit("companyName"))).otherwise(F.array(F.lit("transactionNumber"), F.lit("price"))).alias("fields"))).groupBy("what", "applied", "reason").agg(F.count(F.lit(1)).alias("n")),
    "journal_lessons": _lessons,
    "stale_prices": lambda s, d: I.stale_prices(S.table(s, d, "events").select(F.col("user_id").alias("ticker"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("quoted_at")), "2024-01-12").groupBy("ticker").agg(F.count_if("stale").alias("n_stale"), F.count_if(~F.col("stale")).alias("n_fresh")),
}

_L = """ld AS (SELECT * REPLACE (price * CASE WHEN l_orderkey % 5 = 0 THEN 1.004::DOUBLE ELSE 1.0::DOUBLE END AS price) FROM v_entries WHERE l_orderkey % 2 = 1), cd AS (SELECT * FROM v_entries WHERE l_orderkey % 2 = 0),
sl AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_orderkey AS VARCHAR) ELSE concat('legacy:', execution_date, '|', CAST(floor(price * 10000.0 + 0.5) AS BIGINT), '|', coalesce(minutes, -1)) END AS gk FROM ld WHERE kind = 'SellExecution'),
gr AS (SELECT portfolio_id, ticker_id, gk, min(id) AS grp, CAST(sum(shares) AS BIGINT) AS t, count(*) AS n, arg_min(price, id) AS p, arg_min(execution_date, id) AS d, arg_min(coalesce(minutes, 0), id) AS m, arg_min(coalesce(number, ''), id) AS no FROM sl GROUP BY 1, 2, 3)"""
_AC = "NOT coalesce(nullif(c.minutes, 0) <> nullif(g.m, 0), false) AND abs(g.p - c.price) <= greatest(0.0001, c.price * 0.01)"
_RS = f"""rs AS (SELECT c.id FROM cd c JOIN ld t ON t.kind = 'BuyExecution' AND c.portfolio_id = t.portfolio_id AND c.ticker_id = t.ticker_id AND c.number = t.number WHERE c.kind = 'BuyExecution'
  UNION SELECT c.id FROM cd c JOIN ld t ON t.kind = 'BuyExecution' AND c.portfolio_id = t.portfolio_id AND c.ticker_id = t.ticker_id AND c.execution_date = t.execution_date AND c.shares = t.shares AND floor(c.price * 10000.0 + 0.5) = floor(t.price * 10000.0 + 0.5)
    WHERE c.kind = 'BuyExecution' AND NOT coalesce(nullif(c.minutes, 0) <> nullif(t.minutes, 0), false) AND NOT coalesce(c.number <> t.number, false)
  UNION SELECT id FROM (SELECT c.id, c.rid, c.shares, sum(t) AS q FROM cd c JOIN gr g ON c.portfolio_id = g.portfolio_id AND c.ticker_id = g.ticker_id AND CASE WHEN c.number IS NOT NULL THEN c.number = g.no ELSE c.execution_date = g.d AND {_AC} END WHERE c.kind = 'SellExecution' GROUP BY ALL) WHERE q >= shares)"""
_CNT = "count(*) AS n, count(DISTINCT id) AS n_ids, min(id) AS first_id, max(id) AS last_id"
_LB = f"""lf AS (SELECT *, coalesce(source, 'backfill') AS src, l_orderkey % 7 = 0 AS ret, CASE coalesce(source, 'backfill') WHEN 'invoice' THEN 6 WHEN 'official-broker-excel' THEN 5 WHEN 'statement' THEN 4 WHEN 'orders-screen' THEN 3 WHEN 'csv' THEN 1 ELSE 0 END AS rk FROM v_entries),
lm AS (SELECT *, max(rk) FILTER (NOT ret) OVER (PARTITION BY {_C}, price) AS top FROM lf),
lg AS (SELECT {_C}, price, count(*) FILTER (NOT ret) AS nl, count(*) FILTER (ret) AS nr, max(top) AS top, min(rk) FILTER (NOT ret) AS low, max(rk) FILTER (ret) AS gone, count(DISTINCT nullif(minutes, 0)) AS times, bool_or(NOT ret AND src = 'backfill') AS bf, count(*) FILTER (NOT ret AND rk = top) AS nt FROM lm GROUP BY ALL),
lt AS (SELECT {_C}, price, count(*) AS k FROM ld WHERE kind = 'BuyExecution' GROUP BY ALL HAVING count(*) >= 2),
lx AS (SELECT lg.*, nl <= 1 AS single, nl = 1 AND bf AS orphan, nl > 1 AND low < top AS dup, nl > 1 AND nt > 1 AS tie, nl > 1 AND kind = 'BuyExecution' AND k IS NOT NULL AS many, nl > 1 AND times > 1 AS conf, coalesce(nl > 0 AND gone > top, false) AS higher FROM lg LEFT JOIN lt USING ({_C}, price))"""

ORACLES = {
    "sell_groups": with_(ENTRIES, _L) + "SELECT portfolio_id, count(*) AS n_groups, CAST(sum(t) AS BIGINT) AS shares, CAST(sum(n) AS BIGINT) AS n, min(grp) AS first_group, max(grp) AS last_group FROM gr GROUP BY 1",
    "sell_differences": with_(ENTRIES, _L).rstrip() + """, cs AS (SELECT * FROM cd WHERE kind = 'SellExecution' QUALIFY row_number() OVER (PARTITION BY id ORDER BY rid) = 1),
bn AS (SELECT c.id, min(grp) AS m FROM cs c JOIN gr g ON c.portfolio_id = g.portfolio_id AND c.ticker_id = g.ticker_id AND c.number = g.no GROUP BY 1),
j AS (SELECT c.id, grp AS m, CASE WHEN floor(c.price * 10000.0 + 0.5) = floor(g.p * 10000.0 + 0.5) THEN 1 ELSE 2 END AS k, CASE WHEN floor(c.price * 10000.0 + 0.5) = floor(g.p * 10000.0 + 0.5) THEN 0 ELSE abs(c.price - g.p) END AS dd FROM cs c JOIN gr g ON c.portfolio_id = g.portfolio_id AND c.ticker_id = g.ticker_id AND c.execution_date = g.d AND c.shares = g.t
  WHERE NOT coalesce(nullif(c.minutes, 0) <> nullif(g.m, 0), false) AND NOT coalesce(c.number <> nullif(g.no, ''), false)), b AS (SELECT id, m FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, dd, m) = 1),
mt AS (SELECT id, coalesce(bn.m, b.m) AS m FROM bn FULL JOIN b USING (id)),
o AS (SELECT 'add' AS what, id FROM cs WHERE id NOT IN (SELECT id FROM mt) UNION ALL SELECT 'modify', c.id FROM mt JOIN cs c USING (id) JOIN gr g ON g.grp = mt.m WHERE abs(c.price - g.p) > greatest(c.price, g.p) * 0.01 UNION ALL SELECT 'extraneous', grp FROM gr WHERE grp NOT IN (SELECT m FROM mt))
SELECT what, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM o GROUP BY 1""",
    "raised_confidence": with_(ENTRIES, _FLAGS) + "SELECT portfolio_id, CASE WHEN c THEN 'high' ELSE confidence END AS confidence, count(*) AS n, count(*) FILTER (c AND confidence <> 'high') AS n_raised FROM e GROUP BY 1, 2",
    "already_allocated": with_(ENTRIES, _L).rstrip() + f""", cs AS (SELECT * FROM cd WHERE kind = 'SellExecution' QUALIFY row_number() OVER (PARTITION BY id ORDER BY rid) = 1),
bn AS (SELECT c.id, arg_min(t, grp) AS t FROM cs c JOIN gr g ON c.portfolio_id = g.portfolio_id AND c.ticker_id = g.ticker_id AND c.number = g.no GROUP BY 1), ft AS (SELECT c.id, count(*) AS k, min(t) AS t FROM cs c JOIN gr g ON c.portfolio_id = g.portfolio_id AND c.ticker_id = g.ticker_id AND c.execution_date = g.d AND {_AC} GROUP BY 1),
al AS (SELECT id, least(shares, coalesce(bn.t, CASE WHEN k = 1 THEN ft.t END, 0)) AS allocated FROM cs LEFT JOIN bn USING (id) LEFT JOIN ft USING (id)) SELECT {_CNT}, CAST(sum(allocated) AS BIGINT) AS allocated FROM al WHERE allocated > 0""",
    "resolved_candidates": with_(ENTRIES, _L, _RS) + f"SELECT {_CNT} FROM rs",
    "reuploads": with_(ENTRIES).rstrip() + f""", o AS (SELECT *, floor(price * 10000.0 + 0.5) AS p4 FROM v_entries WHERE source = 'official-broker-excel' AND minutes IS NOT NULL), r AS (SELECT * FROM o WHERE l_orderkey % 4 = 1)
SELECT {_CNT} FROM o c WHERE l_orderkey % 4 <> 1 AND EXISTS (SELECT 1 FROM r WHERE r.portfolio_id = c.portfolio_id AND r.ticker_id = c.ticker_id AND r.kind = c.kind AND r.execution_date = c.execution_date AND r.shares = c.shares AND r.p4 = c.p4 AND NOT coalesce(nullif(r.minutes, 0) <> nullif(c.minutes, 0), false))""",
    "unclaimed_sells": with_(ENTRIES).rstrip() + """, s AS (SELECT * FROM v_entries WHERE kind = 'SellExecution'), q AS (SELECT * FROM s WHERE l_linenumber < 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY rid) = 1)
SELECT q.id AS request, arg_min(s.id, (coalesce(nullif(q.minutes, 0) <> nullif(s.minutes, 0), false), s.l_orderkey, s.id)) AS fact_id FROM q JOIN s ON q.portfolio_id = s.portfolio_id AND q.ticker_id = s.ticker_id AND q.execution_date = s.execution_date AND q.shares = s.shares AND q.price = s.price
WHERE s.id NOT IN (SELECT id FROM s WHERE l_orderkey % 3 = 0) GROUP BY 1""",
    "misclaimed_sells": with_(ENTRIES).rstrip() + """, s AS (SELECT *, coalesce(source, 'manual') AS src FROM v_entries WHERE kind = 'SellExecution'), dc AS (SELECT DISTINCT id FROM s WHERE src = 'manual' OR l_orderkey % 4 = 0),
b AS (SELECT m.id AS wrong_id, arg_min(f.id, (coalesce(nullif(m.minutes, 0) <> nullif(f.minutes, 0), false), f.l_orderkey, f.id)) AS right_id FROM s m JOIN s f ON m.portfolio_id = f.portfolio_id AND m.ticker_id = f.ticker_id AND m.execution_date = f.execution_date
  WHERE m.src = 'manual' AND f.id NOT IN (SELECT id FROM dc) GROUP BY 1) SELECT concat('d', wrong_id) AS decision_id, wrong_id, right_id FROM b JOIN s ON s.id = right_id WHERE s.src <> 'manual'""",
    "group_labels": with_(ENTRIES, _L, _LB) + """SELECT portfolio_id, label, count(*) AS n FROM (SELECT portfolio_id, unnest(list_filter([CASE WHEN single THEN 'singleton group' END, CASE WHEN orphan THEN 'orphaned backfill' END, CASE WHEN dup THEN 'duplicate-authority group' END, CASE WHEN tie THEN 'skipped: tie' END,
  CASE WHEN many THEN 'skipped: multiple live Trades' END, CASE WHEN conf THEN 'skipped: conflicting execution time' END, CASE WHEN higher THEN 'matching retracted higher-authority fact' END], lambda x: x IS NOT NULL)) AS label FROM lx) GROUP BY 1, 2""",
    "label_summary": with_(ENTRIES, _L, _LB) + "SELECT portfolio_id, ticker_id, CAST(sum(nl) AS BIGINT) AS n_live, CAST(sum(nr) AS BIGINT) AS n_retracted, count(*) AS n_groups, count(*) FILTER (single) AS n_singleton, count(*) FILTER (dup) AS n_duplicate_authority, count(*) FILTER (orphan) AS n_orphaned_backfill, count(*) FILTER (higher) AS n_retracted_higher FROM lx GROUP BY 1, 2",
    "import_groups": with_(ENTRIES) + """SELECT portfolio_id, ticker_id, count(*) FILTER (kind = 'BuyExecution') AS n_buys, count(*) FILTER (kind = 'SellExecution') AS n_sells, CAST(any_value((ticker_id + portfolio_id) % 3 <> 0) AS BIGINT) AS n_verifications, count(*) FILTER (l_linenumber = 6) AS n_dividends, count(*) FILTER (source = 'orders-screen') AS n_evidence FROM v_entries GROUP BY 1, 2""",
    "pending_duplicates": with_(ENTRIES, _FLAGS, _L, _RS) + f"SELECT {_CNT} FROM (SELECT id FROM e WHERE u UNION SELECT id FROM rs) WHERE id NOT IN (SELECT id FROM v_entries WHERE l_orderkey % 6 = 0)",
    "preserved_events": with_(ENTRIES).rstrip() + """, fr AS (SELECT DISTINCT portfolio_id, ticker_id, id FROM v_entries WHERE l_linenumber < 5), pv AS (SELECT DISTINCT portfolio_id, ticker_id, id, l_orderkey FROM v_entries WHERE l_linenumber > 2),
lo AS (SELECT DISTINCT portfolio_id, ticker_id FROM pv WHERE l_orderkey % 97 = 0 OR l_orderkey % 10 = 9), kp AS (SELECT portfolio_id, ticker_id, id FROM pv WHERE ticker_id % 3 <> 0 AND (portfolio_id, ticker_id) NOT IN (SELECT (portfolio_id, ticker_id) FROM lo) AND (portfolio_id, ticker_id, id) NOT IN (SELECT (portfolio_id, ticker_id, id) FROM fr))
SELECT portfolio_id, ticker_id, count(*) AS n, min(id) AS first_id FROM (SELECT * FROM fr UNION ALL SELECT * FROM kp) GROUP BY 1, 2""",
    "applied_rebuild": with_(ENTRIES) + """SELECT what, applied, reason, count(*) AS n FROM (SELECT 'add' AS what, l_orderkey % 3 > 0 AS applied, CASE WHEN l_orderkey % 3 = 0 THEN 'no portfolio' END AS reason FROM v_entries
  UNION ALL SELECT 'remove', l_orderkey % 5 > 0 AND l_linenumber <> 2, CASE WHEN l_orderkey % 5 = 0 OR l_linenumber = 2 THEN 'shares are sold against it' END FROM v_entries UNION ALL SELECT 'modify', l_linenumber < 4, CASE WHEN l_linenumber >= 4 THEN 'touches price, fees, taxes or time' END FROM v_entries) GROUP BY 1, 2, 3""",
    "journal_lessons": """SELECT p_partkey AS trade_id, lower(p_type) AS lesson, CAST(DATE '2026-01-01' + CAST(p_partkey % 30 + 2 AS INTEGER) AS DATE) AS written_on, upper(p_brand) AS ticker, p_partkey % 8 AS portfolio_id,
  CAST(row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey % 30 DESC, p_partkey) AS INTEGER) AS ord FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 < 3 AND p_partkey % 2 = 0""",
    "stale_prices": "SELECT user_id AS ticker, count(*) FILTER (event_id % 9 = 0 OR CAST(ts AS DATE) < DATE '2024-01-08') AS n_stale, count(*) FILTER (event_id % 9 <> 0 AND CAST(ts AS DATE) >= DATE '2024-01-08') AS n_fresh FROM events GROUP BY 1",
}
