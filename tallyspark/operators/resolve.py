"""Entity resolution and verification: duplicates, corroboration, authority, completeness.

Keys are columns side by side, never numbers joined into text. Where the first of several rows
counts, an explicit order says which is first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import authority, known_time, one_digit_day_apart, round4, within
from ..functions.stable import digest_rows
from ..scratch import durable

CONTENT = ["portfolio_id", "ticker_id", "kind", "execution_date", "shares"]
CANONICAL = [*CONTENT, "price4"]


def with_price4(facts: DataFrame) -> DataFrame:
    return facts.withColumn("price4", F.floor(F.col("price") * 10000 + 0.5).cast("bigint"))


def duplicate_groups(facts: DataFrame) -> DataFrame:
    """Groups of more than one row of the same content, whatever the price."""
    g = facts.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.min(F.floor(F.col("price") * 10000 + 0.5)).cast("bigint").alias("low4"), F.max(F.floor(F.col("price") * 10000 + 0.5)).cast("bigint").alias("high4"))
    return g.filter("n > 1")


def duplicate_matches(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """(id, match_id, match_class): the best match of each candidate among existing rows.

    Class 0: a row of its portfolio, ticker and side with the same transaction number, the first
    by id. Else rows of its key whose known time is no other and whose number, if both have
    one, is no other: class 1, the first with the same price to 4 places, or class 2, the one
    of the closest price. Both sides hold: id, price, minutes, number; ``keys`` hold the ticker's.
    Rows that are alike in price and time count once on both sides, existing ones by their first
    id and the first of those that lack a number, which are all that a row with another number may
    match (equal numbers are class 0). So the pairs of a key follow its different prices and
    times, and never its rows or numbers.
    """
    ticker = ["portfolio_id", "ticker_id", "kind"]
    numbered = candidates.filter("number IS NOT NULL").join(existing.filter("number IS NOT NULL").groupBy(*ticker, "number").agg(F.min("id").alias("e_id")), [*ticker, "number"]).select("id", F.col("e_id").alias("by_number"))
    time, given = known_time("minutes"), F.col("number").isNotNull()
    e = existing.groupBy(*keys, F.col("price").alias("e_price"), time.alias("e_time")).agg(F.min("id").alias("first"), F.min(F.when(~given, F.col("id"))).alias("bare"))
    own = candidates.withColumns({"look": F.struct(F.col("price").alias("p"), time.alias("t"), given.alias("n"))})
    met = own.select(*keys, "look").distinct().join(e, keys).filter(~F.coalesce(F.col("look.t") != F.col("e_time"), F.lit(False)))
    met = met.withColumn("i", F.when(F.col("look.n"), F.col("bare")).otherwise(F.col("first"))).filter("i IS NOT NULL")
    class_ = F.when(round4("look.p") == round4("e_price"), 1).otherwise(2)
    away = F.when(class_ == 1, 0.0).otherwise(F.abs(F.col("look.p") - F.col("e_price")))
    best = met.groupBy(*keys, "look").agg(F.min(F.struct(class_.alias("k"), away.alias("d"), F.col("i"))).alias("m"))
    j = own.select("id", *keys, "look").join(best, [*keys, "look"]).groupBy("id").agg(F.min("m").alias("m"))
    both = numbered.join(j, "id", "full_outer")
    return both.select("id", F.coalesce("by_number", "m.i").alias("match_id"), F.when(F.col("by_number").isNotNull(), 0).otherwise(F.col("m.k")).alias("match_class"))


def sell_differences(canonical: DataFrame, groups: DataFrame) -> DataFrame:
    """(what, id): sales that the ledger lacks (add), those whose group's price is off by more than
    1 % (modify), and groups that no sale matches (extraneous). Sales may match one group.

    ``canonical``: content, id, price, minutes, number; ``groups``: keys, group, total_shares,
    price, day, minutes, number.
    """
    g = groups.select("portfolio_id", "ticker_id", F.lit("SellExecution").alias("kind"), F.col("day").alias("execution_date"), F.col("total_shares").alias("shares"), F.col("group").alias("id"), "price", "minutes", "number")
    m = duplicate_matches(canonical, g, CONTENT)
    priced = m.join(canonical.select("id", "price"), "id").join(g.select(F.col("id").alias("match_id"), F.col("price").alias("g_price")), "match_id")
    out = canonical.join(m, "id", "left_anti").select(F.lit("add").alias("what"), "id").unionByName(priced.filter(~within("price", "g_price", 0.01)).select(F.lit("modify").alias("what"), "id"))
    return out.unionByName(g.join(m.select(F.col("match_id").alias("id")), "id", "left_anti").select(F.lit("extraneous").alias("what"), "id"))


def authority_winner(facts: DataFrame) -> DataFrame:
    """Of each content key the highest authority and how many rows are below it; ties stay."""
    f = facts.withColumn("rank", authority("source"))
    by_rank = f.groupBy(*CONTENT, "rank").agg(F.count(F.lit(1)).alias("k"))
    g = by_rank.groupBy(*CONTENT).agg(F.max("rank").alias("top_rank"), F.sum("k").alias("n"), F.max_by("k", "rank").alias("n_top"))
    return g.filter("n > 1").select(*CONTENT, F.col("top_rank").cast("int").alias("top_rank"), "n", (F.col("n") - F.col("n_top")).alias("n_superseded"))


def official_suppression(facts: DataFrame) -> DataFrame:
    """Rows of other sources on a kind, ticker and day that an official row covers."""
    days = ["portfolio_id", "kind", "ticker_id", "execution_date"]
    official = facts.filter("source = 'official-broker-excel'").select(*days).distinct()
    return facts.filter("source <> 'official-broker-excel'").join(official, days, "left_semi")


def time_clusters(facts: DataFrame) -> DataFrame:
    """Clusters of rows of a content key whose times may be one: an unknown time goes with any
    other, so one such makes the key one cluster; else there is one for each known time."""
    t = known_time("minutes")
    g = facts.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("n"), F.count_if(t.isNull()).alias("n_unknown"), F.count_distinct(t).alias("n_times"))
    return g.filter("n > 1").select(*CONTENT, "n", F.when(F.col("n_unknown") > 0, F.lit(1).cast("bigint")).otherwise(F.col("n_times")).alias("n_clusters"))


def date_misreads(facts: DataFrame, ids: Column) -> DataFrame:
    """(id, other_date, n): rows but official ones that another row of the ticker equals in side,
    shares and price (within 1 %) but for one digit of the day; the first such row's day."""
    keys = ["portfolio_id", "ticker_id", "kind", "shares", "month"]
    f = facts.select("portfolio_id", "ticker_id", "kind", "shares", F.date_trunc("month", "execution_date").alias("month"), "execution_date", "price", "source", ids.alias("id"))
    rows = f.groupBy(*keys, F.col("execution_date").alias("other_date"), F.col("price").alias("other_price")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k"))
    j = f.filter("source <> 'official-broker-excel'").join(rows, keys)
    j = j.filter(one_digit_day_apart("execution_date", "other_date") & within("price", "other_price", 0.01))
    return j.groupBy("id").agg(F.min_by("other_date", "first").alias("other_date"), F.sum("k").alias("n"))


def _two_best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): the first (i, t) of the keys' rows by i, and the first of another t, null without
    one. Two aggregates, so what is held and joined follows the keys and never their rows."""
    a = durable(rows.groupBy(*keys).agg(F.min(F.struct("i", "t")).alias("a")), "first")
    b = rows.join(a, keys).filter(F.col("t") != F.col("a.t")).groupBy(*keys).agg(F.min(F.struct("i", "t")).alias("b"))
    return durable(a.join(b, keys, "left"), "best")


BINS = 8  # of a share's width; more make fewer pairs of prices


FAR = -1_000_000  # the bin of what isn't above zero


def _bin(x: Column, share: float) -> Column:
    return F.when(x > 0, F.floor(F.log(F.when(x > 0, x)) / (share / BINS)).cast("int")).otherwise(F.lit(FAR))


def _reach(x: Column, share: float) -> Column:
    """The bins that may hold a value within ``share`` of ``x``."""
    return F.when(x > 0, F.sequence(_bin(x * (1 - share), share) - 1, _bin(x / (1 - share), share) + 1)).otherwise(F.array(F.lit(FAR)))


def _mixed_prices(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, price): the prices of each key that have two tickers, their own or within ``share``; never
    one too few, and as any two such prices are near each other, all that an answer there needs.

    The nearest price of another ticker is where the ticker changes in the order of prices, so one
    running value a direction tells whether any is near: no price is paired, and no id is shuffled."""
    p = rows.filter("ticker_id IS NOT NULL AND price IS NOT NULL").groupBy(*keys, "price").agg(F.min("ticker_id").alias("lo"), F.max("ticker_id").alias("hi"))
    wide = share * (1 + 1e-9)  # the comparison that counts follows, and its rounding may differ
    near = F.col("lo") != F.col("hi")
    for name, order in (("below", F.col("price").asc()), ("above", F.col("price").desc())):
        by = Window.partitionBy(*keys).orderBy(order)
        # seen from a price: the last one before it that doesn't have its one ticker alone
        last_lo, last_hi, last = F.lag("lo").over(by), F.lag("hi").over(by), F.lag("price").over(by)
        p = p.withColumn(name, F.when((last_lo != last_hi) | (last_lo != F.col("lo")) | (last_hi != F.col("hi")), last))
        p = p.withColumn(name, F.last(name, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        near = near | F.coalesce(within("price", name, wide), F.lit(False))
    return p.filter(near).select(*keys, "price")


def with_first_other_ticker(rows: DataFrame, id_: str, out: str, share: float, near: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: for a row that isn't of high confidence, the first other ticker (by ``id_``) under
    which its side, day and shares stand at a price within ``share``; else null. ``near``: the rows
    that can give or get an answer (``near_other_tickers``), if these are told beforehand.

    Of each price the two first tickers tell the first that isn't the row's own, and so do the two
    first of all prices near it. Prices lie in bins of equal ratio: a bin wholly within reach counts
    by its own two first, and only prices of the few bins at both ends are paired, so the
    work follows a key's different prices and never its rows or tickers."""
    keys, bin_of = ["portfolio_id", "kind", "execution_date", "shares"], lambda x: _bin(x, share)
    pair = lambda df, *by: df.select(*by, F.explode(F.array_compact(F.array("a", "b"))).alias("x")).select(*by, "x.i", "x.t")
    each = (rows if near is None else near).filter("ticker_id IS NOT NULL AND price IS NOT NULL").select(*keys, "price", F.col(id_).alias("i"), F.col("ticker_id").alias("t"))
    by = Window.partitionBy(*keys, "price")
    each = each.withColumn("a", F.min(F.struct("i", "t")).over(by)).withColumn("b", F.min(F.when(F.col("t") != F.col("a.t"), F.struct("i", "t"))).over(by))
    best = durable(each.groupBy(*keys, "price").agg(F.first("a").alias("a"), F.first("b").alias("b")), "best").withColumn("bin", bin_of(F.col("price")))
    bins = _two_best(pair(best, *keys, "bin"), [*keys, "bin"]).join(best.groupBy(*keys, "bin").agg(F.min("price").alias("low"), F.max("price").alias("high")), [*keys, "bin"])
    met = best.select(*keys, "price", F.explode(_reach(F.col("price"), share)).alias("bin")).join(bins, [*keys, "bin"])
    whole = within("price", "low", share) & within("price", "high", share)
    ends = met.filter(~whole).select(*keys, "bin", "price").join(best.withColumnRenamed("price", "p"), [*keys, "bin"]).filter(within("price", "p", share))
    best = _two_best(pair(met.filter(whole), *keys, "price").unionByName(pair(ends, *keys, "price")), [*keys, "price"])
    other = F.when(F.col("ticker_id") != F.col("a.t"), F.col("a.t")).when(F.col("ticker_id") == F.col("a.t"), F.col("b.t"))
    return rows.join(best, [*keys, "price"], "left").withColumn(out, F.when(F.col("confidence") != "high", other)).drop("a", "b")


def near_other_tickers(rows: DataFrame, share: float) -> DataFrame:
    """The rows whose side, day and shares stand under two tickers at prices within ``share``."""
    keys = ["portfolio_id", "kind", "execution_date", "shares"]
    return rows.join(durable(_mixed_prices(rows, keys, share), "mixed"), [*keys, "price"], "left_semi")


def wrong_tickers(facts: DataFrame, ids: Column) -> DataFrame:
    """(id, suggested_ticker): rows that aren't of high confidence whose side, day and shares stand
    under another ticker at a price within 10 %; the first such row's ticker. Of rows of one id
    the smallest ticker counts."""
    f = facts.select("portfolio_id", "kind", "shares", "execution_date", "ticker_id", "price", "confidence", ids.alias("id"))
    f = near_other_tickers(f, 0.10)
    return with_first_other_ticker(f, "id", "other", 0.10).filter("other IS NOT NULL").groupBy("id").agg(F.min("other").alias("suggested_ticker"))


def order_ticker_hints(entries: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, suggested_ticker): rows that aren't of high confidence, whose own ticker has no order
    that fits while exactly one other ticker has.

    ``evidence``: portfolio_id, ticker_id, kind, shares, price, minutes, day, total (fulfilled
    orders). A dated order fits by day and value within 5 %, an undated one by shares and price.
    """
    look = F.coalesce(F.col("minutes").cast("string"), F.lit("any")).alias("look")
    e = entries.filter("confidence <> 'high'").select("id", "portfolio_id", "ticker_id", "kind", F.col("execution_date").alias("day"), "shares", "price", (F.col("shares") * F.col("price")).alias("total"), look)
    dated, undated = ["portfolio_id", "kind", "day"], ["portfolio_id", "kind", "shares"]
    by_value = _fitting_tickers(e, evidence.filter("day IS NOT NULL"), dated, "total", 0.05).withColumnsRenamed({"lo": "lo_d", "hi": "hi_d"})
    by_price = _fitting_tickers(e, evidence.filter("day IS NULL"), undated, "price", 0.05).withColumnsRenamed({"lo": "lo_u", "hi": "hi_u"})
    e = e.join(by_value, [*dated, "total", "look"], "left").join(by_price, [*undated, "price", "look"], "left").withColumn("lo", F.least("lo_d", "lo_u")).withColumn("hi", F.greatest("hi_d", "hi_u"))
    g = e.filter("lo IS NOT NULL").groupBy("id").agg(F.bool_or(F.col("lo") == F.col("ticker_id")).alias("own"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return g.filter("NOT own AND lo = hi").select("id", F.col("lo").alias("suggested_ticker"))


def _fitting_tickers(e: DataFrame, orders: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, value, look, lo, hi): the smallest and largest ticker of the orders that fit each different
    value and time of the rows; they are one if a single ticker fits. Bins wholly within reach count by
    their own smallest and largest, as in ``with_first_other_ticker``, so rows and orders aren't paired.
    A row of unknown time fits any order (look ``any``), others those of their time or of none."""
    by = [*keys, "time"]
    o = orders.select(*keys, F.col(value).alias("v"), "ticker_id", F.explode(F.array(F.lit("any"), F.coalesce(F.col("minutes").cast("string"), F.lit("none")))).alias("time")).filter("v IS NOT NULL")
    o = durable(o.groupBy(*by, "v").agg(F.min("ticker_id").alias("lo"), F.max("ticker_id").alias("hi")), "orders").withColumn("bin", _bin(F.col("v"), share))
    bins = o.groupBy(*by, "bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("v").alias("low"), F.max("v").alias("high"))
    looks = e.select(*keys, value, "look").distinct()
    looks = looks.select("*", F.explode(F.when(F.col("look") == "any", F.array("look")).otherwise(F.array("look", F.lit("none")))).alias("time"))
    met = durable(looks.withColumn("bin", F.explode(_reach(F.col(value), share))).join(bins, [*by, "bin"]), "met")
    whole = within(value, "low", share) & within(value, "high", share)
    ends = met.filter(~whole).drop("lo", "hi").join(o, [*by, "bin"]).filter(within(value, "v", share))
    out = [*keys, value, "look", "lo", "hi"]
    return met.filter(whole).select(*out).unionByName(ends.select(*out)).groupBy(*keys, value, "look").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def duplicate_dividends(dividends: DataFrame) -> DataFrame:
    """(seq, first_seq, ticker_id, day, cents): all dividends but the first of a ticker, day and
    amount, in whatever portfolio they stand. ``dividends``: seq, ticker_id, ts, amount."""
    keys = ["ticker_id", "day", "cents"]
    d = dividends.select("seq", "ticker_id", F.to_date("ts").alias("day"), F.floor(F.col("amount") * 100 + 0.5).cast("bigint").alias("cents"))
    first = d.groupBy(*keys).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return d.join(first, keys).filter("seq <> first_seq").select("seq", "first_seq", *keys)


def latest_verifications(v: DataFrame) -> DataFrame:
    """The first of the latest captured units of a portfolio and ticker."""
    return v.groupBy("portfolio_id", "ticker_id").agg(F.min_by(F.struct("units", "captured_on"), F.struct((-F.unix_date("captured_on")).alias("d"), F.col("ord"))).alias("v")).select("portfolio_id", "ticker_id", "v.units", "v.captured_on")


def snapshot_hash(facts: DataFrame, fields: list[str], category: str = "kind") -> DataFrame:
    """A digest of each category and one of all ('*'), whatever the order of rows."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in fields])
    own = digest_rows(facts.select(F.col(category).alias("category"), text.alias("item")), ["category"])
    every = own.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "digest"))), lambda x: F.concat_ws("=", x["category"], x["digest"])), ","), 256).alias("digest"))
    return own.unionByName(every.select(F.lit("*").alias("category"), "n", "digest"))


def compare_positions(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of two position tables (shares, cost_micros) and how they differ: within 1e-6
    shares and 0.01 of cost they match."""
    a = left.select(*keys, F.col("shares").alias("shares_a"), F.col("cost_micros").alias("cost_a"))
    b = right.select(*keys, F.col("shares").alias("shares_b"), F.col("cost_micros").alias("cost_b"))
    j = a.join(b, keys, "full_outer")
    case = (
        F.when(F.col("shares_b").isNull(), "only-left").when(F.col("shares_a").isNull(), "only-right").when(F.abs(F.col("shares_a") - F.col("shares_b")) > 1e-6, "shares-differ")
        .when(F.abs(F.col("cost_a") - F.col("cost_b")) > 10_000, "cost-differs").otherwise("match")
    )
    return j.select(*keys, case.alias("result"))
