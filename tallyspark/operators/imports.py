"""Import review: what pending rows match on the ledger, who owns a sale, what a rebuild applies,
how facts of one execution stand to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import authority, known_time, round4
from .resolve import CONTENT

TICKER = ["portfolio_id", "ticker_id"]


def clash(a: str, b: str) -> Column:
    return F.coalesce(known_time(a) != known_time(b), F.lit(False))


def near(price: str, other: str) -> Column:
    """Within 1 % of the candidate's price, 0.0001 at least."""
    return F.abs(F.col(other) - F.col(price)) <= F.greatest(F.lit(0.0001), F.col(price) * 0.01)


def sell_groups(allocations: DataFrame) -> DataFrame:
    """Sales regrouped by their group, or where that is missing by day, price to 4 places and time:
    keys, group, total_shares, and the first row's (by id) price, day, minutes and number.
    Allocations: keys, id, sell_group_id, execution_date, exit_price, minutes, number, shares."""
    named = F.coalesce(F.nullif(F.col("sell_group_id").cast("string"), F.lit("")), F.lit(None).cast("string"))
    legacy = F.struct(F.col("execution_date").alias("d"), round4("exit_price").alias("p"), F.col("minutes").alias("m"))
    g = allocations.withColumn("named", named).withColumn("legacy", F.when(named.isNull(), legacy))
    first = F.struct(F.col("exit_price").alias("price"), F.col("execution_date").alias("day"), "minutes", "number", "id")
    out = g.groupBy(*TICKER, "named", "legacy").agg(F.sum("shares").alias("total_shares"), F.min_by(first, "id").alias("f"), F.count(F.lit(1)).alias("n"))
    return out.select(*TICKER, F.col("f.id").alias("group"), "total_shares", "n", "f.price", "f.day", "f.minutes", "f.number")


def raised_confidence(entries: DataFrame) -> DataFrame:
    """Rows that another document corroborates get high confidence; ``raised`` tells which."""
    up = (F.col("confidence") != "high") & F.coalesce("cross_verified", F.lit(False))
    return entries.withColumn("raised", up).withColumn("confidence", F.when(up, "high").otherwise(F.col("confidence")))


def already_allocated(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, allocated): how many of a pending sale's shares the ledger has sold: those of the group
    of its number, else of the only group of its day, price and time; at most its own."""
    g = groups.select(*TICKER, F.col("total_shares").alias("t"), F.col("price").alias("p"), F.col("day").alias("d"), F.col("minutes").alias("m"), F.col("number").alias("no"), "group")
    by_number = candidates.filter("number IS NOT NULL").join(g, [*[candidates[k] == g[k] for k in TICKER], candidates["number"] == g["no"]]).groupBy("id").agg(F.min_by("t", "group").alias("by_number"))
    j = candidates.join(g, [*[candidates[k] == g[k] for k in TICKER], candidates["execution_date"] == g["d"]]).filter(~clash("minutes", "m") & near("price", "p"))
    fits = j.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("t").alias("only"))
    out = candidates.select("id", "shares").join(by_number, "id", "left").join(fits, "id", "left")
    return out.select("id", F.least("shares", F.coalesce("by_number", F.when(F.col("k") == 1, F.col("only")), F.lit(0))).alias("allocated"))


def resolved_candidates(candidates: DataFrame, trades: DataFrame, groups: DataFrame) -> DataFrame:
    """(id): pending rows that the ledger has already. A buy: a trade of its number, else one of its
    content at the same price to 4 places whose number, if both have one, is not another. A
    sale: groups of its number, or where it has none of its day, price and time, that cover it."""
    t = trades.select(*TICKER, F.col("execution_date").alias("d"), F.col("shares").alias("s"), F.col("price").alias("p"), F.col("minutes").alias("m"), F.col("number").alias("no")).distinct()
    buys = candidates.filter("kind = 'BuyExecution'")
    keys = lambda a, b: [a[k] == b[k] for k in TICKER]
    numbered = buys.join(t, [*keys(buys, t), buys["number"] == t["no"]], "left_semi").select("id")
    same = buys.join(t, [*keys(buys, t), buys["execution_date"] == t["d"], buys["shares"] == t["s"], round4(buys["price"]) == round4(t["p"])])
    same = same.filter(~clash("minutes", "m") & ~F.coalesce(F.col("number") != F.col("no"), F.lit(False))).select("id")
    g = groups.select(*TICKER, F.col("total_shares").alias("t"), F.col("price").alias("p"), F.col("day").alias("d"), F.col("minutes").alias("m"), F.col("number").alias("no"))
    sells = candidates.filter("kind = 'SellExecution'")
    s1 = sells.filter("number IS NOT NULL")
    s2 = sells.filter("number IS NULL")
    one = s1.join(g, [*keys(s1, g), s1["number"] == g["no"]]).select("id", "shares", "t")
    two = s2.join(g, [*keys(s2, g), s2["execution_date"] == g["d"]]).filter(~clash("minutes", "m") & near("price", "p")).select("id", "shares", "t")
    sold = one.unionByName(two).groupBy("id", "shares").agg(F.sum("t").alias("t")).filter("t >= shares").select("id")
    return numbered.unionByName(same).unionByName(sold).distinct()


def reuploads(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id): official rows with a time that repeat a resolved official row in side, day, shares,
    price to 4 places and time."""
    o = entries.filter("source = 'official-broker-excel' AND minutes IS NOT NULL").withColumn("p4", round4("price"))
    keys = [*CONTENT, "p4"]
    done = o.join(resolved, "id", "left_semi").groupBy(*keys).agg(F.collect_set(known_time("minutes")).alias("times"), F.bool_or(known_time("minutes").isNull()).alias("any"))
    j = o.join(resolved, "id", "left_anti").join(done, keys)
    t = known_time("minutes")
    return j.filter(F.col("any") | t.isNull() | F.array_contains("times", t)).select("id")


def unclaimed_sells(facts: DataFrame, decisions: DataFrame, requests: DataFrame, claimed: bool = True) -> DataFrame:
    """(request, fact_id): the live sale that a recorded one is. Of several without a decision the
    first whose time goes with the request's, else the first.

    ``facts``: live sales with keys, id, seq, execution_date, shares, price, minutes; ``decisions``:
    sell_id; ``requests``: the same columns with ``request``. ``claimed`` false: sales with a
    decision count too, and a time that clashes never does.
    """
    keys = [*TICKER, "execution_date", "shares", "price"]
    free = facts.join(decisions.select(F.col("sell_id").alias("id")).distinct(), "id", "left_anti") if claimed else facts
    # facts of one key and time are as good as each other: the first of each stands for them
    times = free.groupBy(*keys, F.col("minutes").alias("m")).agg(F.min_by("id", "seq").alias("fact_id"), F.min("seq").alias("seq"))
    j = requests.join(times, keys).withColumn("bad", clash("minutes", "m"))
    if not claimed:
        j = j.filter("NOT bad")
    return j.groupBy("request").agg(F.min_by("fact_id", F.struct("bad", "seq")).alias("fact_id"))


def misclaimed(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(decision_id, wrong_id, right_id): decisions on a manual sale while an unclaimed sale of
    another source describes the same execution. ``facts`` as in ``unclaimed_sells``, with source;
    ``decisions``: decision_id, sell_id."""
    manual = facts.filter("source = 'manual'").join(decisions, F.col("id") == F.col("sell_id")).withColumn("request", F.col("decision_id"))
    best = unclaimed_sells(facts, decisions, manual.select("request", *TICKER, "execution_date", "shares", "price", "minutes"))
    right = best.join(facts.select(F.col("id").alias("fact_id"), "source"), "fact_id").filter("source <> 'manual'")
    return right.join(manual.select("request", F.col("id").alias("wrong_id")), "request").select(F.col("request").alias("decision_id"), "wrong_id", F.col("fact_id").alias("right_id"))


def group_labels(facts: DataFrame, trades: DataFrame) -> DataFrame:
    """(content, price, n_live, n_retracted, labels) of each canonical group. Facts: content, price,
    minutes, source, retracted; ``trades``: content, price of the ledger's buys."""
    keys = [*CONTENT, "price"]
    live = ~F.col("retracted")
    rank = authority("source")
    top = F.max(F.when(live, rank))
    g = facts.groupBy(*keys).agg(
        F.count_if(live).alias("n_live"), F.count_if("retracted").alias("n_retracted"), top.alias("top"), F.min(F.when(live, rank)).alias("low"), F.max(F.when(F.col("retracted"), rank)).alias("gone"),
        F.count_distinct(known_time("minutes")).alias("times"), F.bool_or(live & (F.col("source") == "backfill")).alias("backfill"), F.max_by(F.struct(rank.alias("r"), F.lit(1).alias("k")), F.when(live, rank)).alias("x"),
    )
    ties = facts.filter(live).groupBy(*keys, rank.alias("top")).agg(F.count(F.lit(1)).alias("n_top"))
    many = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades")).filter("n_trades >= 2")
    j = g.drop("x").join(ties, [*keys, "top"], "left").join(many, keys, "left")
    several = F.col("n_live") > 1
    label = lambda cond, name: F.when(cond, F.lit(name))
    labels = F.array_compact(F.array(
        label(~several, "singleton group"), label((F.col("n_live") == 1) & F.col("backfill"), "orphaned backfill"), label(several & (F.col("low") < F.col("top")), "duplicate-authority group"), label(several & (F.col("n_top") > 1), "skipped: tie"),
        label(several & (F.col("kind") == "BuyExecution") & F.col("n_trades").isNotNull(), "skipped: multiple live Trades"), label(several & (F.col("times") > 1), "skipped: conflicting execution time"),
        label((F.col("n_live") > 0) & (F.col("gone") > F.col("top")), "matching retracted higher-authority fact"),
    ))
    return j.select(*keys, "n_live", "n_retracted", labels.alias("labels"))


def label_summary(groups: DataFrame) -> DataFrame:
    """By ticker: live and retracted facts, groups, and groups of the labels that a sweep acts on."""
    has = lambda x: F.count_if(F.array_contains("labels", x))
    return groups.groupBy(*TICKER).agg(
        F.sum("n_live").alias("n_live"), F.sum("n_retracted").alias("n_retracted"), F.count(F.lit(1)).alias("n_groups"), has("singleton group").alias("n_singleton"), has("duplicate-authority group").alias("n_duplicate_authority"),
        has("orphaned backfill").alias("n_orphaned_backfill"), has("matching retracted higher-authority fact").alias("n_retracted_higher"),
    )


def import_groups(parts: dict[str, DataFrame]) -> DataFrame:
    """By ticker the number of rows of each part of an import (buys, sells, verifications, dividends,
    evidence): one aggregate over all parts, whatever parts a ticker has."""
    tagged = None
    for name, df in parts.items():
        one = df.select(*TICKER, F.lit(name).alias("part"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(*TICKER).agg(*[F.count_if(F.col("part") == name).alias(f"n_{name}") for name in parts])


def pending_duplicates(siblings: DataFrame, matched: DataFrame, states: DataFrame) -> DataFrame:
    """(id): rows that fall to a sibling or match the ledger, and are still to be decided on.
    ``states``: id of rows that were added, skipped or dismissed."""
    return siblings.select("id").unionByName(matched.select("id")).distinct().join(states.select("id"), "id", "left_anti")


def preserved(fresh: DataFrame, previous: DataFrame, live: DataFrame, terminal: DataFrame, keys: list[str]) -> DataFrame:
    """Events to write for each key: the fresh ones, and where the key isn't ``terminal`` (keys of
    which no fact needs review) previous events that the fresh ones lack, unless a source of
    any previous event is no longer live.

    Events: keys, event_id, sources (array of fact ids), and what else they carry; ``live``: id.
    """
    alive = live.select(F.col("id").alias("source")).distinct().withColumn("alive", F.lit(True))
    each = previous.select(*keys, F.explode("sources").alias("source")).join(alive, "source", "left")
    lost = each.groupBy(*keys).agg(F.bool_or(F.col("alive").isNull()).alias("lost")).filter("lost")
    kept = previous.join(terminal.select(*keys), keys, "left_anti").join(lost.select(*keys), keys, "left_anti").join(fresh.select(*keys, "event_id"), [*keys, "event_id"], "left_anti")
    return fresh.unionByName(kept)


def applied_rebuild(adds: DataFrame, removals: DataFrame, changes: DataFrame) -> DataFrame:
    """(what, id, applied, reason) of a rebuild's decisions. ``adds``: id, portfolio (null: not
    chosen); ``removals``: id, known, blocked; ``changes``: id, fields (array). Rows with sold
    shares are never removed, and only names and numbers change by themselves."""
    safe = F.forall("fields", lambda f: f.isin("companyName", "transactionNumber"))
    a = adds.select(F.lit("add").alias("what"), "id", F.col("portfolio").isNotNull().alias("applied"), F.when(F.col("portfolio").isNull(), "no portfolio").alias("reason"))
    ok = F.col("known") & ~F.col("blocked")
    r = removals.select(F.lit("remove").alias("what"), "id", ok.alias("applied"), F.when(~ok, "shares are sold against it").alias("reason"))
    c = changes.select(F.lit("modify").alias("what"), "id", safe.alias("applied"), F.when(~safe, "touches price, fees, taxes or time").alias("reason"))
    return a.unionByName(r).unionByName(c)


def lessons(journal: DataFrame, trades: DataFrame) -> DataFrame:
    """Journal entries that hold a lesson, with their trade, the latest first (``ord``)."""
    j = journal.filter("lesson IS NOT NULL AND trim(lesson) <> ''").join(trades.select("trade_id", "ticker", "portfolio_id"), "trade_id")
    return j.withColumn("ord", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("written_on"), "trade_id")))


def stale_prices(quotes: DataFrame, now, most_days: int = 4) -> DataFrame:
    """Quotes with ``stale``: older than four days, or of unknown time."""
    age = F.datediff(F.lit(now).cast("date"), F.to_date("quoted_at"))
    return quotes.withColumn("stale", F.coalesce(age > most_days, F.lit(True)))


def by_archive(portfolios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, archived) portfolios."""
    return portfolios.filter("archived_at IS NULL"), portfolios.filter("archived_at IS NOT NULL")
