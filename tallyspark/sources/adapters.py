"""The driver's tables as trades, allocations, facts, cash events and prices.

Each is a projection or one aggregate; FIXTURES.md has the same as SQL views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up
from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One buy lot of 1,000 shares per part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("trade_id"), (F.col("p_partkey") % 8).alias("portfolio_id"), F.upper("p_brand").alias("ticker"), F.col("p_type").alias("sector"),
        F.lit(1000.0).alias("shares"), F.col("p_retailprice").alias("entry_price"), F.col("p_size").cast("double").alias("fees"), F.lit(0.5).alias("taxes"),
        F.to_date(F.lit("1995-01-01")).alias("execution_date"), F.col("p_name").alias("strategy_tags_raw"), F.split("p_name", " ").alias("tags"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two journal entries of every third trade; the second has the tags that count."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0")
    entry = lambda ord_, tag: p.select(F.col("p_partkey").alias("trade_id"), F.lit(ord_).alias("ord"), F.array(F.lower(tag), F.element_at(F.split("p_name", " "), 1)).alias("tags"))
    return entry(1, F.col("p_brand")).unionByName(entry(2, F.col("p_type")))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click pays its value, on one of 600 days."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return e.select((F.col("user_id") % 8).alias("portfolio_id"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("event_id") % 600).cast("int")).alias("day"), half_up(F.col("value") * 1e6).alias("amount_micros"))


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean unit price by brand and day, in cents half up."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", F.upper("p_brand").alias("ticker"))
    unit = F.sum(half_up(F.col("l_extendedprice") / F.col("l_quantity") * 100)) / F.count(F.lit(1))
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", F.to_date("l_shipdate").alias("price_date")).agg((half_up(unit) / F.lit(100.0)).alias("close"))


def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item closes shares of its part's lot."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sell_group_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("trade_id"), (F.col("l_partkey") % 8).alias("portfolio_id"),
        F.col("l_quantity").alias("shares_closed"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("exit_price"),
        (F.col("l_discount") * 10).alias("fees"), (F.col("l_tax") * 10).alias("taxes"), F.to_date("l_shipdate").alias("execution_date"),
    )


CONFIDENCE = ["low", "medium", "high"]
SOURCES = ["invoice", "official-broker-excel", "statement", "orders-screen", "csv", "manual"]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions without a number: what needs no total order."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "SellExecution").otherwise("BuyExecution").alias("kind"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("l_orderkey") % 6 + 1).cast("int")).alias("source"),
        (F.col("l_suppkey") % 10).alias("portfolio_id"), (F.col("l_partkey") % 40).alias("ticker_id"),
        F.col("l_quantity").cast("bigint").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.to_date("l_shipdate").alias("execution_date"), F.when(F.col("l_linenumber") != 1, F.col("l_linenumber") * 60).alias("minutes"),
        F.element_at(F.array(*map(F.lit, CONFIDENCE)), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("confidence"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


#: A total order of facts that needs no global numbering.
FACT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "shares", "l_extendedprice"]


def cash_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "Withdrawal", "signup", "Deposit", "click", "DividendPayment", "error", "CashReset")])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("portfolio_id"), F.coalesce(kind[F.col("event_type")], F.lit("CashAdjustment")).alias("kind"), F.col("value").alias("amount"), "ts"
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean unit price by ticker and day, in cents half up."""
    unit = F.avg(F.col("l_extendedprice") / F.col("l_quantity"))
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_partkey") % 40).alias("ticker_id"), F.to_date("l_shipdate").alias("price_date")).agg((half_up(unit * 100) / F.lit(100.0)).alias("close"))


def lot_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest unit price of each brand; of one day the largest."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    last = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.upper("p_brand").alias("ticker"))
    return last.agg(F.max(F.struct(F.to_date("l_shipdate").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))).alias("m")).select("ticker", F.col("m.p").alias("price"))


def first_seen(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds ord: the row's place within its keys."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def dense_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts on a coarse grid of months, share counts and prices, where many rows coincide."""
    return (
        facts(spark, sf_dir).withColumn("execution_date", F.trunc("execution_date", "month")).withColumn("shares", (F.col("shares") % 4 + 1) * 10)
        .withColumn("price", (F.floor(F.col("price") / 250) + 1) * F.lit(250.0) + F.col("l_linenumber"))
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending executions of many small tickers on a coarse grid of years, shares and prices:
    two in three rows of a part are read by several documents. Manual rows are untyped."""
    f = facts(spark, sf_dir)
    return f.select(
        "portfolio_id", F.col("l_partkey").alias("ticker_id"), "kind", F.trunc("execution_date", "year").alias("execution_date"), ((F.col("shares") % 2 + 1) * 10).cast("bigint").alias("shares"),
        ((F.floor(F.col("price") / 500) + 1) * F.lit(500.0) + F.col("l_linenumber")).alias("price"), F.when(F.col("l_linenumber") % 4 == 0, 600).alias("minutes"),
        F.when(F.col("l_linenumber") == 3, (F.col("l_orderkey") % 5).cast("string")).alias("number"), F.nullif("source", F.lit("manual")).alias("source"),
        "confidence", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), "l_orderkey", "l_linenumber", "l_suppkey",
    )


def existing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares on the ledger of every portfolio and part: 0, 10 or 20."""
    k = entries(spark, sf_dir).select("portfolio_id", "ticker_id").distinct()
    return k.withColumn("existing", (F.col("ticker_id") % 3 * 10).cast("double")).withColumn("existing_cost_micros", (F.col("ticker_id") % 3 * 10_000_000_000).cast("bigint"))


def counted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broker's count of two in three portfolio tickers, every other one with a mean cost."""
    k = entries(spark, sf_dir).select("portfolio_id", "ticker_id").distinct().filter("(ticker_id + portfolio_id) % 3 <> 0")
    return k.select("portfolio_id", "ticker_id", (F.col("ticker_id") % 5 * 10).cast("double").alias("units"), F.when(F.col("ticker_id") % 2 == 0, 1000.0 + F.col("ticker_id") % 7 * 50).alias("avg_cost"))


def ledger_facts(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Facts of all kinds, from all line items, or from the coarse grid of dense facts: an execution for each line item, and for four in ten orders a control fact
    or an explicit allocation. These refer to the order's first execution, or to the control fact
    of an earlier order, which may not exist; allocations go from the order's first sale to its
    buys."""
    grid = dense_facts(spark, sf_dir).withColumn("price", F.floor(F.col("price") / 250) * 250.0) if dense else facts(spark, sf_dir)
    lines = grid.select(
        F.concat_ws("-", F.lit("x"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], half_up(F.col("l_extendedprice") * 100).cast("string")).alias("id"), F.col("l_orderkey").alias("seq"), "kind", "source",
        F.concat(F.lit("T"), F.col("ticker_id").cast("string")).alias("ticker"), "portfolio_id", "execution_date", "minutes", "shares", "price", "confidence",
    )
    sale = F.when(F.col("kind") == "SellExecution", F.col("id"))
    by_order = lines.groupBy("seq").agg(
        F.min("id").alias("first_id"), F.min(sale).alias("sell_id"), F.min_by("portfolio_id", sale).alias("sell_portfolio"), F.min_by("ticker", sale).alias("sell_ticker"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "BuyExecution", F.struct(F.col("id").alias("lot_ref"), "shares")))).alias("lots"),
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("c")).filter("seq % 10 >= 6").join(by_order, "seq", "left")
    kind = F.element_at(F.array(*map(F.lit, ["SellAllocationDecision", "Correction", "Retraction", "PortfolioAssignment"])), (F.col("seq") % 10 - 5).cast("int"))
    o = o.withColumn("kind", kind).filter("kind <> 'SellAllocationDecision' OR sell_id IS NOT NULL")
    decides, renames, moves = (F.col("kind") == k for k in ("SellAllocationDecision", "Correction", "PortfolioAssignment"))
    target = F.when(F.col("c") % 4 == 0, F.concat(F.lit("c-"), (F.col("seq") - F.col("c") % 50 - 1).cast("string"))).otherwise(F.col("first_id"))
    control = o.select(
        F.concat(F.lit("c-"), F.col("seq").cast("string")).alias("id"), "seq", "kind", F.when(decides, F.col("sell_portfolio")).alias("portfolio_id"), F.when(decides, F.col("sell_ticker")).alias("ticker"),
        F.when(~decides, target).alias("target_id"), F.when(renames, F.concat(F.lit("T"), (F.col("c") % 40).cast("string"))).alias("patch_ticker"), F.when(moves, F.col("c") % 10).alias("assigned_portfolio_id"),
        F.when(decides, F.col("sell_id")).alias("sell_execution_id"), F.when(decides, F.col("lots")).alias("allocations"),
    )
    return lines.unionByName(control, allowMissingColumns=True)
