"""Text of statements and orders: tickers by company name, order lines, detectors."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprs import clean_text, company_key, parse_price, repair_digits, time_to_minutes


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def normalize(x: Column, compatibility: bool = False) -> Column:
    """Cleaned text; ``compatibility`` also folds compatibility forms (NFKC), for which Spark
    has no function, in Arrow batches."""
    return clean_text(_nfkc(x) if compatibility else x)


def fuzzy_lookup(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, ticker, distance): the first dictionary company within max(2, 15 % of its length)
    edits of the name cut to its length, if the name has 70 % of that length at least.

    ``dictionary``: (company, ticker, ord), a dimension of a few dozen rows that is broadcast;
    it is checked to hold no more than 10,000. Exact keys win over near ones.
    """
    n = dictionary.count()
    if n > 10_000:
        raise ValueError(f"{n} companies are no small dimension")
    d = F.broadcast(dictionary.select(company_key("company").alias("key"), "ticker", "ord"))
    each = names.select("name").distinct().withColumn("k", company_key("name"))
    size = F.length("key")
    cut = F.expr("substring(k, 1, length(key))")
    dist = F.levenshtein(cut, F.col("key"))
    j = each.join(d, (F.length("k") >= size * 0.7) & (dist <= F.greatest(F.lit(2), F.floor(size * 0.15))))
    return j.groupBy("name").agg(F.min(F.struct((F.col("k") != F.col("key")).alias("near"), "ord", "ticker", dist.alias("distance"))).alias("m")).select("name", F.col("m.ticker").alias("ticker"), F.col("m.distance").alias("distance"))


#: A line of an order or statement: side, shares, ticker, price, date.
ORDER_LINE = r"(?i)\b(BUY|SELL)\s+([\d,]+)\s+([A-Z]{3,5})\s*@\s*([\d.,]+)\s+(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?:\s+([0-9OIl]{1,2}:\d{2}\s*[AP]M))?"


def extract_orders(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per order line of a text: key, pos, side, shares, ticker, price, day, minutes.

    Digits that a scan misread are repaired in times; a day that isn't in the calendar gives
    null.
    """
    hits = docs.select(key, F.posexplode(F.regexp_extract_all(clean_text(text), F.lit(ORDER_LINE), F.lit(0))).alias("pos", "m"))
    g = lambda i: F.regexp_extract("m", ORDER_LINE, i)
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", *[g(i).cast("int") for i in (7, 6, 5)]), "yyyy-MM-dd")
    clock = time_to_minutes(F.concat(repair_digits(F.regexp_extract(g(8), r"^\S+?(?=\s*[APap][Mm]$)", 0)), F.regexp_extract(g(8), r"[APap][Mm]$", 0)))
    return hits.select(key, "pos", F.upper(g(1)).alias("side"), F.regexp_replace(g(2), ",", "").cast("bigint").alias("shares"), F.upper(g(3)).alias("ticker"), parse_price(g(4)).alias("price"), day.alias("day"), clock.alias("minutes"))


def document_kind(text: Column) -> Column:
    """What a text is, by the first detector that fits; short texts are unreadable."""
    return (
        F.when(F.length(F.trim(text)) < 20, "unreadable").when(text.rlike(r"(?i)\binvoice\b"), "invoice").when(text.rlike(r"(?i)average\s+cost"), "position")
        .when(text.rlike(r"(?i)account\s+statement"), "statement").when(text.rlike(r"(?i)\b(filled|cancelled|pending)\b"), "orders").otherwise("unknown")
    )


def gap_threshold(gaps: DataFrame, key: str) -> DataFrame:
    """The first gap, in rising order, that is 1.8 times the one before it, halved between."""
    w = Window.partitionBy(key).orderBy("gap")
    g = gaps.withColumn("next", F.lead("gap").over(w)).filter("next >= 1.8 * gap AND gap > 0")
    return g.groupBy(key).agg(F.min(F.struct("gap", "next")).alias("m")).select(key, ((F.col("m.gap") + F.col("m.next")) / 2).alias("threshold"))
