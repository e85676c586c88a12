"""Sources: point and range scans, price snapshots, delimited statements, order workbooks, files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import normalize_ticker, parse_price, time_to_minutes

#: Fixed guards of workbooks: bytes, sheets, rows, columns.
MAX_BYTES, MAX_SHEETS, MAX_ROWS, MAX_COLUMNS = 25 * 1024 * 1024, 32, 100_000, 256
ZIP_MAGIC = bytearray(b"PK\x03\x04")


def scan(df: DataFrame, equals: dict | None = None, isin: dict | None = None, below: dict | None = None, at_least: dict | None = None) -> DataFrame:
    """Rows that meet all given predicates; those not given don't filter. All of them reach the
    Parquet scan."""
    tests: list[Column] = [F.col(k) == v for k, v in (equals or {}).items() if v is not None]
    tests += [F.col(k).isin(list(v)) for k, v in (isin or {}).items() if v is not None]
    tests += [F.col(k) < v for k, v in (below or {}).items() if v is not None]
    tests += [F.col(k) >= v for k, v in (at_least or {}).items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def recent(df: DataFrame, seq: str, n: int) -> DataFrame:
    """The n rows of largest seq, in rising order."""
    return df.orderBy(F.desc(seq)).limit(n).orderBy(seq)


def price_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, price, as_of, quoted_at, source) of a JSON snapshot; none if it isn't one."""
    schema = "asOf string, prices map<string,double>, quotes map<string,struct<price:double,quotedAt:string,source:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE").filter("asOf IS NOT NULL AND prices IS NOT NULL")
    p = raw.select("asOf", "quotes", F.explode("prices").alias("ticker", "price")).filter("price IS NOT NULL")
    q = F.col("quotes")[F.col("ticker")]
    return p.select("ticker", "price", F.col("asOf").alias("as_of"), q["quotedAt"].alias("quoted_at"), q["source"].alias("source"))


def snapshot_info(snapshot: DataFrame) -> DataFrame:
    """One row: when the snapshot was taken and its latest quote; none without prices."""
    return snapshot.agg(F.max("as_of").alias("as_of"), F.max("quoted_at").alias("latest_quote"), F.count(F.lit(1)).alias("n")).filter("n > 0")


def price_history(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, day, close) of a nested JSON history."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,double>>").alias("h"))
    t = raw.select(F.explode("h").alias("ticker", "days"))
    return t.select("ticker", F.explode("days").alias("d", "close")).select("ticker", F.to_date("d").alias("day"), "close").filter("day IS NOT NULL AND close IS NOT NULL")


#: Fixed header names of delimited statements.
HEADERS = {
    "date": ["date", "trade date", "execution date"], "ticker": ["ticker", "symbol", "code"], "side": ["type", "side", "action"],
    "shares": ["quantity", "shares", "qty", "units"], "price": ["price", "unit price", "rate"], "fees": ["fees", "commission"], "time": ["time", "trade time"],
}


def delimited_statement(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, ticker, side, shares, price, fees, day, minutes, confidence) of statements
    delimited by comma, semicolon or tab, each file with its own header. Invalid rows drop out.

    A line meets its file's header by a window over the file's first line, so any number of
    files is read at once; no file is collected.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value").filter("trim(value) <> ''")
    first = lines.groupBy("file").agg(F.min_by("value", "line").alias("header"), F.min("line").alias("start"))
    n = lambda ch: F.length("header") - F.length(F.replace("header", F.lit(ch), F.lit("")))
    sep = F.when((n("\t") > 0) & (n("\t") >= n(",")) & (n("\t") >= n(";")), "\t").when(n(";") > n(","), ";").otherwise(",")
    first = first.withColumn("sep", sep).withColumn("names", F.transform(F.split(F.lower("header"), "[,;\t]"), lambda x: F.trim(x)))
    cells = lines.join(first, "file").filter("line > start").withColumn("cells", F.when(F.col("sep") == ",", F.split("value", ",", -1)).when(F.col("sep") == ";", F.split("value", ";", -1)).otherwise(F.split("value", "\t", -1)))

    def field(name: str) -> Column:
        at = F.greatest(*[F.array_position("names", F.lit(h)) for h in HEADERS[name]])
        return F.trim(F.when(at > 0, F.try_element_at("cells", at.cast("int"))))

    side = F.when(F.upper(field("side")).rlike("^(B|BUY|PURCHASE)$"), "BUY").when(F.upper(field("side")).rlike("^(S|SELL|SALE)$"), "SELL")
    day = F.coalesce(F.try_to_date(field("date"), "yyyy-MM-dd"), F.try_to_date(field("date"), "d/M/yyyy"))
    rows = cells.select(
        "file", "line", normalize_ticker(field("ticker")).alias("ticker"), F.coalesce(side, F.lit("BUY")).alias("side"), parse_price(F.regexp_replace(field("shares"), ",", "")).alias("shares"), parse_price(field("price")).alias("price"),
        F.coalesce(parse_price(field("fees")), F.lit(0.0)).alias("fees"), day.alias("day"), time_to_minutes(field("time")).alias("minutes"), F.when(side.isNotNull(), "high").otherwise("low").alias("confidence"),
    )
    return rows.filter("ticker <> '' AND shares > 0 AND price > 0 AND day IS NOT NULL")


def orders_sheet(cells: DataFrame) -> DataFrame:
    """Orders of a workbook's sheet (file, row, c1..c6): a row with one cell names the ticker of
    the rows below it, carried on until the next."""
    single = " AND ".join(f"coalesce(c{i}, '') = ''" for i in range(2, 7))
    w = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    t = cells.withColumn("ticker", F.last(F.when(F.expr(single) & F.col("c1").rlike(r"^[A-Z]{3,5}$"), F.col("c1")), ignorenulls=True).over(w)).filter(~F.expr(single))
    done, total = F.regexp_extract("c5", r"^([\d,]+)\s*/", 1), F.regexp_extract("c5", r"/\s*([\d,]+)$", 1)
    num = lambda x: F.regexp_replace(x, ",", "").try_cast("bigint")
    status = F.when(F.lower("c6").contains("fill") | F.lower("c6").contains("execut"), "executed").when(F.lower("c6").contains("cancel"), "cancelled").otherwise("pending")
    return t.select("file", "row", "ticker", F.when(F.lower("c2").contains("sell"), "SELL").otherwise("BUY").alias("side"), parse_price("c4").alias("price"), num(done).alias("executed"), num(total).alias("ordered"), F.try_to_date(F.substring("c1", 1, 10), "yyyy-MM-dd").alias("day"), status.alias("status")).filter("ticker IS NOT NULL AND ordered > 0")


def guarded_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, problem) of files: too large, or no workbook by its first bytes."""
    f = spark.read.format("binaryFile").load(path)
    problem = F.when(F.col("length") > MAX_BYTES, "too-large").when(~F.col("path").rlike(r"(?i)\.xlsx$"), None).when(F.substring("content", 1, 4) != F.lit(ZIP_MAGIC), "not-a-workbook")
    return f.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), problem.alias("problem"))


#: Fixed: sources of the exchange workbook's document types.
DOCUMENT_SOURCES = {"invoice": "invoice", "statement": "statement", "orders": "orders-screen", "official export": "official-broker-excel"}


def exchange_workbook(observations: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(executions, rejects) of an exchange workbook's sheets, which come as tables of texts.

    A row is rejected with its first problem: unknown document, bad side, ticker, date, quantity
    or price, or a gross amount off by more than 0.05 and 0.1 %. Cancelled rows are kept apart
    by their status.
    """
    kind = F.create_map(*[F.lit(x) for kv in DOCUMENT_SOURCES.items() for x in kv])[F.lower(F.trim("document_type"))]
    docs = documents.select("document_id", F.coalesce(kind, F.lit("other-document")).alias("source"))
    o = observations.join(docs, "document_id", "left")
    serial = F.col("trade_date").try_cast("double")
    day = F.coalesce(F.try_to_date("trade_date", "yyyy-MM-dd"), F.try_to_date("trade_date", "d/M/yyyy"), F.when(serial.between(1, 80000), F.date_add(F.to_date(F.lit("1899-12-30")), F.floor(serial).cast("int"))))
    side = F.when(F.lower("transaction_type").isin("buy", "purchase"), "BUY").when(F.lower("transaction_type").isin("sell", "sale"), "SELL")
    q, p, gross = parse_price("quantity"), parse_price("price"), parse_price("gross_amount")
    off = F.abs(gross - q * p) > F.greatest(F.lit(0.05), F.abs(gross) * 0.001)
    problem = (
        F.when(F.col("source").isNull(), "unknown-document").when(side.isNull(), "bad-side").when(F.coalesce(F.trim("ticker"), F.lit("")) == "", "no-ticker").when(day.isNull(), "bad-date")
        .when(~F.coalesce(q > 0, F.lit(False)), "bad-quantity").when(~F.coalesce(p > 0, F.lit(False)), "bad-price").when(F.coalesce(off, F.lit(False)), "gross-mismatch")
    )
    status = F.when(F.lower("order_status").contains("cancel"), "cancelled").when(F.lower("order_status").contains("partial"), "partial").otherwise("executed")
    r = o.select("observation_id", "document_id", "source", side.alias("side"), normalize_ticker("ticker").alias("ticker"), day.alias("day"), time_to_minutes("trade_time").alias("minutes"), q.alias("shares"), p.alias("price"), status.alias("status"), problem.alias("problem"))
    return r.filter("problem IS NULL").drop("problem"), r.filter("problem IS NOT NULL").select("observation_id", "problem")


def first_by_hash(files: DataFrame, digest: str) -> DataFrame:
    """The first file of a content hash, by path; no row if it is new. Files: path, digest."""
    return files.filter(F.col("digest") == digest).orderBy("path").limit(1)


#: Header names that a sheet may not set.
FORBIDDEN = ["__proto__", "constructor", "prototype"]


def guarded_sheets(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells without those of forbidden headers, problems by file): workbooks of too many sheets,
    rows or columns. Cells: file, sheet, row, col, header, value."""
    g = cells.groupBy("file").agg(F.count_distinct("sheet").alias("sheets"), F.max("row").alias("rows"), F.max("col").alias("cols"))
    problem = F.when(F.col("sheets") > MAX_SHEETS, "too-many-sheets").when(F.col("rows") > MAX_ROWS, "too-many-rows").when(F.col("cols") > MAX_COLUMNS, "too-many-columns")
    return cells.filter(~F.coalesce(F.col("header"), F.lit("")).isin(FORBIDDEN)), g.select("file", problem.alias("problem"))
