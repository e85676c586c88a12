"""Where users add their own: document parsers by name, tables by name, and records of what ran."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D

Parser = Callable[[DataFrame], DataFrame]

#: Parsers of documents (key, text) by the kind of record they find; those that need the
#: dictionary of companies take it as second argument.
PARSERS: dict[str, Callable[..., DataFrame]] = {
    "statement": D.statement_rows, "invoice": D.invoices, "orders-screen": D.orders_screen, "orders-timeline": D.orders_timeline, "transactions": D.transactions,
    "order-details": D.order_details, "position": D.position_screens, "dividends": D.dividend_rows,
}


def add_parser(kind: str, parser: Callable[..., DataFrame]) -> None:
    if kind in PARSERS:
        raise ValueError(f"there is a parser of {kind} already")
    PARSERS[kind] = parser


class Catalog:
    """Named tables, each with a loader, so that storage can be anything that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, loader: Callable[[SparkSession], DataFrame]) -> Catalog:
        self.loaders[name] = loader
        return self

    def load(self, name: str) -> DataFrame:
        if name not in self.loaders:
            raise KeyError(f"no table {name}; there are {sorted(self.loaders)}")
        return self.loaders[name](self.spark)

    def views(self) -> None:
        """Makes all tables views of the session, for SQL."""
        for name in self.loaders:
            self.load(name).createOrReplaceTempView(name)


def recorded(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows, and what a run of them counts: rows, and nulls by column. Costs no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns]), seen


def append_record(spark: SparkSession, path: str, name: str, seen: Observation, at: str) -> None:
    """Appends what a run counted to a table of records."""
    spark.createDataFrame([(name, at, {k: str(v) for k, v in seen.get.items()})], "name string, at string, counts map<string,string>").write.mode("append").parquet(path)
