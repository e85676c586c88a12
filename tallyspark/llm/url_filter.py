"""Operator 5 [native]: allow and block rules for urls, by a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the url's path starts with the
rule's. Keys are canonical: the host's labels reversed (``com.example.www``), then the path.
A url probes with each of its reversed-host prefixes, and under one such prefix a rule's path
is an interval of keys: ``[path, path + 0xFF)`` in byte order, 0xFF being no UTF-8 byte.
Intervals of prefixes nest or are apart, so a sweep in key order needs a stack only: a rule's
start pushes it, its end pops back to the rule around it. Each event carries the top of the
stack that it leaves, and a probe takes the last one before it.

The sweep is a window over (reversed host, salt). A host is dealt over as many salts as its
probes fill groups of ``max(target, its rules)`` rows, and its rules go to each of them: the
rows of all groups are at most twice those of the probes, plus the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, durable, table

#: The fixed rules of the contract: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def prefixes_of(host: Column) -> Column:
    """The reversed hosts of a host and of all domains around it."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))


def rule_events(rules: DataFrame) -> DataFrame:
    """Starts and ends of the rules' intervals, each with the top of the stack it leaves.

    The rule around another is the one whose path is its longest proper prefix on that host.
    """
    one = rules.select(
        reversed_host(F.translate("host", UPPER, LOWER)).alias("rev"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
            F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"), "verdict",
        ).alias("top"),
        "path",
    ).groupBy("rev", "path").agg(F.max("top").alias("top"))
    around = (
        one.select("rev", "path", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n"))
        .filter("n >= 0 AND n < length(path)")
        .select("rev", "path", F.expr("substring(path, 1, n)").alias("outer_path"))
        .join(one.select("rev", F.col("path").alias("outer_path"), F.col("top").alias("outer")), ["rev", "outer_path"])
        .groupBy("rev", "path").agg(F.max_by("outer", F.length("outer_path")).alias("outer"))
    )
    both = one.join(around, ["rev", "path"], "left")
    key = F.col("path").cast("binary")
    start = both.select("rev", key.alias("at"), F.lit(0).alias("kind"), F.struct(F.col("top").alias("now")).alias("event"))
    end = both.select("rev", F.concat(key, F.lit(bytearray(b"\xff"))).alias("at"), F.lit(0).alias("kind"), F.struct(F.col("outer").alias("now")).alias("event"))
    return start.unionByName(end)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", target: int = 256, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A null url, or one without ``://``, has an empty host and path and fits no rule but one
    with neither; else ``rule`` is null and ``verdict`` the ``default``. Of the rules that fit, that of the longest
    host and path together wins, of equally long ones that of the longer host; of rules with
    the same host and path, the verdict that sorts last. Repeated and null page ids are kept
    as they are. No rules: all pages get the default. No pages: no rows.
    """
    p = pages.select(col(id_col).alias("page_id"), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    events = rule_events(rules)
    each = p.select("host", "path").distinct()
    probes = each.select("host", "path", F.explode(prefixes_of(F.col("host"))).alias("rev"))
    per_host = events.groupBy("rev").agg(F.count(F.lit(1)).alias("n_rules"))
    deal = (
        probes.groupBy("rev").agg(F.count(F.lit(1)).alias("n")).join(per_host, "rev")
        .select("rev", F.greatest(F.lit(1), F.ceil(F.col("n") / F.greatest(F.lit(target), F.col("n_rules")))).cast("int").alias("salts"))
    )
    deal = durable(deal, "deal")  # of measured size: Spark broadcasts it below its threshold, else splits skewed joins
    dealt = probes.join(deal, "rev").select(
        "rev", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"),
        F.col("path").cast("binary").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(events.schema["event"].dataType).alias("event"), "host", "path",
    )
    told = events.join(deal, "rev").select(
        "rev", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "at", "kind", "event",
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )
    sweep = Window.partitionBy("rev", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        dealt.unionByName(told).withColumn("top", F.last("event", ignorenulls=True).over(sweep)["now"])
        .filter("kind = 1 AND top IS NOT NULL").groupBy("host", "path").agg(F.max("top").alias("top"))
    )
    # read back, it leaves the skew join free to split a url that many rows have; small files may
    # hold many urls, so it isn't broadcast by their size
    found = durable(found, "found")
    # urls without host and path, null ones above all, may be many: what they meet is one row
    bare = (F.col("host") == "") & (F.col("path") == "")
    halves = p.filter(~bare).join(found.filter(~bare).hint("merge"), ["host", "path"], "left"), p.filter(bare).join(F.broadcast(found.filter(bare)), ["host", "path"], "left")
    return halves[0].unionByName(halves[1]).select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url_filter`` of all pages by the fixed rules; nulls, ties and repeats: as stated there."""
    return url_filter(table(spark, sf_dir, "pages"), rules_frame(spark))


ORACLE = """
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, q) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
m AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
