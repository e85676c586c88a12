"""The scalar functions as SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "half_up(x DOUBLE) RETURNS BIGINT": "CAST(floor(x + 0.5D) AS BIGINT)",
    "to_micros(x DOUBLE) RETURNS BIGINT": "CAST(floor(x * 1e6D + 0.5D) AS BIGINT)",
    "from_micros(x BIGINT) RETURNS DOUBLE": "x / 1e6D",
    "round4(x DOUBLE) RETURNS DOUBLE": "floor(x * 10000D + 0.5D) / 10000D",
    "normalize_ticker(x STRING) RETURNS STRING": r"regexp_replace(upper(trim(x)), '\\.CA$', '')",
    "ratio_pct(part DOUBLE, whole DOUBLE) RETURNS DOUBLE": "CASE WHEN whole > 0 THEN part / whole * 100 ELSE 0D END",
    "within_share(a DOUBLE, b DOUBLE, share DOUBLE) RETURNS BOOLEAN": "abs(a - b) <= greatest(a, b) * share",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
