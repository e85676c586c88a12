"""Spark-native trade-ledger and portfolio analytics."""
