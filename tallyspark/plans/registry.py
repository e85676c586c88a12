"""All registered queries and their SQL."""

from . import analytics_queries, document_queries, import_queries, ledger_queries, misc_queries, recording_queries, resolve_queries, review_queries, snapshot_queries, streaming_queries, summary_queries, sweep_queries, timeseries_queries, verification_queries

_MODULES = [analytics_queries, timeseries_queries, ledger_queries, resolve_queries, review_queries, sweep_queries, misc_queries, summary_queries, verification_queries, document_queries, recording_queries, import_queries, snapshot_queries, streaming_queries]

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: q for m in _MODULES for name, q in m.ORACLES.items()}
