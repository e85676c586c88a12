"""Queries of this folder and their SQL, by name."""

from __future__ import annotations



import corpus_pipeline

from . import byte_bpe, cross_tokenizer, decontaminate, exact_dedup, language_id, near_dup, periodic_runs, pii, quality, secrets, sentencepiece_codec, toxicity, url_filter

OPERATORS = [exact_dedup, sentencepiece_codec, language_id, secrets, url_filter, near_dup, quality, decontaminate, toxicity, pii, periodic_runs, byte_bpe, cross_tokenizer]

QUERIES = {name: f for m in OPERATORS for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit() and callable(f)}
ORACLES = {name: m.ORACLE for m in OPERATORS for name in QUERIES if name in vars(m) and getattr(m, "ORACLE", None)}

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
