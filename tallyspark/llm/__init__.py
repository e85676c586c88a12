"""Training-data operators: dedup, filtering, scanning and tokenising of text corpora.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guarded hook of
``__spark_entry__.py``) imports it.
"""
