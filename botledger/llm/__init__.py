"""Training-data operators: deduplication, filtering, mixing, tokenising.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
