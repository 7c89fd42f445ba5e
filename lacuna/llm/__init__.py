"""Training-data operators: quality, deduplication, mixing, packing, privacy, scoring.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
