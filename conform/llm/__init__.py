"""Operators that a large training-data pipeline needs, as Spark jobs.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
