"""Operators for preparing text corpora at cluster scale.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
