"""Operators for preparing language-model training data.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
