"""Operators for training-data pipelines over text tables.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it."""
