"""Training-data operators: thirteen distributed components and their registered queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
