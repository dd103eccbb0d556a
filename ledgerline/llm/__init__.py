"""Operators of a training-data pipeline over document tables.

Each module holds one operator with a general DataFrame interface; ``queries``
derives the registered ``opN_`` queries from them. Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
