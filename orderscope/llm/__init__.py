"""Operators for large-scale training-data pipelines.

Thirteen operators, one module each, over ``documents``, ``pages``,
``embeddings`` and ``conversations``; ``queries.py`` binds each to its whole
table and ``oracle.py`` holds the DuckDB text of those SQL can express.
Nothing outside this package imports it.
"""
