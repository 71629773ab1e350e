"""Operators of a training-data pipeline over documents, pages and embeddings.

One module per operator, ``scratch``/``words``/``components`` shared by them, and
``queries`` with the registered queries.  Nothing outside this subpackage imports it.
"""
