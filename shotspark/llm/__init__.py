"""Operators for training-data pipelines over documents, pages and embeddings.

Each operator module holds the general operator and the thin ``opN_<name>``
query over the given tables; ``registry`` collects the queries and their SQL.
Nothing outside this subpackage imports it.
"""
