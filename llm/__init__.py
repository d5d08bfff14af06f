"""Operators for training-data pipelines over a ``documents``-like table.

Each module holds one operator with a general interface and a thin
``opN_<name>`` query; :mod:`llm.queries` collects the queries.
"""
