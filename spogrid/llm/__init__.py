"""Operators for preparing language-model training data.

Every operator module has a general interface over DataFrames; ``queries.py``
holds the thin registered queries ``opN_<name>`` over the given tables.
"""
