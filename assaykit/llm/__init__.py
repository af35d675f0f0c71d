"""Operators for preparing language-model training corpora at cluster scale.

Nothing outside this package imports it.  Every operator is a function of DataFrames
returning DataFrames; ``queries`` binds them to the shared tables.
"""
