"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a function of
DataFrames with its own parameters; :mod:`tessera.llm.queries` binds them to
the driver's tables.
"""
