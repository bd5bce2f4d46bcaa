"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; see each module for the method, the parameters and the defined
results for nulls, empty texts, ties and empty tables.
"""
