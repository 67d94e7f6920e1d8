"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator takes a DataFrame
and names of its id and text columns, reads only the columns it needs (so
clashing extra columns are harmless), and returns a DataFrame.
"""
