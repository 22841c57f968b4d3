"""Operators for large training-data pipelines over text documents.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus the names of its id and text columns, selects only those columns
(so extra or clashing column names are harmless) and returns a new DataFrame.
"""
