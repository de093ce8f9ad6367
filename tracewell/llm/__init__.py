"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Each operator takes a DataFrame
and the names of its columns, reads only those columns, and returns its own
columns, so other columns of the input can have any name.
"""
