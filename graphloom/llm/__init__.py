"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries`` wraps them as thin ``opN_<name>``
queries over the test tables.
"""
