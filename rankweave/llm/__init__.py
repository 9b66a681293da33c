"""Operators for large-scale training-data pipelines.

Each module holds one operator as a function over DataFrames; ``queries``
registers one query per operator over the driver's tables.  Nothing outside
this subpackage imports it.
"""
