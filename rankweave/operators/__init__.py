"""Operators over DataFrames, one module per family."""
