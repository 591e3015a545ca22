"""Operators for preparing large text corpora, on Spark DataFrames.

Shared behaviour: an operator reads only the columns it is told to (extra
columns, also ones whose names clash with its outputs, are ignored), gives one
output row per input row, repeated rows included, and gives an empty result
with the full schema for an empty table.
"""
