"""Operators for training-data corpora: one module each, DataFrames in and out."""
