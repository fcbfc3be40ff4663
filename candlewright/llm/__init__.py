"""Operators that prepare text corpora for training, built on DataFrames."""
