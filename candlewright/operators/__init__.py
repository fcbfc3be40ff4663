"""Operators on bar series: DataFrame in, DataFrame out."""
