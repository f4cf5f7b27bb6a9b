"""Operators that extend DataFrames: predicates, datasets, latest-wins views and joins Spark has no syntax for."""
