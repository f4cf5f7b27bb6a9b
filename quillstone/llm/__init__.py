"""Operators of a training-data pipeline; each module states its method, its columns and its edge cases."""
