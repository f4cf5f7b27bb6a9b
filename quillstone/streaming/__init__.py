"""Event-time operators that batch and streaming DataFrames share, and streaming collections."""
