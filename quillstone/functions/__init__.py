"""Column functions: vectors, JSON and structural schemas."""
