"""JSON text to VARIANT and back, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(raw: Column, lenient: bool = True) -> Column:
    """A VARIANT; malformed text gives null, or fails if not lenient."""
    return F.try_parse_json(raw) if lenient else F.parse_json(raw)


def encode(doc: Column) -> Column:
    """Compact text with sorted keys; 1.0 reads 1, so use the raw text where that matters."""
    return F.to_json(doc)


def pretty(value: Column) -> Column:
    """Indented text of a struct, map or array."""
    return F.to_json(value, {"pretty": "true"})


def size_of(doc: Column) -> Column:
    """Bytes of the compact text."""
    return F.octet_length(F.to_json(doc))
