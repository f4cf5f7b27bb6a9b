"""quillstone: analytics over collections of schema-flexible JSON documents, on Spark DataFrames and SQL."""

from __future__ import annotations

import importlib
from typing import Any

__version__ = "0.1.0"

_EXPORTS = {
    "Root": "store",
    "Collection": "store",
    "Session": "sql",
    "query": "sql",
    "aggregate": "sql",
    "count_where": "sql",
    "copy_to": "sql",
    "MapDataset": "operators.dataset",
    "IterableDataset": "operators.dataset",
    "Eq": "operators.predicate",
    "Exists": "operators.predicate",
    "NotExists": "operators.predicate",
    "And": "operators.predicate",
    "Or": "operators.predicate",
    "Matches": "operators.predicate",
    "read_pandas": "interop",
    "write_pandas": "interop",
    "read_arrow": "interop",
    "write_arrow": "interop",
    "write_dataset": "interop",
    "to_dataset": "interop",
    "to_dataset_dict": "interop",
    "load_remote": "sources.hub",
    "dataset_info": "sources.hub",
    "list_remote_collections": "sources.hub",
    "clear_cache": "sources.hub",
    "schema_id_of": "functions.structural",
    "validate_id": "layout",
}
__all__ = ["__version__", "backend", *_EXPORTS]


def backend() -> str:
    """What runs the plans."""
    import pyspark

    return f"spark {pyspark.__version__}"


def __getattr__(name: str) -> Any:
    if name in _EXPORTS:
        return getattr(importlib.import_module(f"quillstone.{_EXPORTS[name]}"), name)
    raise AttributeError(f"module 'quillstone' has no attribute {name!r}")
