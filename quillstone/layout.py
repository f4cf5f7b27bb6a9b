"""Names within a store: <root>/collections/<name>/{docs,meta,batches}.

docs/<id>.json and meta/data.jsonl are read where other writers left them. What this library writes are batches, one
folder for each commit, named by number and kind: puts and deletes hold JSON lines with _id, a snapshot replaces
everything before it. A folder without _SUCCESS was never committed and is ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.errors import InvalidDocumentId

VERSION = "1.0"
ID_PATTERN = r"\A(?!\.)(?!.*\.\.)[\p{IsAlphabetic}\p{N}_.-]+\z"
KINDS = ("put", "delete", "snapshot")
_BATCH = re.compile(r"^(\d{9})-(put|delete|snapshot)$")


def join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *parts[1:]])


def collections_dir(root: str) -> str:
    return join(root, "collections")


def collection_dir(root: str, name: str) -> str:
    return join(root, "collections", name)


def docs_dir(root: str, name: str) -> str:
    return join(collection_dir(root, name), "docs")


def meta_dir(root: str, name: str) -> str:
    return join(collection_dir(root, name), "meta")


def batches_dir(root: str, name: str) -> str:
    return join(collection_dir(root, name), "batches")


def data_file(root: str, name: str) -> str:
    return join(meta_dir(root, name), "data.jsonl")


def manifest_file(root: str, name: str) -> str:
    return join(meta_dir(root, name), "manifest.json")


def order_file(root: str, name: str) -> str:
    return join(meta_dir(root, name), "order.ids")


def lock_file(root: str) -> str:
    return join(root, ".write.lock")


def batch_name(number: int, kind: str) -> str:
    return f"{number:09d}-{kind}"


def parse_batch(name: str) -> tuple[int, str] | None:
    found = _BATCH.match(name)
    return (int(found[1]), found[2]) if found else None


def validate_id(doc_id: str) -> str:
    """doc_id if it is letters, digits, _, - and ., not led by a dot and without two dots in a row; else InvalidDocumentId."""
    if not isinstance(doc_id, str) or not doc_id:
        raise InvalidDocumentId("a document id must be a non-empty string")
    if doc_id[0] == "." or ".." in doc_id or any(not (c.isalnum() or c in "_-.") for c in doc_id):
        raise InvalidDocumentId(f"invalid document id: {doc_id!r}")
    return doc_id


def valid_id(doc_id: Column) -> Column:
    """The same rule over a column; null is invalid."""
    return F.coalesce(doc_id.rlike(ID_PATTERN), F.lit(False))
