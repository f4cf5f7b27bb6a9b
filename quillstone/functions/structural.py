"""Structural schemas: a document's shape, its canonical text and its id; and typed schemas of whole collections."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def structure(value: Any) -> Any:
    """Names of types in place of values; an array's is that of its first element."""
    if isinstance(value, dict):
        return {k: structure(v) for k, v in value.items()}
    if isinstance(value, list):
        return [structure(value[0])] if value else []
    for kind, name in ((str, "string"), (bool, "boolean"), (int, "integer"), (float, "number")):
        if isinstance(value, kind):
            return name
    return "null" if value is None else "unknown"


def schema_id_of(doc: Any) -> str:
    return hashlib.sha256(canonical(structure(doc)).encode()).hexdigest()


def _body(raw: str | None) -> Any:
    try:
        doc = json.loads(raw) if raw is not None else None
    except ValueError:
        return None
    return {k: v for k, v in doc.items() if k != "_id"} if isinstance(doc, dict) else doc


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """Canonical text of JSON text; null if malformed."""
    return raw.map(lambda r: None if (d := _body(r)) is None else canonical(d))


@F.pandas_udf(T.StringType())
def structure_text(raw: pd.Series) -> pd.Series:
    """Canonical structural schema of JSON text, its _id left out. Integers and floats differ, so the text is read and not a VARIANT."""
    return raw.map(lambda r: None if (d := _body(r)) is None else canonical(structure(d)))


def schema_id(raw: Column) -> Column:
    return F.sha2(structure_text(raw), 256)


def schema_counts(docs: DataFrame, raw: str = "_raw") -> DataFrame:
    """schema_id, schema and count of each structure among docs."""
    return docs.select(structure_text(F.col(raw)).alias("schema")).groupBy("schema").agg(F.count("*").alias("count")).select(F.sha2("schema", 256).alias("schema_id"), "schema", "count")


def infer(docs: DataFrame, doc: str = "doc") -> T.StructType:
    """The union of the documents' keys with merged types, from one aggregate; _id left out. Mixed types stay VARIANT."""
    text = docs.agg(F.schema_of_variant_agg(doc)).first()[0]
    if not text or not text.startswith("OBJECT<"):
        return T.StructType([])
    text = re.sub(r"DECIMAL\(\d+, ?\d+\)", "DOUBLE", text.replace("OBJECT<>", "STRING").replace("OBJECT<", "STRUCT<")).replace("VOID", "STRING")
    found = T._parse_datatype_string(text)
    return T.StructType([f for f in found.fields if f.name != "_id"])


def typed(docs: DataFrame, schema: T.StructType, doc: str = "doc", json_strings: bool = False) -> DataFrame:
    """A column for each field of schema, then _id. json_strings: arrays and objects as JSON text."""
    cols = []
    for f in schema.fields:
        path = "$['" + f.name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        quoted = "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        kind = "variant" if nested and json_strings else f.dataType.simpleString()
        value = F.expr(f"try_variant_get({doc}, {quoted}, '{kind}')")
        cols.append((F.to_json(value) if nested and json_strings else value).alias(f.name))
    return docs.select(*cols, "_id")
