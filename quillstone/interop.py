"""pandas, Arrow, CSV, JSON and dataset-library interchange."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.store import Collection, Root


def read_pandas(root: Root, collection: str, columns: list[str] | None = None) -> pd.DataFrame:
    """A collection as a pandas frame; an empty one for an empty or missing collection of an existing root."""
    if not root.collection_exists(collection):
        return pd.DataFrame(columns=columns or [])
    df = root.collection(collection).typed()
    wanted = df.columns if columns is None else [c for c in columns if c in df.columns]
    return df.select(*wanted).toPandas()


def write_pandas(root: Root, frame: pd.DataFrame, collection: str, id_column: str | None = None, strict: bool = False) -> int:
    """Appends a frame's rows; ids from a column, or doc000000, doc000001, ..."""
    if not len(frame):
        return 0
    return root.collection(collection, strict=strict).write(root.spark.createDataFrame(frame), id_column)


def read_arrow(root: Root, collection: str) -> pa.Table:
    """A collection as an Arrow table; fields that a document lacks are null in its row."""
    return root.collection(collection, create=False).typed().toArrow()


def write_arrow(root: Root, table: pa.Table, collection: str, id_column: str | None = None) -> int:
    return root.collection(collection).write(root.spark.createDataFrame(table), id_column) if table.num_rows else 0


def arrow_batches(root: Root, collection: str, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A collection in Arrow batches of up to `rows`, one partition on the driver at a time."""
    df = root.collection(collection, create=False).typed()
    schema, held = None, []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict(recursive=True))
        if len(held) == rows:
            batch = pa.RecordBatch.from_pylist(held, schema)
            schema, held = batch.schema if schema is None else schema, []
            yield batch
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def write_dataset(root: Root, dataset: Any, collection: str | None = None, id_column: str | None = None) -> dict[str, int]:
    """Appends a dataset (anything with to_pandas()), or a dict of them by split, one collection each; ids doc_00000000, ..."""
    parts = dict(dataset) if hasattr(dataset, "items") else {collection or "main": dataset}
    out = {}
    for name, part in parts.items():
        frame = part if isinstance(part, pd.DataFrame) else part.to_pandas()
        out[name] = root.collection(name).write(root.spark.createDataFrame(frame), id_column, "doc_", 8) if len(frame) else 0
    return out


def to_dataset(root: Root, collection: str) -> Any:
    """A collection as a dataset of the `datasets` library; needs that library."""
    import datasets

    return datasets.Dataset(read_arrow(root, collection))


def to_dataset_dict(root: Root, collections: list[str] | None = None) -> Any:
    import datasets

    return datasets.DatasetDict({name: to_dataset(root, name) for name in collections or root.list_collections()})


def import_json(root: Root, path: str, collection: str) -> int:
    """Appends a JSON array or object of documents; ids from _id, or import_0, import_1, ..."""
    loaded = json.loads(root.files.read(path))
    docs = loaded if isinstance(loaded, list) else [loaded]
    return root.collection(collection).put_many((str(d.get("_id", f"import_{i}")), d) for i, d in enumerate(docs))


def import_table(root: Root, df: DataFrame, collection: str, id_column: str | None = None) -> int:
    """Appends any DataFrame: spark.read.csv, parquet, orc, json, ..."""
    return root.collection(collection).write(df, id_column)


def export_json(collection: Collection, path: str) -> None:
    """A JSON array of all documents with _id, in order; for collections that fit the driver."""
    rows = collection.documents().orderBy("_ord").select("_id", "_raw").toLocalIterator()
    docs = [{"_id": r[0], **{k: v for k, v in json.loads(r[1]).items() if k != "_id"}} for r in rows]
    collection.root.files.write(path, json.dumps(docs, indent=2, ensure_ascii=False))


def export_table(collection: Collection, path: str, kind: str = "parquet") -> None:
    """The typed view as a folder of parquet, orc, json or csv files; csv and the like hold nested columns as JSON text."""
    df = collection.typed(json_strings=kind == "csv")
    (df.write.option("header", "true") if kind == "csv" else df.write).format(kind).save(path)


def merged(left: Collection, right: Collection, prefixes: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Typed rows of both, ids prefixed; columns that one lacks are null."""
    a, b = (c.typed().withColumn("_id", F.concat(F.lit(p), "_id")) for c, p in zip((left, right), prefixes, strict=True))
    return a.unionByName(b, allowMissingColumns=True)
