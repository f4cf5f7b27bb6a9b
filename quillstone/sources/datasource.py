"""SQL table function and data source over collections' JSON lines.

    register(spark)
    SELECT * FROM read_collection('/data/store', 'users')
    spark.read.format("quillstone").options(root="/data/store", collection="users").load()

Both read files that Python can open on the executors (local or mounted paths) and suit small collections and lookups
by _id. Collection.typed(), which sql.Session puts in place of read_collection(...) in its queries, reads every store in
parallel.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillstone import layout


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path


def _files(root: str, name: str) -> list[tuple[int, str, str]]:
    """(batch, kind, file) of a collection's lines, of committed batches from the last snapshot on."""
    root, found = _local(root), []
    base = layout.batches_dir(root, name)
    for n in sorted(os.listdir(base)) if os.path.isdir(base) else []:
        parsed = layout.parse_batch(n)
        if parsed and os.path.exists(f"{base}/{n}/_SUCCESS"):
            found += [(*parsed, f) for f in sorted(glob.glob(f"{base}/{n}/part-*"))]
    start = max((b for b, kind, _ in found if kind == "snapshot"), default=None)
    if start is not None:
        return [f for f in found if f[0] >= start]
    data = layout.data_file(root, name)
    docs = [(-2, "file", f) for f in sorted(glob.glob(f"{layout.docs_dir(root, name)}/*.json"))]
    return docs + ([(-1, "put", data)] if os.path.exists(data) else []) + found


def _versions(files: list[tuple[int, str, str]], ids: frozenset[str] | None = None) -> Iterator[tuple[str, dict | None]]:
    for _, kind, path in files:
        with open(path, encoding="utf-8") as f:
            for line in [f.read()] if kind == "file" else f:
                try:
                    doc = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(doc, dict):
                    continue
                own = os.path.basename(path)[:-5] if kind == "file" else doc.pop("_id", None)
                if own is not None and (ids is None or own in ids):
                    yield own, None if kind == "delete" else doc


def live(root: str, name: str, ids: frozenset[str] | None = None) -> dict[str, dict[str, Any]]:
    out: dict[str, dict[str, Any]] = {}
    for own, doc in _versions(_files(root, name), ids):
        if doc is None:
            out.pop(own, None)
        else:
            out[own] = doc
    return out


def _type(kinds: set[type]) -> Any:
    if kinds == {bool}:
        return BooleanType()
    if kinds == {int}:
        return LongType()
    return DoubleType() if kinds and kinds <= {int, float} else StringType()


def infer(root: str, name: str) -> StructType:
    """Top-level columns of all live documents, and _id last; arrays, objects and fields of mixed types are JSON text."""
    seen: dict[str, set[type]] = {}
    for doc in live(root, name).values():
        for k, v in doc.items():
            kinds = seen.setdefault(k, set())
            if v is not None:
                kinds.add(type(v))
    return StructType([StructField(k, _type(v)) for k, v in seen.items() if k != "_id"] + [StructField("_id", StringType())])


def _cell(value: Any, kind: Any) -> Any:
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return int(value) if isinstance(kind, LongType) else float(value)


def _row(own: str, doc: dict[str, Any], schema: StructType) -> tuple:
    return tuple(own if f.name == "_id" else _cell(doc.get(f.name), f.dataType) for f in schema.fields)


class ReadCollection:
    """read_collection(root, collection): the live documents as typed columns."""

    @staticmethod
    def analyze(root: AnalyzeArgument, collection: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=infer(str(root.value), str(collection.value)))

    def eval(self, root: str, collection: str) -> Iterator[tuple]:
        schema = infer(root, collection)
        for own, doc in live(root, collection).items():
            yield _row(own, doc, schema)


class _Part(InputPartition):
    def __init__(self, value: int, of: int):
        super().__init__(value)
        self.of = of


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.root, self.name, self.schema = options["root"], options["collection"], schema
        self.parts = int(options.get("partitions", "1"))
        self.ids: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and IN on _id narrow what is parsed and kept; the rest is left to Spark."""
        for f in filters:
            wanted = frozenset([f.value]) if isinstance(f, EqualTo) and f.attribute == ("_id",) else frozenset(f.value) if isinstance(f, In) and f.attribute == ("_id",) else None
            if wanted is None:
                yield f
            else:
                self.ids = wanted if self.ids is None else self.ids & wanted

    def partitions(self) -> list[InputPartition]:
        n = 1 if self.ids is not None else self.parts
        return [_Part(i, n) for i in range(n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        """Each part reads all lines and keeps the ids that hash to it, so that versions of an id meet."""
        import zlib

        for own, doc in live(self.root, self.name, self.ids).items():
            if partition.of == 1 or zlib.crc32(own.encode()) % partition.of == partition.value:
                yield _row(own, doc, self.schema)


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillstone"

    def schema(self) -> StructType:
        return infer(self.options["root"], self.options["collection"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.udtf.register("read_collection", udtf(ReadCollection))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CollectionSource)
