"""Stores and collections: the facade over layouts, versions, predicates and batches.

    root = Root.open(spark, "/data/store")
    users = root.collection("users")
    users.put("u1", {"name": "Ann", "age": 30})
    users.scan(predicate={"age": 30}).show()

Every committed write is one batch folder that appears by a rename; readers see the batches that were committed when
they look. A document's newest version counts, deletions last, and strict collections check every write.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone import layout
from quillstone.errors import CollectionNotFound, DamagedMetadata, DocumentNotFound, InvalidDocument, InvalidDocumentId, ReadOnlyStore, SchemaMismatch, StoreLocked
from quillstone.functions import structural
from quillstone.operators.latest import latest, with_positions
from quillstone.operators.predicate import Predicate, as_column, projection
from quillstone.sources.files import Files
from quillstone.sources.scan import committed, read_versions

MODES = ("r", "rw")
LEASE = 60.0  # seconds after which a lock that isn't renewed counts as left behind
_BAD_ID = "not a document id: "
_open: weakref.WeakValueDictionary = weakref.WeakValueDictionary()


class Root:
    """A folder of collections, open for reading ("r") or writing ("rw")."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "rw"):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.spark, self.path, self.mode, self.files = spark, str(path), mode, Files(spark)
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # of repeated keys in a document the last counts
        self._locked = False
        if mode == "rw":
            self.files.mkdirs(layout.collections_dir(self.path))

    @classmethod
    def open(cls, spark: SparkSession, path: str, mode: str = "rw") -> Root:
        """The same object for the same path and mode while it is in use."""
        key = (str(path), mode, id(spark))
        found = _open.get(key)
        if found is None:
            found = _open[key] = cls(spark, path, mode)
        return found

    @property
    def is_writable(self) -> bool:
        return self.mode == "rw"

    def collection(self, name: str, strict: bool = False, batch_size: int = 1000, create: bool = True) -> Collection:
        layout.validate_id(name)
        if not self.collection_exists(name):
            if not (create and self.is_writable):
                raise CollectionNotFound(f"no collection {name} in {self.path}")
            self.files.mkdirs(layout.docs_dir(self.path, name))
            self.files.mkdirs(layout.meta_dir(self.path, name))
            manifest = {"version": layout.VERSION, "collection": name, "strict": strict, "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
            self.files.write(layout.manifest_file(self.path, name), json.dumps(manifest))
        return Collection(self, name, batch_size, strict)

    def list_collections(self) -> list[str]:
        base = layout.collections_dir(self.path)
        return [n for n in self.files.list(base) if not n.startswith(".") and self.files.is_dir(layout.join(base, n))]

    def collection_exists(self, name: str) -> bool:
        return self.files.is_dir(layout.collection_dir(self.path, name))

    @contextmanager
    def write_lock(self, wait: float = 10.0, lease: float = LEASE) -> Iterator[Callable[[], None]]:
        """Held while a batch is committed; a file that only one writer can create, with its owner and time.

        The holder renews the time; a lock whose time is older than the lease was left by a writer that died and is
        taken over by one of those that wait. Yields a function that raises StoreLocked if the lock was lost meanwhile.
        """
        if self._locked:
            yield self._still_locked
            return
        path, until, owner = layout.lock_file(self.path), time.time() + wait, uuid.uuid4().hex
        held = lambda: json.dumps({"owner": owner, "time": time.time()})
        while True:
            try:
                self.files.write(path, held(), overwrite=False)
                break
            except Exception as e:
                self._take_over(path, lease)
                if time.time() > until:
                    raise StoreLocked(f"{path} is held by another writer") from e
                time.sleep(0.05)
        done = threading.Event()

        def still() -> None:
            if (self._lock_state(path) or {}).get("owner") != owner:
                raise StoreLocked(f"{path} was taken over by another writer")

        def renew() -> None:
            while not done.wait(lease / 4):
                try:
                    still()
                    self.files.write(path, held())
                except StoreLocked:
                    return
                except Exception:  # the next turn tries again; the lease allows for several
                    continue

        thread = threading.Thread(target=renew, daemon=True)
        thread.start()
        self._locked, self._still_locked = True, still
        try:
            yield still
        finally:
            self._locked = False
            done.set()
            thread.join()
            if (self._lock_state(path) or {}).get("owner") == owner:
                self.files.delete(path)

    def _lock_state(self, path: str) -> dict[str, Any] | None:
        try:
            return self.files.read_json(path)
        except Exception:  # being written, or gone between two calls
            return None

    def _take_over(self, path: str, lease: float) -> None:
        """Moves a lock aside that its holder hasn't renewed; of several writers one succeeds."""
        state = self._lock_state(path)
        if state and time.time() - state.get("time", 0) > lease:
            aside = f"{path}.{uuid.uuid4().hex}"
            try:
                self.files.rename(path, aside)
                self.files.delete(aside)
            except Exception:  # another writer was first
                return

    def __enter__(self) -> Root:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    def close(self) -> None:
        _open.pop((self.path, self.mode, id(self.spark)), None)


class Collection:
    """Documents by id. Reads are DataFrames; single-document calls run a small job each."""

    def __init__(self, root: Root, name: str, batch_size: int = 1000, strict: bool = False, batch_bytes: int = 10 << 20, batch_seconds: float = 1.0):
        self.root, self.name, self.spark = root, name, root.spark
        self.batch_size, self.batch_bytes, self.batch_seconds = batch_size, batch_bytes, batch_seconds
        self._pending: list[str] = []
        self._pending_kind, self._pending_bytes, self._since, self._held = "put", 0, 0.0, False
        self._manifest = self._load_manifest(strict)

    # Metadata

    def _load_manifest(self, strict: bool) -> dict[str, Any]:
        path = layout.manifest_file(self.root.path, self.name)
        try:
            found = self.root.files.read_json(path) or {"version": layout.VERSION, "collection": self.name, "strict": False}
        except ValueError as e:
            raise DamagedMetadata(f"{path} is no JSON") from e
        if strict and not found.get("strict"):
            found["strict"] = True
            if self.root.is_writable:
                self.root.files.write(path, json.dumps(found))
        return found

    @property
    def manifest(self) -> dict[str, Any]:
        return dict(self._manifest)

    @property
    def strict(self) -> bool:
        return bool(self._manifest.get("strict"))

    def _save_manifest(self, **changes: Any) -> None:
        self._manifest.update(changes)
        self.root.files.write(layout.manifest_file(self.root.path, self.name), json.dumps(self._manifest))

    # Reading

    def versions(self, mode: str = "PERMISSIVE") -> DataFrame:
        self.flush()
        return read_versions(self.spark, self.root.path, self.name, mode)

    def documents(self, mode: str = "PERMISSIVE") -> DataFrame:
        """_id, doc (VARIANT), _raw, _ord of the live documents. After a compaction nothing is left to choose from, and filters reach the scan."""
        self.flush()
        batches = committed(self.root.files, self.root.path, self.name)
        versions = read_versions(self.spark, self.root.path, self.name, mode)
        if len(batches) == 1 and batches[0][1] == "snapshot":
            return versions.select("_id", "doc", "_raw", "_ord")
        return latest(versions, deletes=any(kind == "delete" for _, kind, _ in batches))

    def scan(self, fields: list[str] | None = None, predicate: Predicate | dict[str, Any] | Column | None = None) -> DataFrame:
        """_id and doc of the documents that match; with fields, their values as VARIANT columns in place of doc."""
        found = self.documents().where(as_column(predicate))
        return found.select("_id", *(projection(fields) if fields else [F.col("doc")]))

    def scan_raw(self) -> DataFrame:
        """JSON text of each live document."""
        return self.documents().select("_raw")

    def blobs(self) -> DataFrame:
        """path, length and content (binary) of each committed file of lines as it lies there, old versions included; files of single documents are not among them."""
        paths = [f"{path}/part-*" for _, _, path in committed(self.root.files, self.root.path, self.name)]
        data = layout.data_file(self.root.path, self.name)
        paths += [data] if self.root.files.exists(data) else []
        if not paths:
            return self.spark.createDataFrame([], "path string, length long, content binary")
        return self.spark.read.format("binaryFile").load(paths).select("path", "length", "content")

    def preload(self) -> DataFrame:
        """documents(), kept in memory and on disk until unpersisted; later reads of the frame don't parse again."""
        kept = self.documents().persist()
        kept.count()
        return kept

    def typed(self, schema: T.StructType | str | None = None, json_strings: bool = False) -> DataFrame:
        """A column for each top-level key and _id last; the schema is inferred from all documents unless given."""
        docs = self.documents()
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        return structural.typed(docs, schema if schema is not None else structural.infer(docs), json_strings=json_strings)

    def ordered(self) -> DataFrame:
        """documents() with _pos, each document's place in order of first insertion."""
        return with_positions(self.documents(), ["_ord"])

    def get(self, doc_id: str) -> dict[str, Any]:
        found = self.get_or_none(doc_id)
        if found is None:
            raise DocumentNotFound(doc_id)
        return found

    def get_or_none(self, doc_id: str) -> dict[str, Any] | None:
        row = self.documents().where(F.col("_id") == doc_id).select("_raw").first()
        return None if row is None else _body(row[0])

    def get_many(self, ids: Iterable[str]) -> DataFrame:
        """_id and doc of those ids that exist."""
        wanted = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "_id string")
        return self.documents().join(wanted, "_id", "left_semi").select("_id", "doc")

    def get_at(self, position: int) -> dict[str, Any]:
        row = self.documents().orderBy("_ord").offset(position).limit(1).select("_raw").first() if position >= 0 else None
        if row is None:
            raise IndexError(position)
        return _body(row[0])

    def exists(self, doc_id: str) -> bool:
        return not self.documents().where(F.col("_id") == doc_id).isEmpty()

    def count(self) -> int:
        return self.documents().count()

    def ids(self) -> DataFrame:
        return self.documents().orderBy("_ord").select("_id")

    def is_empty(self) -> bool:
        return self.documents().isEmpty()

    # Writing

    def put(self, doc_id: str, doc: dict[str, Any]) -> None:
        layout.validate_id(doc_id)
        if not isinstance(doc, dict):
            raise InvalidDocument("a document must be an object")
        self._guard()
        body = {k: v for k, v in doc.items() if k != "_id"}
        if self.strict:
            self._check(structural.schema_id_of(body))
        self._append("put", json.dumps({"_id": doc_id, **body}, separators=(",", ":"), ensure_ascii=False))

    def put_many(self, docs: Iterable[tuple[str, dict[str, Any]]]) -> int:
        n = 0
        with self.bulk():
            for n, (doc_id, doc) in enumerate(docs, 1):  # noqa: B007
                self.put(doc_id, doc)
        return n

    def put_lines(self, lines: str | bytes) -> int:
        """JSON lines with _id each, as one batch; blank lines are skipped. Returns the number of documents."""
        self._guard()
        text = lines.decode() if isinstance(lines, bytes) else lines
        kept = [line for line in text.split("\n") if line.strip()]
        docs = [json.loads(line) for line in kept]
        for doc in docs:
            layout.validate_id(doc.get("_id") if isinstance(doc, dict) else None)
            if self.strict:
                self._check(structural.schema_id_of({k: v for k, v in doc.items() if k != "_id"}))
        self.flush()
        self._commit("put", kept)
        return len(kept)

    def write(self, df: DataFrame, id_column: str | None = None, id_prefix: str = "doc", digits: int = 6) -> int:
        """Appends df as documents in one distributed batch. Ids come from id_column, or are the prefix and each row's number."""
        self._guard()
        self.flush()
        if id_column is None:
            columns = df.columns
            named = with_positions(df, []).withColumn("_key", F.format_string(f"{id_prefix}%0{digits}d", "_pos"))
        else:
            columns = [c for c in df.columns if c != "_id"]
            named = df.withColumn("_key", F.col(id_column).cast("string"))
        body = F.to_json(F.struct(F.col("_key").alias("_id"), *[c for c in columns if c != "_id"]))
        if self.strict:
            for one in [r[0] for r in named.select(structural.schema_id(body)).distinct().limit(2).collect()]:
                self._check(one)
        invalid = F.raise_error(F.concat(F.lit(_BAD_ID), F.coalesce("_key", F.lit("null"))))
        checked = named.select(F.when(layout.valid_id(F.col("_key")), body).otherwise(invalid).alias("value"))
        staged, seen = self._staging(), Observation()
        try:
            checked.observe(seen, F.count(F.lit(1)).alias("n")).write.text(staged)
        except Exception as e:
            self.root.files.delete(staged)
            if _BAD_ID in str(e):
                raise InvalidDocumentId(f"invalid document id: {str(e).split(_BAD_ID, 1)[1].splitlines()[0]}") from e
            raise
        self._publish("put", staged)
        return seen.get["n"]

    def delete(self, doc_id: str, missing_ok: bool = False) -> None:
        self._guard()
        if not missing_ok and not self.exists(doc_id):
            raise DocumentNotFound(doc_id)
        self._append("delete", json.dumps({"_id": doc_id}))

    def delete_where(self, predicate: Predicate | dict[str, Any] | Column) -> None:
        """Deletes all documents that match, as one distributed batch."""
        self._guard()
        staged = self._staging()
        self.documents().where(as_column(predicate)).select(F.to_json(F.struct("_id")).alias("value")).write.text(staged)
        self._publish("delete", staged)

    @contextmanager
    def bulk(self) -> Iterator[Collection]:
        """Holds writes back until the block ends or the buffer is full of bytes."""
        self._held = True
        try:
            yield self
        finally:
            self._held = False
            self.flush()

    def flush(self) -> None:
        """Commits the buffer; if that fails the buffer is kept, so that flushing again loses nothing."""
        if self._pending:
            self._commit(self._pending_kind, self._pending)
            self._pending, self._pending_bytes = [], 0

    def _append(self, kind: str, line: str) -> None:
        if kind != self._pending_kind:
            self.flush()
        if not self._pending:
            self._since = time.monotonic()
        self._pending_kind = kind
        self._pending.append(line)
        self._pending_bytes += len(line)
        full = len(self._pending) >= self.batch_size or time.monotonic() - self._since >= self.batch_seconds
        if self._pending_bytes >= self.batch_bytes or (full and not self._held):
            self.flush()

    def _guard(self) -> None:
        if not self.root.is_writable:
            raise ReadOnlyStore(f"{self.root.path} is open for reading only")

    def _check(self, schema_id: str) -> None:
        wanted = self._manifest.get("schema_id")
        if wanted is None:
            first = self.documents().orderBy("_ord").select("_raw").first()
            wanted = structural.schema_id_of(_body(first[0])) if first is not None else schema_id
            self._save_manifest(schema_id=wanted)
        if schema_id != wanted:
            raise SchemaMismatch(f"collection {self.name} is strict: schema {schema_id[:12]} differs from {wanted[:12]}")

    def _staging(self) -> str:
        self.root.files.mkdirs(layout.batches_dir(self.root.path, self.name))
        return layout.join(layout.batches_dir(self.root.path, self.name), f"_staged-{time.time_ns()}")

    def _commit(self, kind: str, lines: list[str]) -> None:
        staged = self._staging()
        self.root.files.write(layout.join(staged, "part-00000.txt"), "".join(line + "\n" for line in lines))
        self.root.files.write(layout.join(staged, "_SUCCESS"), "")
        self._publish(kind, staged)

    def _publish(self, kind: str, staged: str) -> None:
        """Gives a finished folder the next number; the rename is the commit."""
        with self.root.write_lock() as still:
            base = layout.batches_dir(self.root.path, self.name)
            last = max((p[0] for n in self.root.files.list(base) if (p := layout.parse_batch(n))), default=-1)
            still()
            self.root.files.rename(staged, layout.join(base, layout.batch_name(last + 1, kind)))

    # Maintenance

    def compact(self) -> int:
        """Rewrites the live documents as a snapshot, then removes what it replaces. Returns the number of documents.

        The write lock is held from the listing of the batches on, so no batch can come between them and the snapshot.
        """
        self._guard()
        self.flush()
        with self.root.write_lock():
            self._rewrite()
        return self.count()

    def _rewrite(self) -> None:
        old = committed(self.root.files, self.root.path, self.name)
        staged = self._staging()
        docs = self.documents()
        body = F.when(F.get_json_object("_raw", "$._id") == F.col("_id"), F.col("_raw")).otherwise(F.regexp_replace("_raw", r"^\s*\{\s*(\}?)", F.concat(F.lit('{"_id":"'), F.col("_id"), F.lit('"'), F.when(F.col("_raw").rlike(r"^\s*\{\s*\}"), F.lit("$1")).otherwise(F.lit(",$1")))))
        flat = F.regexp_replace(body, r"\s*\n\s*", " ")
        docs.repartitionByRange("_ord").sortWithinPartitions("_ord").select(flat.alias("value")).write.text(staged)
        self._publish("snapshot", staged)
        for _, _, path in old:
            self.root.files.delete(path)
        self.root.files.delete(layout.data_file(self.root.path, self.name))
        self.root.files.delete(layout.docs_dir(self.root.path, self.name))
        self.root.files.mkdirs(layout.docs_dir(self.root.path, self.name))

    def uncommitted(self) -> list[str]:
        """Folders of batches that were begun and never committed."""
        base = layout.batches_dir(self.root.path, self.name)
        return [n for n in self.root.files.list(base) if n.startswith("_staged-") or (layout.parse_batch(n) and not self.root.files.exists(layout.join(base, n, "_SUCCESS")))]

    def stats(self) -> dict[str, Any]:
        row = self.documents().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_raw")), F.lit(0)).alias("b"), F.count_distinct(structural.structure_text(F.col("_raw"))).alias("s")).first()
        return {"collection": self.name, "documents": row["n"], "bytes": row["b"], "schemas": row["s"], "strict": self.strict, "batches": len(committed(self.root.files, self.root.path, self.name))}

    def schemas(self) -> DataFrame:
        return structural.schema_counts(self.documents())

    @property
    def strict_schema_id(self) -> str | None:
        """The schema that a strict collection holds its documents to, if it has one yet."""
        return self._manifest.get("schema_id") if self.strict else None

    def schema(self, schema_id: str) -> dict[str, Any] | None:
        """One structural schema by its id, as a nested dict of type names."""
        row = self.schemas().where(F.col("schema_id") == schema_id).select("schema").first()
        return None if row is None else json.loads(row[0])

    def save_schemas(self) -> DataFrame:
        """Writes schema_id, schema and count as JSON lines beside the manifest, in place of those saved before."""
        self._guard()
        self.schemas().write.mode("overwrite").json(self._schemas_path())
        return self.load_schemas()

    def load_schemas(self) -> DataFrame:
        """The schemas saved last."""
        return self.spark.read.schema("schema_id string, schema string, count long").json(self._schemas_path())

    def _schemas_path(self) -> str:
        return layout.join(layout.meta_dir(self.root.path, self.name), "schemas")

    def validate(self, fix: bool = False) -> dict[str, Any]:
        """Malformed lines, invalid ids, and leftovers of broken commits; fix removes the leftovers."""
        docs, left = self.documents(), self.uncommitted()
        bad = docs.where(~layout.valid_id(F.col("_id"))).count()
        empty = docs.where(~F.schema_of_variant("doc").startswith("OBJECT")).count()
        if fix:
            self._guard()
            for n in left:
                self.root.files.delete(layout.join(layout.batches_dir(self.root.path, self.name), n))
        return {"documents": docs.count(), "invalid_ids": bad, "not_objects": empty, "uncommitted": left, "ok": not (bad or empty or left)}

    # Other views

    def dataset(self) -> Any:
        from quillstone.operators.dataset import MapDataset

        return MapDataset(self.ordered().select("_id", "doc", "_raw", "_pos"))

    def iterable(self) -> Any:
        from quillstone.operators.dataset import IterableDataset

        return IterableDataset(self.documents().select("_id", "doc", "_raw", "_ord").orderBy("_ord"))

    def close(self) -> None:
        if self.root.is_writable:
            self.flush()

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    def __contains__(self, doc_id: str) -> bool:
        return self.exists(doc_id)

    def __getitem__(self, doc_id: str) -> dict[str, Any]:
        return self.get(doc_id)

    def __setitem__(self, doc_id: str, doc: dict[str, Any]) -> None:
        self.put(doc_id, doc)

    def __delitem__(self, doc_id: str) -> None:
        self.delete(doc_id)

    def __len__(self) -> int:
        return self.count()

    def __iter__(self) -> Iterator[str]:
        return (r[0] for r in self.ids().toLocalIterator())

    def __repr__(self) -> str:
        return f"Collection({self.root.path!r}, {self.name!r})"


def _body(raw: str) -> dict[str, Any]:
    doc = json.loads(raw)
    return {k: v for k, v in doc.items() if k != "_id"} if isinstance(doc, dict) else doc
