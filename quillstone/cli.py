"""Command line: python -m quillstone.cli COMMAND PATH ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillstone import interop
from quillstone.errors import StoreError
from quillstone.operators.predicate import projection
from quillstone.sources import archive
from quillstone.store import Root


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstone", description="Collections of JSON documents.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for a in args:
            c.add_argument(a)
        return c

    add("init", "make a store and a collection", "path").add_argument("-c", "--collection", default="default")
    sub.choices["init"].add_argument("--strict", action="store_true")
    add("validate", "check a collection", "path").add_argument("-c", "--collection", default="default")
    sub.choices["validate"].add_argument("--fix", action="store_true")
    add("stats", "counts of a collection, or of all", "path").add_argument("-c", "--collection")
    sub.choices["stats"].add_argument("--json", action="store_true")
    add("pack", "make an archive of a store", "path", "archive")
    add("unpack", "extract an archive", "archive", "path")
    add("list", "collections of a store", "path")
    add("get", "print a document", "path", "id").add_argument("-c", "--collection", default="default")
    c = add("put", "write a document", "path", "id")
    c.add_argument("-c", "--collection", default="default")
    c.add_argument("--data", help="its JSON; read from standard input if missing")
    add("delete", "delete a document", "path", "id").add_argument("-c", "--collection", default="default")
    c = add("scan", "print documents", "path")
    c.add_argument("-c", "--collection", default="default")
    c.add_argument("--limit", type=int)
    c.add_argument("--fields", help="paths, comma-separated")
    c.add_argument("--jsonl", action="store_true")
    add("reindex", "compact a collection", "path").add_argument("-c", "--collection", default="default")
    add("import", "append a JSON file", "path", "file").add_argument("-c", "--collection", default="default")
    add("export", "write a JSON file", "path", "file").add_argument("-c", "--collection", default="default")
    c = add("sql", "query a collection, which the text calls data", "path", "query")
    c.add_argument("-c", "--collection", default="default")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.command == "pack":
            print(f"{archive.pack(a.path, a.archive)} files")
            return 0
        if a.command == "unpack":
            print(f"{archive.unpack(a.archive, a.path)} files")
            return 0
        spark = spark or SparkSession.builder.appName("quillstone").getOrCreate()
        return _run(a, spark)
    except (StoreError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    writes = a.command in ("init", "put", "delete", "reindex", "import") or (a.command == "validate" and a.fix)
    with Root(spark, a.path, "rw" if writes else "r") as root:
        if a.command == "list":
            print("\n".join(root.list_collections()))
            return 0
        if a.command == "stats":
            found = [root.collection(n).stats() for n in ([a.collection] if a.collection else root.list_collections())]
            print(json.dumps(found, indent=2) if a.json else "\n".join(f"{s['collection']}: {s['documents']} documents, {s['schemas']} schemas, {s['bytes']} bytes" for s in found))
            return 0
        c = root.collection(a.collection, strict=getattr(a, "strict", False), create=writes)
        if a.command == "validate":
            found = c.validate(fix=a.fix)
            print(json.dumps(found))
            return 0 if found["ok"] or a.fix else 1
        if a.command == "get":
            print(json.dumps(c.get(a.id), indent=2, ensure_ascii=False))
        elif a.command == "put":
            c.put(a.id, json.loads(a.data if a.data is not None else sys.stdin.read()))
            c.flush()
        elif a.command == "delete":
            c.delete(a.id)
            c.flush()
        elif a.command == "scan":
            return _scan(c, a)
        elif a.command == "reindex":
            print(f"{c.compact()} documents")
        elif a.command == "import":
            print(f"{interop.import_json(root, a.file, a.collection)} documents")
        elif a.command == "export":
            interop.export_json(c, a.file)
        elif a.command == "sql":
            from quillstone.sql import query

            for row in query(root, a.collection, a.query).toLocalIterator():
                print(json.dumps(row.asDict(recursive=True), default=str))
    return 0


def _scan(c: object, a: argparse.Namespace) -> int:
    docs = c.documents().orderBy("_ord")
    if a.limit is not None:
        docs = docs.limit(a.limit)
    if a.fields:
        docs = docs.select("_id", F.to_json(F.struct(*projection([f.strip() for f in a.fields.split(",")]))).alias("_raw"))
    n = 0
    for row in docs.select("_id", "_raw").toLocalIterator():
        doc = {"_id": row[0], **{k: v for k, v in json.loads(row[1]).items() if k != "_id"}}
        lead = "" if a.jsonl else "[" if n == 0 else ","
        print(lead + json.dumps(doc, ensure_ascii=False))
        n += 1
    if not a.jsonl:
        print("]" if n else "[]")
    print(f"{n} documents", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
