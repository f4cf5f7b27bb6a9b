"""Collections as DataFrames of versions: _id, doc (VARIANT), _raw (its JSON text), _kind and _ord.

_ord orders versions as they were written: batch, file, split, line. Malformed lines and lines without _id are skipped,
or fail with mode="FAILFAST".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import layout
from quillstone.sources.files import Files

_EMPTY = "_id string, doc variant, _raw string, _kind string, _ord struct<batch: bigint, file: string, split: bigint, line: bigint>"
DOCS, LINES = -2, -1  # batches of the two layouts of other writers


def _parsed(raw: Column, mode: str) -> Column:
    return F.parse_json(raw) if mode == "FAILFAST" else F.try_parse_json(raw)


def _lines(spark: SparkSession, paths: list[str], batch: Column, kind: Column, mode: str) -> DataFrame:
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    found = lines.where(F.trim("value") != "").withColumn("doc", _parsed(F.col("value"), mode))
    order = F.struct(batch.alias("batch"), "file", "split", "line")
    named = found.select(F.expr("try_variant_get(doc, '$._id', 'string')").alias("_id"), "doc", F.col("value").alias("_raw"), kind.alias("_kind"), order.alias("_ord"))
    return named.where("_id IS NOT NULL")


def read_lines(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Versions in JSON-lines files."""
    return _lines(spark, [path], F.lit(LINES).cast("bigint"), F.lit("put"), mode)


def read_documents(spark: SparkSession, folder: str, order: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Versions in a folder of one JSON file a document, named by id; in the order of the ids in the file `order`, then by id."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    named = files.select(F.url_decode(F.regexp_replace(F.regexp_replace("name", r"\.json$", ""), r"\+", "%2B")).alias("_id"), _parsed(F.col("value"), mode).alias("doc"), F.col("value").alias("_raw")).where("doc IS NOT NULL")
    place = F.lit(None).cast("bigint")
    if order is not None:
        ranks = spark.read.text(order).select(F.trim("value").alias("_id"), F.monotonically_increasing_id().alias("_rank")).groupBy("_id").agg(F.min("_rank").alias("_rank"))
        named, place = named.join(ranks, "_id", "left"), F.col("_rank")
    last = F.lit((1 << 62)).cast("bigint")
    return named.select("_id", "doc", "_raw", F.lit("put").alias("_kind"), F.struct(F.lit(DOCS).cast("bigint").alias("batch"), F.col("_id").alias("file"), F.coalesce(place, last).alias("split"), F.lit(0).cast("bigint").alias("line")).alias("_ord"))


def committed(files: Files, root: str, name: str) -> list[tuple[int, str, str]]:
    """(number, kind, path) of the committed batches from the last snapshot on."""
    base, found = layout.batches_dir(root, name), []
    for n in files.list(base):
        parsed = layout.parse_batch(n)
        if parsed and files.exists(layout.join(base, n, "_SUCCESS")):
            found.append((*parsed, layout.join(base, n)))
    start = max((i for i, kind, _ in found if kind == "snapshot"), default=-1)
    return [b for b in found if b[0] >= start]


def read_versions(spark: SparkSession, root: str, name: str, mode: str = "PERMISSIVE") -> DataFrame:
    """All versions of a collection, of whichever layouts it has."""
    files, parts = Files(spark), []
    batches = committed(files, root, name)
    if not any(kind == "snapshot" for _, kind, _ in batches):
        if files.exists(layout.data_file(root, name)):
            parts.append(read_lines(spark, layout.data_file(root, name), mode))
        if any(n.endswith(".json") for n in files.list(layout.docs_dir(root, name))):
            order = layout.order_file(root, name)
            parts.append(read_documents(spark, layout.docs_dir(root, name), order if files.exists(order) and files.size(order) else None, mode))
    if batches:  # one scan of all batches; number and kind come from the path
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        number, kind = F.substring_index(folder, "-", 1).cast("bigint"), F.substring_index(folder, "-", -1)
        lines = spark.read.text([p for _, _, p in batches]).select("value", F.col("_metadata.file_path").alias("file"), number.alias("batch"), kind.alias("_kind"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
        found = lines.where(F.trim("value") != "").withColumn("doc", _parsed(F.col("value"), mode))
        parts.append(found.select(F.expr("try_variant_get(doc, '$._id', 'string')").alias("_id"), "doc", F.col("value").alias("_raw"), "_kind", F.struct("batch", "file", "split", "line").alias("_ord")).where("_id IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _EMPTY)
