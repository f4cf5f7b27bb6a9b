"""Collections as streams: committed lines as they arrive, and sinks that append one batch a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone import layout
from quillstone.store import Collection


def read_changes(collection: Collection, max_files: int | None = None) -> DataFrame:
    """A stream of versions: _id, doc and _kind of every committed put and deletion, new batches as they appear."""
    spark = collection.spark
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(layout.join(layout.batches_dir(collection.root.path, collection.name), "[0-9]*")).select("value", F.col("_metadata.file_path").alias("_path"))
    kind = F.substring_index(F.element_at(F.split("_path", "/"), -2), "-", -1)
    return lines.where(F.trim("value") != "").withColumn("doc", F.try_parse_json("value")).select(F.expr("try_variant_get(doc, '$._id', 'string')").alias("_id"), "doc", kind.alias("_kind")).where("_id IS NOT NULL")


def write_stream(df: DataFrame, collection: Collection, id_column: str, checkpoint: str) -> object:
    """A query that appends each micro-batch of df as one batch; a batch that runs again writes the same ids again, and the newest counts."""

    def append(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            collection.write(batch, id_column)

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append).start()
