"""Access to the parquet tables of a data folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Runs text with the named tables bound as `{name}` placeholders, without touching the session's catalog."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; only in local mode can that be a temporary folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='quillstone-')).rstrip('/')}/store-{uuid.uuid4().hex}"
