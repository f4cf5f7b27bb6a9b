"""Sessions sized to the input."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What plans of this library count on: runtime re-planning, skewed joins split, small partitions joined, UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
SHUFFLE_BYTES = 128 << 20


def tuned(spark: SparkSession, input_bytes: int, shuffle_bytes: int = SHUFFLE_BYTES) -> SparkSession:
    """spark with SETTINGS, and as many shuffle partitions as keep one near shuffle_bytes, at least one a core."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.shuffle.partitions", str(max(spark.sparkContext.defaultParallelism, -(-input_bytes // shuffle_bytes))))
    return spark
