"""Latest-wins views over versions, and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(versions: DataFrame, deletes: bool = True) -> DataFrame:
    """One row for each live _id: its newest doc and _raw, and _ord of its first version (since its last deletion).

    A filter on the result runs after the choice, so an old version never comes back; filters on _id alone are pushed
    below it. deletes=False says that no version is a deletion, which saves finding each id's last one. Only the text of a
    version is shuffled; the VARIANT is read from it again afterwards, where it is used.
    """
    if not deletes:
        one = versions.groupBy("_id").agg(F.max_by("_raw", "_ord").alias("_raw"), F.min("_ord").alias("_ord"))
        return one.select("_id", F.parse_json("_raw").alias("doc"), "_raw", "_ord")
    gone = versions.where("_kind = 'delete'").groupBy("_id").agg(F.max("_ord").alias("_gone"))
    since = F.when((F.col("_kind") != "delete") & (F.col("_gone").isNull() | (F.col("_ord") > F.col("_gone"))), F.col("_ord"))
    grouped = versions.join(gone, "_id", "left").groupBy("_id").agg(F.max_by(F.struct("_raw", "_kind"), "_ord").alias("_new"), F.min(since).alias("_since"))
    return grouped.where("_new._kind != 'delete'").select("_id", F.parse_json("_new._raw").alias("doc"), "_new._raw", F.col("_since").alias("_ord"))


def merge(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base with the newest of changes for each key: an upsert over typed rows with the same columns."""
    both = base.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_new")).select(key, "_new.*")


def with_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """df, sorted, and _pos: 0, 1, 2, ... in that order; without order, in the order of its partitions and their rows.

    Range-partitioned and sorted once and kept; each partition's count gives the next one's first position, so no task
    sees all rows.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()).persist()
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # one row a partition
    first, total = [], 0
    for part, n in counts:
        first.append((part, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(first, "_part int, _first bigint"))
    return placed.join(starts, "_part").withColumn("_pos", F.col("_mono").bitwiseAND((1 << 33) - 1) + F.col("_first")).drop("_part", "_mono", "_first")
