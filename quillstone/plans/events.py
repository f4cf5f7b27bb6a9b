"""Folds and event-time windows over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.plans.registry import both, query
from quillstone.plans.tables import shared_folder, table
from quillstone.streaming.windows import session_totals, sliding_counts, tumbling_counts

both("event_type_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type", "events")
both(
    "batched_fold",
    """SELECT CAST(floor((event_id - least_id) / 1000) AS BIGINT) AS batch, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(sum(value), 4) AS total
       FROM (SELECT *, (SELECT min(event_id) FROM {events}) AS least_id FROM {events}) GROUP BY 1""",
    "events",
)


@query("win_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def win_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(table(spark, sf_dir, "events"), "1 day")


@query(
    "win_sliding",
    """SELECT strftime(time_bucket(INTERVAL 12 HOUR, ts) - to_hours(12 * k), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n
       FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""",
)
def win_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_counts(table(spark, sf_dir, "events"), "1 day", "12 hours")


@query(
    "win_session",
    """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
            s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""",
)
def win_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_totals(table(spark, sf_dir, "events"), "6 hours")


@query("label_distribution", "SELECT label, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM embeddings), 6) AS share FROM embeddings GROUP BY label")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return counts.select("label", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily counts of a stream of the event files; each window's last update is kept."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    counts, path = tumbling_counts(stream, "1 day"), shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:06d}")

    counts.writeStream.outputMode("update").option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    updates = spark.read.parquet(path)
    return updates.groupBy("start", "event_type").agg(F.max_by("n", "_batch").alias("n"))
