"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank + 1/2) / rows of its
source. Sorted by fractional rank, every stretch of rows has the sources in their overall proportions, so cutting the
order into equal parts gives shards that all match the mixture. Law: `rows` (row counts at most one apart).

Edge cases: a null source is a source of its own; null texts have size 8 and CRC 0; rows of null or equal ids
are told apart by their places in the table's files (in the pipeline, whose files differ from run to run, by the hash of
the text); an empty table gives an empty table; of the
input's columns only those named shard and slot are replaced; texts of any length move once and are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import bucket_count, column, drop_clashing, fresh, place_of, row_keys, running_sum, scratch, settle, sheltered, table, unit_hash, without

SHARDS = 24
SEED = 17
_ADDED = ["shard", "slot"]


def interleave(df: DataFrame, shards: int = SHARDS, tie: Column | None = None, seed: int = SEED, rows_per_slice: int = 256) -> DataFrame:
    """df (with doc_id, source) and two columns: shard int, slot long (gapless from 0 in each shard).

    tie: tells rows of one doc_id, or of none, apart; if not given, the CRC of text orders them.
    """
    rows = df.count()
    slices = bucket_count(rows, rows_per_slice)
    tagged, back = sheltered(
        df,
        _group=F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("source"))),
        _id=F.col("doc_id"),
        _tie=F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) if tie is None else tie,
    )
    tagged = tagged.withColumn("_u", unit_hash(F.col("_id"), *([] if tie is None else [F.col("_tie")]), F.lit("row"), seed=seed))
    ranked = running_sum(tagged, ["_group"], F.floor(F.col("_u") * slices), [F.col("_u"), F.col("_id"), F.col("_tie")], F.lit(1), "_rank", lambda t: t.withColumnRenamed("_total", "_n"))
    ranked = ranked.withColumn("_frac", (F.col("_rank") + 0.5) / F.col("_n"))
    placed = running_sum(ranked, [], F.floor(F.col("_frac") * slices), [F.col("_frac"), F.col("_group"), F.col("_u"), F.col("_id"), F.col("_tie")], F.lit(1), "_place")
    total = max(rows, 1)
    shard = F.expr(f"(_place * {shards}) div {total}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_place") - F.expr(f"(shard * bigint({total}) + {shards - 1}) div {shards}")).cast("long")).select(*without(back, df.columns, _ADDED), *_ADDED)


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with shard and slot, which replace columns of these names. Texts move once, to meet their places."""
    base = drop_clashing(docs, _ADDED)
    file, row = fresh([*docs.columns, *_ADDED], "_file", "_row")
    keyed = row_keys(base, file, row)
    with scratch(docs.sparkSession) as keep:
        narrow = settle(keyed.select(column(file).alias("file"), column(row).alias("row"), "doc_id", "source", F.xxhash64("text").alias("digest")), "shard-rows")
        places = keep(settle(interleave(narrow, shards, tie=F.col("digest")).select("file", "row", *_ADDED), "shard-places"))
    places = places.select(F.col("file").alias(file), F.col("row").alias(row), *_ADDED)
    return keyed.join(places.hint("merge"), [file, row]).select(*[column(c) for c in base.columns], *_ADDED)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    keyed = row_keys(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    narrow = keyed.select("doc_id", "source", (F.octet_length(raw) + 8).cast("long").alias("bytes"), F.crc32(raw).alias("text_crc32"), place_of(F.col("_file"), F.col("_row")).alias("place"))
    done = interleave(settle(narrow, "shard-rows"), tie=F.col("place"))
    return done.select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
