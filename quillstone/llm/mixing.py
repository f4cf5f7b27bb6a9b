"""Mixing sources to target weights, with DataFrame functions only.

Each source's target is found by water-filling: weights share the total, no target passes `cap` times its source's
size, and the excess is shared again by weight. A source takes floor(target / size) complete epochs; the rest of its
target comes from Efraimidis-Spirakis sampling without replacement: each document gets the exponential key -ln(u) / w,
w its quality weight, and documents are taken in key order until the prefix sum of sizes passes the remaining budget
at the middle of a document, so the words taken differ from the target by half a document at most.

Edge cases: a null source is a source of its own and comes last; null texts have size 0; documents without a label
weigh UNLABELLED; null or repeated ids have equal keys (in the pipeline the hash of the text tells them apart);
repeated rows are separate documents; an empty table gives an empty table; of the input's columns only those named like an added one
are replaced; texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.shared import bucket_count, column, fresh, row_keys, running_sum, scratch, settle, sheltered, table, unit_hash, without

SOURCE_WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 23
GOOD, BAD, UNLABELLED = 1.0, 0.25, 0.5
_CHUNK = 1 << 16
_ADDED = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_group, source_size, target) of each source, from (_group, _total). One row a source, so one task holds them.

    In order of cap * size / weight the capped sources come first. The level is what remains of the total, divided by
    the remaining weights, at the first source that stays under its cap.
    """
    nth = F.row_number().over(Window.partitionBy().orderBy("_group")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_ratio = Window.partitionBy().orderBy("_ratio", "_group").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sources.withColumn("_w", weight)
        .withColumn("_limit", F.col("_total") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_limit") / F.col("_w"))
        .withColumn("_left", F.sum("_total").over(everything) - F.coalesce(F.sum("_limit").over(by_ratio), F.lit(0.0)))
        .withColumn("_left_w", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_left_w"))
    )
    first_free = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_group", "_level"))).over(everything)["_level"]
    return level.withColumn("target", F.least(F.col("_limit"), F.coalesce(first_free * F.col("_w"), F.col("_limit")))).select("_group", F.col("_total").alias("source_size"), "target")


def mix(df: DataFrame, quality: Column | None = None, weights: tuple[int, ...] = SOURCE_WEIGHTS, cap: int = CAP, seed: int = SEED, rows_per_slice: int = 256, size: Column | None = None, tie: Column | None = None, times: Column | None = None) -> DataFrame:
    """df (with doc_id, source, and text unless size and tie are given) and size, source_size, target, copies (how often the mix takes the document), taken (words).

    quality: a positive sampling weight of each document, all 1 if not given. tie: tells documents of one doc_id, or of none, apart, if given. times: how many equal documents a row
    stands for, each of which the result has.
    """
    tagged, back = sheltered(
        df,
        size=word_count(F.col("text")) if size is None else size,
        _quality=F.lit(1.0) if quality is None else quality,
        _group=F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("source"))),
        _id=F.col("doc_id"),
        _times=F.lit(1) if times is None else times,
        **({} if tie is None else {"_tie": tie}),
    )
    told = [F.col("_id")] if tie is None else [F.col("_id"), F.col("_tie")]
    tagged = tagged.withColumn("_key", -F.ln(unit_hash(*told, F.lit("mix"), seed=seed)) / F.col("_quality"))
    # Keys mix exponential laws, one a weight; their joint distribution function deals them evenly to slices. Weights count by powers of two: at most 41 classes.
    classes = tagged.groupBy(F.least(F.lit(20), F.greatest(F.lit(-20), F.round(F.log2("_quality")).cast("int"))).alias("c")).count().collect()
    rows = sum(r["count"] for r in classes)
    slices = bucket_count(rows, rows_per_slice)
    share = F.lit(0.0)
    for r in sorted(classes, key=lambda r: r["c"]):
        share = share + F.lit(r["count"] / rows) * (F.lit(1.0) - F.exp(-F.col("_key") * F.lit(2.0 ** r["c"])))
    ranked = running_sum(tagged, ["_group"], F.floor(share * slices), [F.col("_key"), F.col("_id"), F.col("size")], F.col("size") * F.col("_times"), "_before", lambda t: water_fill(t, weights, cap))
    if times is not None:
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_times - 1) div {_CHUNK}")))
        inside = F.explode(F.sequence(F.col("_chunk") * _CHUNK, F.least(F.col("_times"), (F.col("_chunk") + 1) * _CHUNK) - 1))
        ranked = ranked.withColumn("_chunk", chunk).withColumn("_nth", inside).withColumn("_before", F.col("_before") + F.col("_nth") * F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    copies = epochs + F.when(F.col("_before") + F.col("size") / 2 < rest, 1).otherwise(0)
    return ranked.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).select(*without(back, df.columns, _ADDED), *_ADDED)


def with_quality(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df (with doc_id) and _quality, a weight from labels.quality; several labels of a document count as the best of them."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("best"))
    weight = F.when(F.col("best") == 1, GOOD).when(F.col("best") == 0, BAD).otherwise(UNLABELLED)
    return df.join(best, "doc_id", "left").withColumn("_quality", weight).drop("best")


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it. Texts move once, to meet the decisions. Rows without a source are a source, those of size 0 are taken with the complete epochs."""
    file, row, copies, copy = fresh(docs.columns, "_file", "_row", "_copies", "_copy")
    keyed = row_keys(docs, file, row)
    with scratch(docs.sparkSession) as keep:
        narrow = keyed.select(column(file).alias("file"), column(row).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("digest"))
        narrow = settle(with_quality(narrow, labels), "mix")
        taken = mix(narrow, F.col("_quality"), size=F.col("words"), tie=F.col("digest"))
        taken = keep(settle(taken.where("copies > 0").select("file", "row", "copies"), "mix-taken"))
    taken = taken.select(F.col("file").alias(file), F.col("row").alias(row), F.col("copies").alias(copies))
    copied = keyed.join(taken.hint("merge"), [file, row])
    return copied.select(*[column(c) for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy)).drop(copy)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    narrow = settle(with_quality(docs, table(spark, sf_dir, "labels")), "mix")
    # Documents that the law can't tell apart are ranked as one row, so null or repeated ids crowd no slice.
    once = narrow.groupBy("doc_id", "source", "words", "_quality").agg(F.count("*").alias("times"))
    return mix(once, F.col("_quality"), size=F.col("words"), times=F.col("times")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), q AS (
  SELECT doc_id, max(quality) AS best FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), k AS (
  SELECT d.*, -ln((CAST('0x' || substr(md5('23:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / CASE WHEN best = 1 THEN 1.0::DOUBLE WHEN best = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS key
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id
), s AS (
  SELECT source, sum(size)::DOUBLE AS total,
    CASE (row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * total AS lim, 3 * total / w AS ratio FROM s
), l AS (
  SELECT *, (sum(total) OVER () - coalesce(sum(lim) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT source, total, lim, w, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source IS NULL, encode(source) LIMIT 1) AS lev FROM l
), t AS (
  SELECT source, total, least(lim, coalesce(lev * w, lim)) AS target FROM f
), p AS (
  SELECT k.*, t.total, t.target,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
    CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(epochs + CASE WHEN before + size / 2.0::DOUBLE < target - epochs * total THEN 1 ELSE 0 END AS BIGINT) AS copies FROM p
)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target, CAST(size * copies AS BIGINT) AS taken, source, copies FROM c
"""
