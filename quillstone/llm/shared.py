"""What the operators share: shared-folder tables, balanced ranking, table reading."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.sources.files import Files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can see: spark.checkpoint.dir; where that is unset, one of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors.

    The shuffle files of the job go as soon as it ends, as nothing reads them again.
    """
    path = shared_path(df.sparkSession, label)
    _scope.paths.append(path)
    with brief_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Scope(threading.local):
    """Folders that settle() has written in the innermost scratch() of this thread."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_scope = _Scope()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes what settle() writes inside when the block ends, but for the tables given to the function it yields.

    What leaves the block must read none of the tables that go.
    """
    outer, kept = _scope.paths, set()
    _scope.paths = []

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_scope.paths[-1])
        return df

    try:
        yield keep
    finally:
        own, _scope.paths = _scope.paths, outer
        outer += [p for p in own if p in kept]
        for path in own:
            if path not in kept:
                Files(spark).delete(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Has the shuffle files of the jobs inside removed when they end."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before)


def bucketed(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """Like settle(), as a table bucketed by a column: grouping by it or joining on it later moves no row of the table."""
    spark, buckets = df.sparkSession, min(buckets, 1 << 14)
    path = shared_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with brief_shuffles(spark):
        df.repartition(buckets, column).write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).sortBy(column).format("parquet").saveAsTable(name)
    return spark.table(name)


def to_rows(rows: DataFrame, values: DataFrame, key: str | list[str], part: Column | None = None, parts: int = 64) -> DataFrame:
    """rows and the columns of values (one row a key, of one column or several), for rows whose key has values.

    Rows are dealt to parts by `part` (by the _file and _row of row_keys(), which then go, if not given); each part of a
    key gets the key's values first, so a key that holds most rows is met by many tasks.
    """
    by = F.xxhash64("_file", "_row") if part is None else part
    dealt = rows.withColumn("_part", F.pmod(by, F.lit(parts)).cast("int"))
    keys = [key] if isinstance(key, str) else key
    met = dealt.select(*keys, "_part").distinct().join(values, keys)
    return dealt.join(met, [*keys, "_part"]).drop("_part", *(["_file", "_row"] if part is None else []))


def fresh(columns: list[str], *names: str) -> tuple[str, ...]:
    """The names, each with underscores added until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return tuple(out)


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_keys(df: DataFrame, file: str = "_file", row: str = "_row") -> DataFrame:
    """df with two columns that name each row of its files; a df that is no plain scan of Parquet is settled first.

    Decisions made on narrow columns then reach their wide rows by one join, repeated rows included. The names must be new ones (see fresh()).
    """

    def keyed(base: DataFrame) -> DataFrame:
        at = base.metadataColumn("_metadata")
        return base.select(*[column(c) for c in base.columns], at["file_path"].alias(file), at["row_index"].alias(row))

    try:
        return keyed(df)
    except AnalysisException:
        return keyed(settle(df, "rows"))


def mapped(df: DataFrame, function: Callable, schema: T.StructType) -> DataFrame:
    """df.mapInArrow(), for columns of any name: those with dots and the like pass under plain ones."""
    odd = [n for n in df.columns if "." in n or "`" in n]
    plain = dict(zip(odd, fresh([*df.columns, *schema.names], *[f"_plain{i}" for i in range(len(odd))]), strict=True))
    fields = [T.StructField(plain.get(f.name, f.name), f.dataType) for f in schema.fields]
    return df.toDF(*[plain.get(n, n) for n in df.columns]).mapInArrow(function, T.StructType(fields)).toDF(*schema.names)


def place_of(file: Column, row: Column) -> Column:
    """What tells any two rows of a table apart: the row's number and its file's name."""
    return F.concat_ws("/", row.cast("string"), F.substring_index(file, "/", -1))


def sheltered(df: DataFrame, **needed: Column) -> tuple[DataFrame, list[Column]]:
    """df with its columns under names that no operator uses and the needed ones under theirs; and what gives the columns back."""
    held = [column(c).alias(f"_in{i}") for i, c in enumerate(df.columns)]
    return df.select(*held, *[e.alias(n) for n, e in needed.items()]), [F.col(f"_in{i}").alias(c) for i, c in enumerate(df.columns)]


def without(columns: list[Column], names: list[str], replaced: list[str]) -> list[Column]:
    """The columns but those with a replaced name, in any case."""
    taken = {r.lower() for r in replaced}
    return [c for c, n in zip(columns, names, strict=True) if n.lower() not in taken]


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator is about to add (any case), so that extra input columns never clash."""
    taken = {n.lower() for n in names}
    return df.select(*[column(c) for c in df.columns if c.lower() not in taken])


def unit_hash(*cols: Column, seed: int) -> Column:
    """A repeatable number in (0, 1) from the columns: 52 bits of an MD5, which other SQL engines can compute as well."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def bucket_count(rows: int, per_bucket: int = 256, most: int = 1 << 16) -> int:
    """How many slices keep the rows of one slice near per_bucket, a power of two."""
    n = 1
    while n < most and n * per_bucket < rows:
        n *= 2
    return n


def running_sum(df: DataFrame, group: list[str], slot: Column, order: list[Column], value: Column, out: str, per_group: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with out: the sum of value over the rows before this one within group, in order.

    slot is a whole number that never falls along order and deals the rows of a group out evenly, so a group that
    holds most rows is summed by many tasks: per-slot totals are partial aggregates, their running total is a small
    table, and only rows of one slot are sorted together. per_group maps a table (group columns, _total) to one of the
    group columns and more columns, which the result carries too. Group columns must not be null; per_group needs at least one.
    """
    keys = [*group, "_slot"]
    tagged = df.withColumn("_slot", slot.cast("long")).withColumn("_value", value)
    totals = tagged.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    if per_group is not None:
        whole = per_group(totals.groupBy(*group).agg(F.sum("_total").alias("_total")))
        starts = starts.join(whole, group)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = tagged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return ranked.join(starts, keys).withColumn(out, F.col("_start") + F.col("_inside")).drop("_slot", "_value", "_inside", "_start")
