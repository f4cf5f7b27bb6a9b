"""Dataset-style transformations over positioned documents.

MapDataset works on a DataFrame with _pos; every step is a lazy DataFrame transformation. IterableDataset is consumed in
order by one iterator. Functions may be Column functions (doc -> Column), which stay in the JVM, or Python functions on
dicts, which run in Arrow batches.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.operators.latest import with_positions
from quillstone.operators.predicate import Predicate, as_column


def row_of(raw: str) -> dict[str, Any]:
    return {k: v for k, v in json.loads(raw).items() if k != "_id"}


def _mapped(df: DataFrame, fn: Callable[[dict], dict]) -> DataFrame:
    """df with each document replaced by fn's result."""

    @F.pandas_udf(T.StringType())
    def apply(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: json.dumps(fn(row_of(r))))

    return df.withColumn("_raw", apply("_raw")).withColumn("doc", F.parse_json("_raw"))


def _kept(df: DataFrame, fn: Callable[[dict], bool] | Predicate | dict | Column) -> DataFrame:
    if not callable(fn) or isinstance(fn, Column):
        return df.where(as_column(fn))

    @F.pandas_udf(T.BooleanType())
    def test(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: bool(fn(row_of(r))))

    return df.where(test("_raw"))


class MapDataset:
    """Documents by position. Steps return new datasets; positions count 0, 1, 2, ... when they are needed."""

    def __init__(self, df: DataFrame, dense: bool = True):
        self._df, self._dense = df, dense

    @property
    def df(self) -> DataFrame:
        """_id, doc, _raw and dense _pos."""
        if not self._dense:
            self._df, self._dense = with_positions(self._df.withColumnRenamed("_pos", "_was"), ["_was"]).drop("_was"), True
        return self._df

    def __len__(self) -> int:
        return self._df.count()

    def __iter__(self) -> Iterator[dict[str, Any]]:
        return (row_of(r[0]) for r in self._df.orderBy("_pos").select("_raw").toLocalIterator())

    def __getitem__(self, at: int | slice) -> Any:
        if isinstance(at, slice):
            return list(self.slice(at))
        n = len(self)
        at = at + n if at < 0 else at
        if not 0 <= at < n:
            raise IndexError(at)
        return row_of(self.df.where(F.col("_pos") == at).select("_raw").first()[0])

    def slice(self, at: slice) -> MapDataset:
        start, stop, step = at.indices(len(self))
        inside = self.df.where((F.col("_pos") >= start) & (F.col("_pos") < stop)) if step > 0 else self.df.where((F.col("_pos") <= start) & (F.col("_pos") > stop))
        return MapDataset(inside.where((F.col("_pos") - start) % step == 0).withColumn("_pos", F.expr(f"(_pos - {start}) div {step}")))

    def select(self, positions: list[int]) -> MapDataset:
        """The documents at the positions, in that order, repeats kept."""
        n = len(self)
        chosen = [(new, p + n if p < 0 else p) for new, p in enumerate(positions)]
        if any(not 0 <= p < n for _, p in chosen):
            raise IndexError("a position is out of range")
        wanted = self._df.sparkSession.createDataFrame(chosen, "_new long, _pos long")
        return MapDataset(self.df.join(wanted, "_pos").drop("_pos").withColumnRenamed("_new", "_pos"))

    def shuffle(self, seed: int = 0) -> MapDataset:
        """A permutation by seeded hash: the same for the same seed, wherever it runs."""
        return MapDataset(with_positions(self._df.withColumn("_hash", F.xxhash64("_id", "_pos", F.lit(seed))).withColumnRenamed("_pos", "_was"), ["_hash", "_was"]).drop("_hash", "_was"))

    def map(self, fn: Callable[[dict], dict]) -> MapDataset:
        """Documents replaced by fn of them."""
        return MapDataset(_mapped(self._df, fn), self._dense)

    def with_columns(self, **cols: Column) -> DataFrame:
        """The documents as typed columns computed in the JVM."""
        return self._df.select("_id", "_pos", *[c.alias(n) for n, c in cols.items()])

    def filter(self, fn: Callable[[dict], bool] | Predicate | dict | Column) -> MapDataset:
        return MapDataset(_kept(self._df, fn), dense=False)

    def take(self, n: int) -> MapDataset:
        return MapDataset(self.df.where(F.col("_pos") < n))

    def skip(self, n: int) -> MapDataset:
        return MapDataset(self.df.where(F.col("_pos") >= n).withColumn("_pos", F.col("_pos") - n))

    def batch(self, size: int) -> Iterator[list[dict[str, Any]]]:
        return _batches(iter(self), size)

    def batches(self, size: int) -> DataFrame:
        """A row for each batch of `size` documents: batch, and docs in order as JSON text."""
        rows = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_raw"))), lambda r: r["_raw"])
        return self.df.groupBy(F.expr(f"_pos div {size}").alias("batch")).agg(rows.alias("docs"))

    def split(self, *shares: float, seed: int = 0) -> list[MapDataset]:
        """Exact parts of a shuffle, by rounded shares; the last takes the rest."""
        shuffled, n, parts, at = self.shuffle(seed), len(self), [], 0
        for i, share in enumerate(shares):
            upto = n if i == len(shares) - 1 else min(n, at + int(n * share + 0.5))
            parts.append(shuffled.skip(at).take(upto - at))
            at = upto
        return parts

    @property
    def features(self) -> dict[str, str] | None:
        """Field names and kinds of the first document; None if there is none."""
        first = self._df.orderBy("_pos").select("_raw").first()
        return None if first is None else {k: _kind(v) for k, v in row_of(first[0]).items()}


# Names of kinds of fields.
_KINDS = ((bool, "bool"), (int, "int64"), (float, "float64"), (str, "string"), (list, "list"), (dict, "dict"))


def _kind(value: Any) -> str:
    return next((name for kind, name in _KINDS if isinstance(value, kind)), "object")


def features_of(schema: T.StructType) -> dict[str, str]:
    """The same names from a typed view."""
    names = {"boolean": "bool", "bigint": "int64", "int": "int64", "double": "float64", "float": "float64", "string": "string", "array": "list", "struct": "dict", "map": "dict"}
    return {f.name: names.get(f.dataType.simpleString().split("<")[0].split("(")[0], "object") for f in schema.fields}


def _batches(rows: Iterator[dict[str, Any]], size: int) -> Iterator[list[dict[str, Any]]]:
    held: list[dict[str, Any]] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


class IterableDataset:
    """Documents in order, one partition at a time on the driver. Iterating again runs again.

    Steps apply in call order; compat=True runs all filters on the stored documents first, whatever the call order.
    """

    def __init__(self, df: DataFrame, steps: tuple[tuple[str, Any], ...] = (), buffer: int = 0, seed: int | None = None, compat: bool = False):
        self._df, self._steps, self._buffer, self._seed, self._compat = df, steps, buffer, seed, compat

    def _with(self, **changes: Any) -> IterableDataset:
        now = {"steps": self._steps, "buffer": self._buffer, "seed": self._seed, "compat": self._compat} | changes
        return IterableDataset(self._df, **now)

    def map(self, fn: Callable[[dict], dict]) -> IterableDataset:
        return self._with(steps=(*self._steps, ("map", fn)))

    def filter(self, fn: Callable[[dict], bool] | Predicate | dict | Column) -> IterableDataset:
        return self._with(steps=(*self._steps, ("filter", fn)))

    def take(self, n: int) -> IterableDataset:
        return self._with(steps=(*self._steps, ("take", n)))

    def skip(self, n: int) -> IterableDataset:
        return self._with(steps=(*self._steps, ("skip", n)))

    def shuffle(self, buffer_size: int = 1000, seed: int | None = None) -> IterableDataset:
        """Emits a random one of a buffer of documents at a time; every document comes once."""
        return self._with(buffer=buffer_size, seed=seed)

    def df(self) -> DataFrame:
        """The plan of all steps, in order of _ord."""
        out = self._df
        steps = sorted(self._steps, key=lambda s: s[0] != "filter") if self._compat else self._steps
        for kind, x in steps:
            out = _mapped(out, x) if kind == "map" else _kept(out, x) if kind == "filter" else out.orderBy("_ord").limit(x) if kind == "take" else out.orderBy("_ord").offset(x)
        return out.orderBy("_ord")

    def __iter__(self) -> Iterator[dict[str, Any]]:
        rows = (row_of(r[0]) for r in self.df().select("_raw").toLocalIterator(prefetchPartitions=True))
        return _buffered(rows, self._buffer, self._seed) if self._buffer > 1 else rows

    def batch(self, size: int) -> Iterator[list[dict[str, Any]]]:
        return _batches(iter(self), size)

    def epochs(self, n: int, buffer_size: int = 1000) -> Iterator[Iterator[dict[str, Any]]]:
        """n passes, each shuffled by its number."""
        return (iter(self.shuffle(buffer_size, epoch)) for epoch in range(n))


def _buffered(rows: Iterator[dict[str, Any]], size: int, seed: int | None) -> Iterator[dict[str, Any]]:
    rng, held = random.Random(seed), []
    for row in rows:
        if len(held) < size:
            held.append(row)
        else:
            at = rng.randrange(size)
            out, held[at] = held[at], row
            yield out
    rng.shuffle(held)
    yield from held


def shuffle_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with _rank: its place in a seeded permutation of keys. One small window, for reports; MapDataset.shuffle is for large data."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy().orderBy(F.xxhash64(key, F.lit(seed)))))
