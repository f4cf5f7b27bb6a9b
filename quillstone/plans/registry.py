"""Registry of queries and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
_MODULES = ("joins", "aggregates", "windows", "sorting", "sets", "scalars", "json_arrays", "events", "documents")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers fn under name, with the DuckDB SQL that must give the same rows."""

    def keep(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = fn
        if oracle:
            _oracles[name] = oracle
        return fn

    return keep


def both(name: str, text: str, *tables: str) -> None:
    """Registers one SQL text that Spark and DuckDB read alike; tables stand in it as {name}."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})

    query(name, text.format(**{t: t for t in tables}))(run)


def pair(name: str, spark_text: str, oracle: str | None, *tables: str) -> None:
    """As both(), for texts that differ between the dialects."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_text, **{t: table(spark, sf_dir, t) for t in tables})

    query(name, oracle)(run)


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"quillstone.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
