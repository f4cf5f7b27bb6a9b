"""Predicates over documents, compiled to Column expressions on a VARIANT column.

A path is keys joined by dots; it steps through objects only. An absent field differs from an explicit null: Eq(p, None)
and Exists(p) see the null, NotExists(p) the absence. Numbers are equal by value (1 = 1.0) unless strict.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(path: str) -> str:
    return "$" + "".join("['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']" for key in path.split("."))


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def field(path: str, kind: str = "variant", doc: str = "doc") -> Column:
    """The value at a path as `kind`, null where it is absent or can't be read so."""
    return F.expr(f"try_variant_get({doc}, {_literal(json_path(path))}, '{kind}')")


class Predicate:
    def column(self, doc: str = "doc") -> Column:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return And([self, other])

    def __or__(self, other: Predicate) -> Predicate:
        return Or([self, other])


@dataclass
class Eq(Predicate):
    path: str
    value: Any
    strict: bool = False

    def column(self, doc: str = "doc") -> Column:
        found = field(self.path, doc=doc)
        return F.coalesce(_equals(found, self.path, self.value, self.strict, doc), F.lit(False))


def _equals(found: Column, path: str, value: Any, strict: bool, doc: str) -> Column:
    kind = F.schema_of_variant(found)
    if value is None:
        return F.is_variant_null(found)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (field(path, "boolean", doc) == F.lit(value))
    if isinstance(value, int):
        wanted = F.lit(str(value)).cast("decimal(38,0)") if abs(value) < 10**38 else F.lit(float(value))
        whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
        if strict:  # 30.0 is a short DECIMAL without places, an integer beyond 64 bits a long one
            return ((kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")) & (field(path, "decimal(38,0)", doc) == wanted)
        return F.when(whole, field(path, "decimal(38,0)", doc) == wanted).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), field(path, "double", doc) == F.lit(float(value)))
    if isinstance(value, float):
        number = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)" if strict else "^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return number & (field(path, "double", doc) == F.lit(value))
    if isinstance(value, str):
        return (kind == "STRING") & (field(path, "string", doc) == F.lit(value))
    return F.to_json(found) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


@dataclass
class Exists(Predicate):
    path: str

    def column(self, doc: str = "doc") -> Column:
        return field(self.path, doc=doc).isNotNull()


@dataclass
class NotExists(Predicate):
    path: str

    def column(self, doc: str = "doc") -> Column:
        return field(self.path, doc=doc).isNull()


@dataclass
class And(Predicate):
    """True if empty."""

    parts: list[Predicate]

    def column(self, doc: str = "doc") -> Column:
        return reduce(lambda a, b: a & b, [p.column(doc) for p in self.parts], F.lit(True))


@dataclass
class Or(Predicate):
    """False if empty."""

    parts: list[Predicate]

    def column(self, doc: str = "doc") -> Column:
        return reduce(lambda a, b: a | b, [p.column(doc) for p in self.parts], F.lit(False))


@dataclass
class Matches(Predicate):
    """Top-level equality with every entry of a dict; None also matches an absent field, and numbers compare by value."""

    wanted: dict[str, Any]

    def column(self, doc: str = "doc") -> Column:
        tests = []
        for key, value in self.wanted.items():
            path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
            found = F.expr(f"try_variant_get({doc}, {_literal(path)}, 'variant')")
            if value is None:
                tests.append(found.isNull() | F.is_variant_null(found))
            elif isinstance(value, bool) or (isinstance(value, (int, float)) and value in (0, 1)):
                same = F.to_json(found) == F.lit("true" if value else "false")
                number = F.schema_of_variant(found).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.expr(f"try_variant_get({doc}, {_literal(path)}, 'double')") == F.lit(float(value)))
                tests.append(F.coalesce(same | number, F.lit(False)))
            elif "." in key:  # a key of that name, not a path
                tests.append(F.coalesce(F.to_json(found) == F.to_json(F.parse_json(F.lit(json.dumps(value)))), F.lit(False)))
            else:
                tests.append(Eq(key, value).column(doc))
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def as_column(predicate: Predicate | dict[str, Any] | Column | None, doc: str = "doc") -> Column:
    if predicate is None:
        return F.lit(True)
    if isinstance(predicate, Column):
        return predicate
    return (Matches(predicate) if isinstance(predicate, dict) else predicate).column(doc)


def projection(fields: list[str], doc: str = "doc") -> list[Column]:
    """The values at the paths, as VARIANT, under their last keys; of two with the same last key the later counts."""
    by_leaf = {path.rsplit(".", 1)[-1]: path for path in fields}
    return [field(path, doc=doc).alias(leaf) for leaf, path in by_leaf.items()]
