"""Built-in and user-defined scalar functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from . import dynamic

AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Function:
    """SQL from the arguments' SQL; most_args below 0: any number. python: it leaves the JVM."""

    least_args: int
    most_args: int
    result: T.DataType
    render: Callable[..., str]
    python: bool = False


def length(sql: str, kind: T.DataType) -> str:
    """Bytes of a string, elements of an array or a map."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return f"CAST(octet_length({sql}) AS BIGINT)"
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return f"CAST(CASE WHEN {sql} IS NOT NULL THEN cardinality({sql}) END AS BIGINT)"
    if isinstance(kind, T.VariantType):
        return dynamic.length(sql)
    if isinstance(kind, T.NullType):
        return "CAST(NULL AS BIGINT)"
    raise EngineError(f"len doesn't take {kind.simpleString()}")


def contains(sql: str, kind: T.DataType, needle: str, needle_kind: T.DataType, equal: Callable[[str, T.DataType], str]) -> str:
    """A part of a string, or an element of an array. equal: a predicate for an element (SQL, type) and the needle."""
    if isinstance(kind, T.NullType):
        return "CAST(NULL AS BOOLEAN)"
    if isinstance(kind, T.VariantType):
        parts = f"exists(try_variant_get({sql}, '$', 'array<variant>'), x -> coalesce({equal('x', kind)}, false))"
        text = dynamic.part(needle, "string") if isinstance(needle_kind, T.VariantType) else needle
        part = f"contains({dynamic.part(sql, 'string')}, {text})" if isinstance(needle_kind, (T.StringType, T.VariantType)) else dynamic.refuse("contains needs a string to look for in a string", "boolean")
        other = dynamic.refuse("contains needs a string or a list", "boolean")
        return f"(CASE WHEN {sql} IS NULL THEN NULL WHEN schema_of_variant({sql}) LIKE 'ARRAY<%' THEN {parts} WHEN schema_of_variant({sql}) = 'STRING' THEN {part} ELSE {other} END)"
    if isinstance(kind, T.StringType) and isinstance(needle_kind, T.VariantType):
        return f"contains({sql}, {dynamic.part(needle, 'string')})"
    if isinstance(kind, T.ArrayType) and (isinstance(needle_kind, T.VariantType) or isinstance(kind.elementType, T.VariantType)) and not isinstance(needle_kind, T.NullType):
        return f"CASE WHEN {sql} IS NOT NULL THEN exists({sql}, x -> coalesce({equal('x', kind.elementType)}, false)) END"
    if isinstance(kind, T.StringType):
        if not isinstance(needle_kind, T.StringType):
            raise EngineError("contains needs a string to look for in a string")
        return f"contains({sql}, {needle})"
    if isinstance(kind, T.ArrayType):
        if isinstance(needle_kind, T.NullType):
            return f"CASE WHEN {sql} IS NOT NULL THEN exists({sql}, x -> x IS NULL) END"
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        if type(kind.elementType) is not type(needle_kind) and not (isinstance(kind.elementType, whole) and isinstance(needle_kind, whole)):
            return f"CASE WHEN {sql} IS NOT NULL THEN false END"
        return f"CASE WHEN {sql} IS NOT NULL THEN coalesce(exists({sql}, x -> x <=> {needle}), false) END"
    raise EngineError(f"contains doesn't take {kind.simpleString()}")


class Registry:
    """User-defined functions of a database. Names don't depend on case; none can be defined twice."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.known = spark, {}

    def add(self, name: str, least_args: int, most_args: int, result: T.DataType | str, eval: Callable | None = None, native: Callable[..., str] | None = None) -> None:
        """eval: a Python function; native: one from the arguments' SQL to SQL, which stays within the JVM."""
        key = name.strip().lower()
        if not key or key in AGGREGATES:
            raise EngineError(f"a function can't be called {name!r}")
        if key in self.known or key in ("len", "contains"):
            raise EngineError(f"{name} is defined already")
        if (eval is None) == (native is None):
            raise EngineError("a function needs either eval or native")
        if least_args < 0 or 0 <= most_args < least_args:
            raise EngineError("wrong bounds for the number of arguments")
        kind = T.DataType.fromDDL(result) if isinstance(result, str) else result
        if eval is not None:
            inner = f"skein_{key}_{uuid.uuid4().hex[:8]}"
            self.spark.udf.register(inner, F.udf(eval, kind, useArrow=True))
            native = lambda *args: f"{inner}({', '.join(args)})"
        self.known[key] = Function(least_args, most_args, kind, native, eval is not None)
