"""Tables built from dataclasses and dictionaries."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import types as py
import typing
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

SCALARS = {bool: T.BooleanType(), str: T.StringType(), int: T.LongType(), float: T.DoubleType(), dt.datetime: T.TimestampType(), dt.date: T.DateType(), bytes: T.BinaryType()}


class Table:
    """A named relation to be; a thin cover of a DataFrame."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def __len__(self) -> int:
        return self.df.count()


def _unwrapped(kind: Any) -> tuple[Any, bool]:
    """The type without Optional, and whether it had it."""
    if typing.get_origin(kind) in (typing.Union, py.UnionType):
        rest = [x for x in typing.get_args(kind) if x is not type(None)]
        if len(rest) == 1:
            return rest[0], True
        return Any, True
    return kind, False


def fields_of(cls: type) -> list[tuple[dataclasses.Field, str, T.DataType, bool]]:
    """Field, column name, type, nullable. metadata: name renames, omit leaves out."""
    hints, out = typing.get_type_hints(cls), []
    for f in dataclasses.fields(cls):
        if f.metadata.get("omit") or f.name.startswith("_"):
            continue
        kind, nullable = _unwrapped(hints[f.name])
        data = spark_type(kind)
        out.append((f, (f.metadata.get("name") or "").strip() or f.name, data, nullable or isinstance(data, T.VariantType)))
    return out


def spark_type(kind: Any) -> T.DataType:
    kind, _ = _unwrapped(kind)
    if kind in SCALARS:
        return SCALARS[kind]
    if dataclasses.is_dataclass(kind):
        return T.StructType([T.StructField(name, data, True) for _, name, data, _ in fields_of(kind)])
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (list, tuple, set) and args:
        return T.ArrayType(spark_type(args[0]))
    if origin is dict and len(args) == 2 and args[0] is str and _unwrapped(args[1])[0] is not Any:
        return T.MapType(T.StringType(), spark_type(args[1]))
    return T.VariantType()


def _plain(value: Any, kind: T.DataType) -> Any:
    """A value as createDataFrame takes it; variants as JSON."""
    if isinstance(kind, T.VariantType):
        return None if value is None else json.dumps(dataclasses.asdict(value) if dataclasses.is_dataclass(value) else value, default=str)
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_plain(getattr(value, f.name), data) for (f, _, data, _) in fields_of(type(value)))
    if isinstance(kind, T.ArrayType):
        return [_plain(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return {k: _plain(v, kind.valueType) for k, v in value.items()}
    return value


def _frame(spark: SparkSession, rows: list[tuple], columns: list[tuple[str, T.DataType, bool]]) -> DataFrame:
    inner = T.StructType([T.StructField(f"c{i}", T.StringType() if isinstance(kind, T.VariantType) else kind, nullable or isinstance(kind, T.VariantType)) for i, (_, kind, nullable) in enumerate(columns)])
    df = spark.createDataFrame(rows, inner)
    df = df.select(*[F.parse_json(f"c{i}").alias(f"c{i}") if isinstance(kind, T.VariantType) else F.col(f"c{i}") for i, (_, kind, _) in enumerate(columns)])
    return df.toDF(*[name for name, _, _ in columns])


def build_table(spark: SparkSession, cls: type, rows: list) -> Table:
    """A typed table from instances of a dataclass. None in a list field that isn't Optional is an empty list."""
    if not dataclasses.is_dataclass(cls):
        raise EngineError(f"{cls!r} is not a dataclass")
    fields, out = fields_of(cls), []
    for row in rows:
        if not isinstance(row, cls):
            raise EngineError(f"a row is {type(row).__name__}, not {cls.__name__}")
        own = []
        for f, name, kind, nullable in fields:
            value = getattr(row, f.name)
            if value is None and not nullable:
                if not isinstance(kind, T.ArrayType):
                    raise EngineError(f"{name} is not nullable")
                value = []
            own.append(_plain(value, kind))
        out.append(tuple(own))
    return Table(_frame(spark, out, [(name, kind, nullable) for _, name, kind, nullable in fields]))


def _inferred(values: list) -> T.DataType:
    """The type that all values share, else variant."""
    values = [v for v in values if v is not None]
    if not values:
        return T.StringType()
    kinds = {type(v) for v in values}
    if len(kinds) == 1 and (kind := kinds.pop()) in SCALARS:
        return SCALARS[kind]
    if all(isinstance(v, (list, tuple)) for v in values):
        inner = _inferred([x for v in values for x in v])
        return T.VariantType() if isinstance(inner, T.VariantType) else T.ArrayType(inner)
    if all(isinstance(v, dict) and all(isinstance(k, str) for k in v) for v in values):
        inner = _inferred([x for v in values for x in v.values()])
        return T.VariantType() if isinstance(inner, T.VariantType) else T.MapType(T.StringType(), inner)
    return T.VariantType()


def build_map_table(spark: SparkSession, rows: list[dict[str, Any]]) -> Table:
    """A table from dictionaries: the union of their keys, in the order of their normal forms."""
    shown: dict[str, str] = {}
    normal = []
    for row in rows:
        own: dict[str, Any] = {}
        for key, value in row.items():
            name = key.strip()
            if not name or name.lower() in own:
                raise EngineError(f"empty or repeated key {key!r}")
            own[name.lower()] = value
            shown.setdefault(name.lower(), name)
        normal.append(own)
    columns = [(shown[k], _inferred([r.get(k) for r in normal]), any(r.get(k) is None for r in normal)) for k in sorted(shown)]
    data = [tuple(_plain(r.get(k), kind) for k, (_, kind, _) in zip(sorted(shown), columns, strict=True)) for r in normal]
    if not columns:
        raise EngineError("no row has a key")
    return Table(_frame(spark, data, columns))
