"""Results: a lazy DataFrame with ways to read it."""

from __future__ import annotations

import dataclasses
from decimal import Decimal
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import EngineError
from .sources.tables import fields_of


def _plain(value: Any) -> Any:
    """Python values of dynamic ones."""
    if hasattr(value, "toPython"):
        value = _plain(value.toPython())
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


class Result:
    def __init__(self, df: DataFrame) -> None:
        self.df = df
        self._rows: list[tuple] | None = None

    @property
    def columns(self) -> list[T.StructField]:
        return self.df.schema.fields

    @property
    def rows(self) -> list[tuple]:
        """All rows, on the driver."""
        if self._rows is None:
            try:
                found = self.df.collect()
            except (PySparkException, Py4JJavaError) as e:
                if "USER_RAISED_EXCEPTION" in str(e) or "SCALAR_SUBQUERY_TOO_MANY_ROWS" in str(e) or "DIVIDE_BY_ZERO" in str(e):
                    raise EngineError(str(e).splitlines()[0]) from e
                raise
            self._rows = [tuple(_plain(v) for v in r) for r in found]
        return self._rows

    def maps(self) -> list[dict[str, Any]]:
        """Rows as dictionaries; of columns with one name the last counts."""
        names = [f.name for f in self.columns]
        return [dict(zip(names, r, strict=True)) for r in self.rows]

    def scan(self, cls: type) -> list:
        """Rows as instances of a dataclass. Every column needs a field, and NULL an Optional one."""
        fields = {name.lower(): (f, kind, nullable) for f, name, kind, nullable in fields_of(cls)}
        own = []
        for column in self.columns:
            if column.name.lower() not in fields:
                raise EngineError(f"{cls.__name__} has no field for {column.name}")
            own.append(fields[column.name.lower()])
        out = []
        for row in self.rows:
            values: dict[str, Any] = {}
            for (f, kind, nullable), value in zip(own, row, strict=True):
                if value is None and not nullable:
                    raise EngineError(f"{f.name} can't be NULL")
                values[f.name] = _as(value, kind, f.name)
            for f in dataclasses.fields(cls):
                if f.name not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                    values[f.name] = None
            out.append(cls(**values))
        return out


def _as(value: Any, kind: T.DataType, name: str) -> Any:
    """Numbers become the field's kind of number; other kinds must agree."""
    numbers = {T.LongType: int, T.DoubleType: float}
    to = numbers.get(type(kind))
    if value is None:
        return None
    if to is not None:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise EngineError(f"{name} can't be {type(value).__name__}")
        return to(value)
    wanted = {T.StringType: str, T.BooleanType: bool}.get(type(kind))
    if wanted is not None and not isinstance(value, wanted):
        raise EngineError(f"{name} can't be {type(value).__name__}")
    return value
