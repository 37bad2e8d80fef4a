"""A catalogue of tables and functions that runs queries."""

from __future__ import annotations

import threading
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import args as arguments
from .ast import Parsed
from .errors import EngineError
from .functions.registry import Registry
from .operators.planner import Planner
from .parser import parse
from .result import Result
from .sources.tables import Table


class PreparedQuery:
    """A parsed query; it can run on any database."""

    def __init__(self, sql: str, parsed: Parsed) -> None:
        self.sql, self.parsed = sql, parsed

    def query(self, db: Database, *args: Any, **named: Any) -> Result:
        return db.run(self.parsed, args, named)


class Database:
    """numeric_mode: `reference` compares whole numbers and floats as never equal; `promote` as numbers."""

    def __init__(self, spark: SparkSession, numeric_mode: str = "reference") -> None:
        if numeric_mode not in ("reference", "promote"):
            raise EngineError(f"no numeric mode {numeric_mode!r}")
        self.spark, self.promote = spark, numeric_mode == "promote"
        self.tables: dict[str, tuple[str, Any]] = {}
        self.functions = Registry(spark)
        self._prepared: dict[str, PreparedQuery] = {}
        self._lock = threading.Lock()

    def register(self, name: str, table: Table | DataFrame) -> None:
        key = name.strip().lower()
        if not key or key in self.tables:
            raise EngineError(f"empty or repeated table name {name!r}")
        df = table.df if isinstance(table, Table) else table
        view = f"skein_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        self.tables[key] = (view, df.schema)

    def register_parquet(self, name: str, path: str) -> None:
        self.register(name, self.spark.read.parquet(path))

    def register_function(self, name: str, least_args: int, most_args: int, result, eval=None, native=None) -> None:
        self.functions.add(name, least_args, most_args, result, eval, native)

    def prepare(self, sql: str) -> PreparedQuery:
        """The same text gives the same object."""
        with self._lock:
            found = self._prepared.get(sql)
        if found is None:
            made = PreparedQuery(sql, parse(sql))
            with self._lock:
                found = self._prepared.setdefault(sql, made)
        return found

    def query(self, sql: str, *args: Any, **named: Any) -> Result:
        return self.prepare(sql).query(self, *args, **named)

    def run(self, parsed: Parsed, args: tuple, named: dict[str, Any]) -> Result:
        values = arguments.collect(parsed, args, named)
        planner = Planner(self.tables, self.functions, values, self.promote)
        planned = planner.query(parsed.query, None)
        df = self.spark.sql(planned.sql, args=planner.params or None)
        return Result(df.toDF(*[c.name for c in planned.columns]))
