"""A small SQL engine whose queries run as Spark SQL."""

from .args import Named, named, required_args
from .database import Database, PreparedQuery
from .errors import EngineError, ParseError, UnsupportedError
from .result import Result
from .sources.tables import Table, build_map_table, build_table

__all__ = ["Database", "EngineError", "Named", "ParseError", "PreparedQuery", "Result", "Table", "UnsupportedError", "build_map_table", "build_table", "named", "required_args"]
