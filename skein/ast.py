"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Placeholder:
    """Positional (an index from 0) or named (in lower case)."""

    key: int | str


@dataclass(frozen=True)
class Ref:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Is:
    left: Any
    right: Any
    negated: bool


@dataclass(frozen=True)
class In:
    left: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Subquery:
    query: Query


@dataclass(frozen=True)
class Item:
    """A select item; expr None: a wildcard."""

    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: tuple[str, ...]
    alias: str | None


@dataclass(frozen=True)
class Derived:
    query: Query
    alias: str


@dataclass(frozen=True)
class TableCall:
    name: str
    args: tuple
    alias: str


@dataclass(frozen=True)
class Join:
    kind: str
    source: Any
    on: Any


@dataclass(frozen=True)
class Order:
    expr: Any
    descending: bool


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...]
    sources: tuple
    joins: tuple[Join, ...] = ()
    where: Any = None
    group: tuple = ()
    having: Any = None
    order: tuple[Order, ...] = ()
    limit: Any = None
    distinct: bool = False


@dataclass
class Parsed:
    """A query with the number of its positional arguments and the names of the others, as first spelled."""

    query: Query
    positional: int
    names: list[str] = field(default_factory=list)
