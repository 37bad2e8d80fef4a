"""Query arguments."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .ast import Parsed
from .errors import EngineError
from .parser import parse


@dataclass(frozen=True)
class Named:
    name: str
    value: Any


def named(name: str, value: Any) -> Named:
    return Named(name, value)


def required_args(sql: str) -> tuple[int, list[str]]:
    """The number of positional arguments, and the names of the others as first spelled."""
    found = parse(sql)
    return found.positional, list(found.names)


def collect(parsed: Parsed, args: tuple, by_name: dict[str, Any]) -> dict[int | str, Any]:
    """Values by placeholder key; what is missing or left over is an error."""
    values: dict[int | str, Any] = {}
    pairs = []
    for value in args:
        if isinstance(value, Named):
            pairs.append((value.name, value.value))
        elif pairs:
            raise EngineError("positional arguments must come before named ones")
        else:
            values[len(values)] = value
    if len(values) != parsed.positional:
        raise EngineError(f"the query takes {parsed.positional} positional arguments, not {len(values)}")
    wanted = {n.lower() for n in parsed.names}
    for name, value in [*pairs, *by_name.items()]:
        key = name.strip().lower()
        if not key or key in values:
            raise EngineError(f"empty or repeated argument name {name!r}")
        if key not in wanted:
            raise EngineError(f"the query has no argument @{name}")
        values[key] = value
    if missing := wanted - set(values):
        raise EngineError(f"missing arguments: {', '.join(sorted(missing))}")
    return values
