"""What queries and tables can raise."""

from __future__ import annotations


class EngineError(Exception):
    """A query, an argument or a table that the engine refuses."""


class UnsupportedError(EngineError):
    """A query that is valid but that Spark can't plan."""


class ParseError(EngineError):
    """A syntax error with its byte span, what was expected and what was found."""

    def __init__(self, message: str, span: tuple[int, int], expected: tuple[str, ...] = (), found: str = "") -> None:
        super().__init__(f"{message} at byte {span[0]}")
        self.message, self.span, self.expected, self.found = message, span, expected, found
        #: All errors that the parser went on to find, this one first.
        self.errors: tuple[ParseError, ...] = (self,)
