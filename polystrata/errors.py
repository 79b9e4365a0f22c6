"""Exceptions of the engine, with did-you-mean hints."""

from __future__ import annotations

import difflib
from collections.abc import Iterable


class QueryError(Exception):
    """Any failure of a query; ``suggestions`` may help."""

    code = "query"

    def __init__(self, message: str, suggestions: Iterable[str] = (), position: int | None = None, text: str | None = None):
        self.message, self.suggestions, self.position, self.text = message, list(suggestions), position, text
        super().__init__(self._shown())

    def _shown(self) -> str:
        out = self.message
        if self.text is not None and self.position is not None:
            line = self.text.count("\n", 0, self.position) + 1
            column = self.position - (self.text.rfind("\n", 0, self.position) + 1) + 1
            out += f" (line {line}, column {column}, near {self.text[self.position : self.position + 20]!r})"
        if self.suggestions:
            out += "; did you mean " + ", ".join(self.suggestions) + "?"
        return out


class ParseError(QueryError):
    code = "parse"


class ValidationFailed(QueryError):
    code = "validation"


class TypeMismatch(QueryError):
    code = "type"


class UndefinedReference(QueryError):
    code = "undefined_reference"


class CompilationError(QueryError):
    code = "compilation"


class ExecutionError(QueryError):
    code = "execution"


class SchemaError(QueryError):
    code = "schema"


class GeometricError(QueryError):
    code = "geometric"


class VectorError(QueryError):
    code = "vector"


class GraphError(QueryError):
    code = "graph"


class StreamError(QueryError):
    code = "stream"


class FunctionError(QueryError):
    code = "function"


def close_names(name: str, known: Iterable[str]) -> list[str]:
    """Known names that are spelled like ``name``."""
    table = {k.lower(): k for k in known}
    return [table[m] for m in difflib.get_close_matches(name.lower(), table, n=3, cutoff=0.6)]
