"""Registry of user functions: versions, metadata, and calls from query text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import FunctionError, close_names


@dataclass(frozen=True)
class UserFunction:
    """One version of a function. ``kind``: column (Columns to a Column), pandas (Series to a Series) or row (values)."""

    name: str
    version: int
    call: Callable[..., Column]
    kind: str
    return_type: str | None = None
    category: str = "general"
    description: str = ""
    tags: tuple[str, ...] = field(default=())


class FunctionRegistry:
    def __init__(self, spark: SparkSession):
        self.spark, self._all = spark, {}

    def register(self, name: str, f: Callable, kind: str = "column", return_type: str | None = None, **metadata: Any) -> UserFunction:
        """Add the next version of a function; pandas and row functions need ``return_type``."""
        versions = self._all.setdefault(name.upper(), [])
        if kind == "column":
            call = f
        elif kind == "pandas" and return_type:
            call = F.pandas_udf(f, return_type)
        elif kind == "row" and return_type:
            call = F.udf(f, return_type)
        else:
            raise FunctionError("kind is column, pandas or row; the last two need a return type")
        made = UserFunction(name.upper(), len(versions) + 1, call, kind, return_type, **metadata)
        versions.append(made)
        if kind != "column":
            self.spark.udf.register(name, call)
        return made

    def has(self, name: str) -> bool:
        return name.upper() in self._all

    def get(self, name: str, version: int | None = None) -> UserFunction:
        versions = self._all.get(name.upper())
        if not versions:
            raise FunctionError(f"no function {name}", close_names(name, self._all))
        if version is None:
            return versions[-1]
        if not 1 <= version <= len(versions):
            raise FunctionError(f"{name} has no version {version}")
        return versions[version - 1]

    def call(self, name: str, args: list[Column]) -> Column:
        return self.get(name).call(*args)

    def names(self) -> list[str]:
        return sorted(self._all)

    def search(self, text: str = "", category: str | None = None) -> list[UserFunction]:
        """Latest versions whose name, description or tags hold ``text``."""
        latest = [v[-1] for v in self._all.values()]
        hit = lambda f: text.lower() in " ".join([f.name, f.description, *f.tags]).lower()
        return sorted((f for f in latest if hit(f) and category in (None, f.category)), key=lambda f: f.name)
