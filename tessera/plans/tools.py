"""Registry of tools: each adds a value to the result of a row."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text


@runtime_checkable
class Tool(Protocol):
    """A named column expression over a scenario's columns."""

    name: str

    def run(self) -> Column: ...


_TOOLS: dict[str, Tool] = {}


def register(tool: type) -> type:
    """Class decorator; a later tool of the same name replaces an earlier one in its place."""
    add(tool())
    return tool


def add(tool: Tool) -> None:
    if not isinstance(tool, Tool):
        raise TypeError(f"{tool} has no name or no run()")
    _TOOLS[tool.name] = tool


def registered() -> dict[str, Tool]:
    return dict(_TOOLS)


def register_sql(spark: SparkSession, tools: dict[str, Tool] | None = None) -> list[str]:
    """Make function tools callable by name in SQL; returns those names."""
    made = [t for t in (registered() if tools is None else tools).values() if isinstance(t, FunctionTool)]
    for tool in made:
        spark.udf.register(tool.name, tool.udf())
    return [t.name for t in made]


class FunctionTool:
    """A tool that calls a function with a row's values; a row at which it fails gets ``ERROR: ...``."""

    def __init__(self, name: str, function: Callable[..., object], *columns: str) -> None:
        self.name, self.function, self.columns = name, function, columns

    def udf(self) -> Callable[..., Column]:
        function = self.function

        def one(*values: object) -> str | None:
            try:
                value = function(*values)
            except Exception as error:
                return f"ERROR: {error}"
            return None if value is None else str(value)

        return F.udf(one, "string", useArrow=True)

    def run(self) -> Column:
        return self.udf()(*(F.col(c) for c in self.columns))


@register
class WordCount:
    """Words of all sentences of a row."""

    name = "word_count"

    def run(self) -> Column:
        return text.count_words(F.col("instances")).cast("string")


def merged(tools: dict[str, Tool] | None = None) -> Column:
    """Map of all tools' values as text; a tool that can't be built gives ``ERROR: ...`` under its name."""
    entries = []
    for name, tool in (registered() if tools is None else tools).items():
        try:
            value = tool.run().cast("string")
        except Exception as error:
            value = F.lit(f"ERROR: {error}")
        entries += [F.lit(name), value]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")


def updated(results: Column, later: Column) -> Column:
    """Two maps as one; the later one's values win, a null map counts as empty."""
    none = F.create_map().cast("map<string,string>")
    first, second = F.coalesce(results, none), F.coalesce(later, none)
    kept = F.array_except(F.map_keys(first), F.map_keys(second))
    return F.map_concat(F.map_from_arrays(kept, F.transform(kept, lambda k: F.element_at(first, k))), second)
