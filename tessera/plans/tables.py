"""Table functions for SQL: sentences as rows, and tools that give a row with an error instead of failing.

``register(spark)`` makes them callable with any table as argument::

    SELECT * FROM sentences(TABLE(talks), 'instances')
    SELECT * FROM word_ratio_rows(TABLE(talks))      -- of a FunctionTool named word_ratio

A table is handled where its partitions are; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.plans.tools import FunctionTool, Tool, registered


def kept(table: AnalyzeArgument, *replaced: str) -> list[StructField]:
    """The fields of a table argument but for those named like ``replaced``, whatever their case."""
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    names = {r.lower() for r in replaced}
    return [f for f in table.dataType.fields if f.name.lower() not in names]


class Sentences:
    """(own columns, sentence_index, text): a row for each item of a list of texts; null or empty lists give none.

    The list's column is left out, and columns named like a result are replaced.
    """

    def __init__(self, analyzed: AnalyzeResult) -> None:
        self.own = [f.name for f in analyzed.schema.fields[:-2]]

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        if not column.isConstantExpression or column.value is None:
            raise ValueError("the second argument must be the name of a column of lists")
        found = [f for f in table.dataType.fields if f.name == column.value] if table.isTable else []
        own = kept(table, column.value, "sentence_index", "text")
        if not found or found[0].dataType != ArrayType(StringType(), found[0].dataType.containsNull if isinstance(found[0].dataType, ArrayType) else True):
            raise ValueError(f"{column.value!r} is no column of lists of texts")
        return AnalyzeResult(StructType([*own, StructField("sentence_index", IntegerType()), StructField("text", StringType())]))

    def eval(self, row: Row, column: str) -> Iterator[tuple]:
        own = tuple(row[name] for name in self.own)
        for place, sentence in enumerate(row[column] or ()):
            yield (*own, place, sentence)


def rows_of(tool: FunctionTool) -> type:
    """A table function (own columns, value, error): a tool's value at each row, or how it failed there."""
    function, columns = tool.function, tool.columns

    class ToolRows:
        def __init__(self, analyzed: AnalyzeResult) -> None:
            self.own = [f.name for f in analyzed.schema.fields[:-2]]

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            own = kept(table, "value", "error")
            missing = set(columns) - {f.name for f in table.dataType.fields}
            if missing:
                raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
            return AnalyzeResult(StructType([*own, StructField("value", StringType()), StructField("error", StringType())]))

        def eval(self, row: Row) -> Iterator[tuple]:
            try:
                value, error = function(*(row[c] for c in columns)), None
                value = None if value is None else str(value)
            except Exception as failed:
                value, error = None, f"{type(failed).__name__}: {failed}"
            yield (*(row[name] for name in self.own), value, error)

    return ToolRows


def register(spark: SparkSession, tools: dict[str, Tool] | None = None) -> list[str]:
    """Make ``sentences`` and, for each function tool, ``NAME_rows`` callable in SQL; returns those names."""
    functions = {"sentences": Sentences}
    functions |= {f"{t.name}_rows": rows_of(t) for t in (registered() if tools is None else tools).values() if isinstance(t, FunctionTool)}
    for name, made in functions.items():
        spark.udtf.register(name, udtf(made))
    return list(functions)
