"""Scenarios: the product of configuration lists, in a fixed order, and batches of it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources.storage import stored

#: Values of a list that is broadcast, at most.
BROADCAST = 100_000
#: Lists of a configuration by scenario column, the last of which changes fastest.
LISTS = {
    "topic": ("topics",),
    "tense": ("tense",),
    "perspective": ("perspective",),
    "gender": ("character_setting", "gender"),
    "age": ("character_setting", "age"),
    "education_level": ("character_setting", "education_level"),
    "cs_ratio": ("cs_ratio",),
    "conversation_type": ("conversation_type",),
    "cs_function": ("cs_function",),
    "cs_type": ("cs_type",),
}


def lists_of(config: Mapping) -> dict[str, list[str]]:
    found = {}
    for column, path in LISTS.items():
        value = config
        for step in path:
            value = value[step]
        found[column] = [str(x) for x in value]
    return found


def count(config: Mapping) -> int:
    """Rows of ``product``: the product of the lists' lengths."""
    return prod(len(v) for v in lists_of(config).values())


def product(spark: SparkSession, config: Mapping) -> DataFrame:
    """All scenarios with ``scenario_id``, their place in the product.

    A scenario is decoded from its number, so rows are made in parallel, a filter on
    the number makes only what it needs, and a limit stops early.
    """
    lists = lists_of(config)
    languages = config["character_setting"]["nationality"]
    rows, stride = spark.range(count(config)).withColumnRenamed("id", "scenario_id"), count(config)
    columns: dict[str, Column] = {}
    for name, values in lists.items():
        stride //= max(1, len(values))
        digit = F.expr(f"scenario_id div {max(1, stride)}L") % F.lit(max(1, len(values)))
        columns[name] = F.get(F.array(*map(F.lit, values)), digit.cast("int")) if values else F.lit(None).cast("string")
    constant = {"use_tools": F.lit(bool(config["use_tools"])), "first_language": F.lit(languages["first_language"]), "second_language": F.lit(languages["second_language"])}
    return rows.withColumns(columns | constant)


def different(columns: Mapping[str, DataFrame]) -> DataFrame:
    """(list, value): the different values of tables of one column, as texts, in one pass; nulls aren't values."""
    parts = [column.toDF("value").select(F.lit(name).alias("list"), F.col("value").cast("string").alias("value")) for name, column in columns.items()]
    return reduce(DataFrame.unionByName, parts).where("value is not null").distinct()


def values_of(columns: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """The different values of tables of one column, in order; more than ``BROADCAST`` in all are an error."""
    found = different(columns).limit(BROADCAST + 1).collect()
    if len(found) > BROADCAST:
        raise ValueError(f"more than {BROADCAST} values; use cross_product")
    return {name: sorted((r.value for r in found if r.list == name), key=str.encode) for name in columns}


def config_of(columns: Mapping[str, DataFrame], first_language: str, second_language: str, use_tools: bool = False) -> dict:
    """A configuration whose lists are the different values of tables of one column, by scenario column."""
    made: dict = {"use_tools": use_tools, "character_setting": {"nationality": {"first_language": first_language, "second_language": second_language}}}
    values = values_of({column: columns[column] for column in LISTS})
    for column, path in LISTS.items():
        inside = made
        for step in path[:-1]:
            inside = inside.setdefault(step, {})
        inside[path[-1]] = values[column]
    return made


def cross_product(columns: Mapping[str, DataFrame]) -> DataFrame:
    """The same product, with ``scenario_id``, as joins of tables of one column, whose different values are the lists.

    Lists of up to ``BROADCAST`` values are broadcast.  The values of each list are numbered by a window over
    the list, and the numbers are the digits of ``scenario_id``.
    """
    out, number, values = None, F.lit(0).cast("bigint"), stored(different(columns), "lists")
    sizes = {r.list: r.n for r in values.groupBy("list").agg(F.count("*").alias("n")).collect()}
    for name in columns:
        own = values.where(F.col("list") == name).select(F.col("value").alias(name))
        listed = own.withColumn(f"_{name}", F.row_number().over(Window.orderBy(name)).cast("bigint") - 1)
        size = sizes.get(name, 0)
        number = number * size + F.col(f"_{name}")
        listed = F.broadcast(listed) if size <= BROADCAST else listed
        out = listed if out is None else out.crossJoin(listed)
    return out.select(number.alias("scenario_id"), *columns)


def first_of(df: DataFrame, key: str = "scenario_id") -> DataFrame:
    """The scenario of the least number; an error if there is none."""
    if df.isEmpty():
        raise ValueError("no scenarios")
    return df.orderBy(key).limit(1)


def shuffled(df: DataFrame, key: str = "scenario_id", seed: str = "0") -> Column:
    """Order of a shuffle that depends on the seed and key alone."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))


def batches(df: DataFrame, size: int = 40, limit: int = 8000, key: str = "scenario_id", seed: str = "0") -> DataFrame:
    """The first ``limit`` rows of a shuffle with ``batch_id``, ``size`` rows in each."""
    (place,) = text.spare(df, "_order")
    first = df.withColumn(place, shuffled(df, key, seed)).orderBy(place, key).limit(limit)
    number = F.row_number().over(Window.orderBy(place, key))
    return first.withColumn("batch_id", F.floor((number - 1) / size).cast("bigint")).drop(place)
