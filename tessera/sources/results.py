"""Accepted results as JSON lines, one folder for each first language, and flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources.storage import folder  # noqa: F401

#: Values whose JSON type varies (lists, objects or texts) are read as raw text.
RESULT = """
topic string, tense string, perspective string, cs_ratio string, gender string, age string, education_level string,
first_language string, second_language string, conversation_type string, cs_function string, cs_type string,
data_generation_result string,
fluency_result struct<fluency_score: double, errors: string, summary: string>,
naturalness_result struct<naturalness_score: double, observations: string, summary: string>,
cs_ratio_result struct<ratio_score: double, computed_ratio: string, notes: string>,
social_cultural_result struct<socio_cultural_score: double, issues: string, summary: string>,
mcp_result string, summary string, score double, refine_count int
"""
#: Columns of a running scenario that an accepted row doesn't keep.
TRANSIENT = ["news_dict", "news_hash", "use_tools", "refiner_result", "article"]


def read(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Results in JSON lines (or one document with ``multi_line``), with ``instances``; blank lines give no row."""
    rows = spark.read.schema(RESULT).option("multiLine", multi_line).json(path)
    return rows.withColumn("instances", text.sentences(F.col("data_generation_result")))


def accept(results: DataFrame, path: str) -> None:
    """Append rows to a folder for each first language; the rows keep the language as well."""
    kept = results.drop(*TRANSIENT)
    kept.withColumn("language", F.col("first_language")).write.mode("append").partitionBy("language").json(path)


def read_accepted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, language string").json(path).drop("language")


def export_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A flat table as CSV with a header; ``single`` makes one file, for small exports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
