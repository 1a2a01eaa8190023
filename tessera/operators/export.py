"""Flattened exports of accepted results, and their preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

# Columns of a result that exports keep, and those of the preview further down.
METADATA = ["topic", "tense", "perspective", "cs_ratio", "gender", "age", "education_level", "first_language", "second_language", "conversation_type", "cs_function", "cs_type", "score", "refine_count"]
# The order of the columns of both exports.
SENTENCE_ORDER = [
    "topic", "text", "score", "fluency_score", "naturalness_score", "cs_ratio_score", "socio_cultural_score", "fluency_errors",
    "naturalness_observations", "cs_ratio_computed", "cs_ratio_notes", "socio_cultural_issues", "tense", "perspective",
    "conversation_type", "cs_ratio", "cs_type", "cs_function", "gender", "age", "education_level", "refine_count", "sentence_index",
    "fluency_summary", "naturalness_summary", "socio_cultural_summary",
]
SCENARIO_ORDER = ["topic", "text", "score", "cs_ratio", "cs_type", "cs_function", "tense", "perspective", "conversation_type", "first_language", "second_language", "gender", "age", "education_level", "refine_count"]
PREVIEW = ["topic", "cs_ratio", "cs_ratio_computed", "cs_ratio_score", "cs_ratio_notes", "sentence_index", "refine_count", "text"]


def reordered(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns that exist, in that order, then the others."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def with_metadata(df: DataFrame) -> DataFrame:
    """Metadata columns that are missing become nulls."""
    kinds = {"score": "double", "refine_count": "int"}
    return df.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in METADATA if c not in df.columns})


def sentences(results: DataFrame, compat: bool = False) -> DataFrame:
    """One row for each sentence; a result without sentences keeps one row with index 0."""
    agents = {
        "fluency_score": F.col("fluency_result.fluency_score"),
        "naturalness_score": F.col("naturalness_result.naturalness_score"),
        "cs_ratio_score": F.col("cs_ratio_result.ratio_score"),
        "socio_cultural_score": F.col("social_cultural_result.socio_cultural_score"),
        "fluency_errors": text.listed(F.col("fluency_result.errors"), compat),
        "naturalness_observations": text.listed(F.col("naturalness_result.observations"), compat),
        "cs_ratio_computed": F.col("cs_ratio_result.computed_ratio"),
        "cs_ratio_notes": F.col("cs_ratio_result.notes"),
        "socio_cultural_issues": text.listed(F.col("social_cultural_result.issues"), compat),
        "fluency_summary": F.col("fluency_result.summary"),
        "naturalness_summary": F.col("naturalness_result.summary"),
        "socio_cultural_summary": F.col("social_cultural_result.summary"),
    }
    flat = with_metadata(results).select(*METADATA, *(v.alias(k) for k, v in agents.items()), F.posexplode_outer("instances").alias("_index", "text"))
    return reordered(flat.withColumn("sentence_index", F.coalesce("_index", F.lit(0))).drop("_index"), SENTENCE_ORDER)


def scenarios(results: DataFrame) -> DataFrame:
    """One row for each result, nested values as JSON text."""
    nested = {f.name: F.to_json(f.name) for f in results.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
    return reordered(results.withColumns(nested), SCENARIO_ORDER)


def preview(exported: DataFrame, order: list[str], rows: int = 12, compat: bool = False) -> DataFrame:
    """The first rows by ``order``, with a short text, notes on one line, and the score with two decimals.

    With ``compat`` notes that are missing show as ``nan``.
    """
    first = exported.orderBy(*order).limit(rows).select(*PREVIEW)
    notes = F.col("cs_ratio_notes").cast("string")
    notes = F.coalesce(notes, F.lit("nan")) if compat else notes
    return first.withColumns({"text": text.shortened(F.col("text")), "cs_ratio_notes": text.one_line(notes), "cs_ratio_score": text.two_decimals(F.col("cs_ratio_score"))})


def items(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, kind, place, name, value): a row for each item of a list, each entry of an object, and each other value.

    ``raw`` has values of varying JSON type as raw text (see ``text.kind_of``).  ``place`` counts items from 0, entries by name; ``name`` is
    an entry's.  An empty list or object gives a row without them; null gives none.
    """
    typed = df.where(F.col(raw).isNotNull()).select(F.col(key).alias("of"), F.col(raw).alias("raw"), text.kind_of(F.col(raw)).alias("kind"), F.try_parse_json(raw).alias("parsed"))
    shaped = typed.withColumn("parsed", F.when(F.col("kind").isin("list", "object"), F.col("parsed")))
    each = shaped.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("parsed").outer()), how="left")
    value = F.when(F.col("parsed").isNull(), F.col("raw")).otherwise(F.col("value").cast("string"))
    return each.select(F.col("of").alias(key), "kind", F.col("pos").cast("bigint").alias("place"), F.col("key").alias("name"), value.alias("value"))
