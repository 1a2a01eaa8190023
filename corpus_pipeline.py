"""Corpus pipeline: five stages over ``documents``, each a table that the next one reads.

Low-quality documents go, then repeated runs of lines, then all but one of each
group of near copies, then documents with benchmark passages; what is left is
encoded.

Stages take any table with the columns of documents; further ones are left out, however
they are named, and an empty table gives an empty one.  A null text counts as empty:
it has no lines, no copies and no passages, and as many tokens as an empty one.  A null
id is an id of its own, and nothing is learned from its rows.  Rows of one id and text
are one document at one place until ``near_copies`` keeps one of them; rows of one id and
different texts are different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_classifier
from tessera.llm.shared import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; all of them if there is no trusted positive to learn from."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weights.any():
        return docs.select(COLUMNS)
    return quality_classifier.classify(docs, model).where("predicted = 1").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; one of which no word is left goes.

    Of equal runs that of the least id stays, the null id first, then of the least text hash.
    """
    found = line_dedup.dedup(docs.select(COLUMNS)).where("n_removed = 0 or n_removed < n_lines")
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed.cast("bigint")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, null ids last; documents without words stay."""
    return jaccard_join.keep_one(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.annotate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), reach=None)
    return found.where("n_hit = 0").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to; a row for each row."""
    import public_tokenizers

    found = bpe.round_trip(docs.select(COLUMNS), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("decontamination", decontamination), ("tokens", tokens)]

#: Two stages fit a model or call a tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
