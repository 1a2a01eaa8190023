"""Audit reports of measured ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import ratio, scoring
from tessera.sources.storage import stored


def statistics(df: DataFrame, score: str = "ratio_score") -> DataFrame:
    """One row: count, least, greatest and mean score."""
    return df.agg(F.count(score).alias("n"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"))


def parsed(computed: Column) -> Column:
    """Struct (first_percent, second_percent, first_language, second_language) of a ratio text; null for ``N/A``."""
    shape = r"^\s*([0-9]+(?:\.[0-9]+)?)%\s*([^:%]*?)\s*:\s*([0-9]+(?:\.[0-9]+)?)%\s*([^:%]*?)\s*$"
    part = lambda k: F.regexp_extract(computed, shape, k)
    name = lambda k: F.nullif(part(k), F.lit(""))
    value = F.struct(part(1).try_cast("double").alias("first_percent"), part(3).try_cast("double").alias("second_percent"), name(2).alias("first_language"), name(4).alias("second_language"))
    return F.when(computed.rlike(shape), value)


def mismatches(df: DataFrame, basis: str, computed: str = "computed_ratio", target: str = "cs_ratio", matrix_first: bool = True) -> DataFrame:
    """Add boolean ``mismatch``: the share of the ``basis`` language (``matrix`` or ``embedded``) isn't the target.

    ``matrix_first`` tells which share the ratio text names first.  An unreadable ratio
    or target is a mismatch.
    """
    if basis not in ("matrix", "embedded"):
        raise ValueError(f"unknown basis {basis!r}")
    found = parsed(F.col(computed))
    share = found["first_percent"] if (basis == "matrix") == matrix_first else found["second_percent"]
    return df.withColumn("mismatch", ~F.coalesce(share == scoring.target_percent(F.col(target)), F.lit(False)))


def by_sentence(counts: DataFrame, key: str) -> DataFrame:
    """Counts and matrix percentage for each sentence, for each key (``sentence`` null), and for all (both null)."""
    totals = counts.rollup(key, "sentence").agg(F.sum("matrix").alias("matrix"), F.sum("embedded").alias("embedded"), F.grouping_id().alias("level"))
    return totals.withColumn("matrix_pct", ratio.matrix_percent(F.col("matrix"), F.col("embedded")))


def progress(df: DataFrame, key: str, every: int = 200) -> DataFrame:
    """Rows at which a running count in order of ``key`` is divisible by ``every``, with that count.

    Rows are range-partitioned by the key; a row's number is its place in its partition
    and the rows of those before, of which there is one sum for each partition.
    """
    placed = stored(df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row for each partition at most
    number = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_before")
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(key, number.alias("n_done")).where(F.col("n_done") % every == 0)


def deviation(df: DataFrame, actual: str = "lang2_percent", target: str = "cs_ratio") -> DataFrame:
    """Add ``deviation``: the actual percentage less the target; null for an unreadable target."""
    return df.withColumn("deviation", F.col(actual) - scoring.target_percent(F.col(target)))


def _number(x: Column) -> Column:
    """A number as text, whole ones without decimals."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def lines(df: DataFrame, key: str, basis: str, computed: str = "computed_ratio", target: str = "cs_ratio", score: str = "ratio_score", matrix_first: bool = True) -> DataFrame:
    """(part, key, line): a report's lines in order of ``part`` and the key.

    Number of rows, columns, number of mismatches by ``basis``, each mismatch, and
    statistics of the score.
    """
    judged = mismatches(df, basis, computed, target, matrix_first)
    kind = judged.schema[key].dataType
    totals = judged.agg(F.count("*").alias("rows"), F.count_if("mismatch").alias("off"), F.count(score).alias("n"), F.min(score).alias("least"), F.max(score).alias("most"), F.avg(score).alias("mean"))
    columns = ", ".join(df.columns)
    head = lambda part, *texts: F.struct(F.lit(part).alias("part"), F.concat(*texts).alias("line"))
    stats = (F.lit(f"{score} stats: count="), F.col("n").cast("string"), F.lit(" min="), _number(F.col("least")), F.lit(" max="), _number(F.col("most")), F.lit(" mean="), _number(F.col("mean")))
    heads = F.array(
        head(0, F.lit("rows: "), F.col("rows").cast("string")),
        head(1, F.lit(f"columns: {columns}")),
        head(2, F.lit("mismatch_count: "), F.col("off").cast("string")),
        head(3, F.lit("sample_mismatches:")),
        head(5, *stats),
    )
    each = judged.where("mismatch").select(F.lit(4).alias("part"), F.col(key).alias("key"), F.concat(F.lit("- row "), F.col(key).cast("string"), F.lit(f": {target}="), F.coalesce(F.col(target), F.lit("None")), F.lit(f" {computed}="), F.coalesce(F.col(computed), F.lit("None")), F.lit(f" {score}="), F.coalesce(_number(F.col(score)), F.lit("None"))).alias("line"))
    return totals.select(F.inline(heads)).select("part", F.lit(None).cast(kind).alias("key"), "line").unionByName(each)


def sentence_lines(counts: DataFrame, key: str) -> DataFrame:
    """(key, sentence, line): a line for each key (``sentence`` null) and for each of its sentences, numbered from 1."""
    shown = F.coalesce(ratio.matrix_percent(F.col("matrix"), F.col("embedded")).cast("string"), F.lit("N/A"))
    each = counts.select(key, "sentence", F.concat(F.lit("  sentence "), (F.col("sentence") + 1).cast("string"), F.lit(": matrix_pct="), shown, F.lit(" words="), "matrix", F.lit("/"), "embedded").alias("line"))
    heads = counts.select(key).distinct().select(key, F.lit(None).cast("int").alias("sentence"), F.concat(F.lit("row "), F.col(key).cast("string"), F.lit(":")).alias("line"))
    return heads.unionByName(each)


def write_sentences(counts: DataFrame, key: str, path: str) -> None:
    """``sentence_lines`` as a text report, in order; all lines below a heading are in the heading's file."""
    ordered = sentence_lines(counts, key).repartitionByRange(key).sortWithinPartitions(key, F.col("sentence").asc_nulls_first())
    ordered.select("line").write.text(path)


def read_sentences(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, sentence, matrix, embedded, matrix_pct) of such a report: a heading's number goes to all lines below it.

    A record reaches from one heading to the next, wherever files are split.  ``key`` comes back as text, the sentence counts from
    0 again, and a percentage that was none is null.  Lines of no known form, and those before a first heading, are left out.
    """
    records = spark.read.option("lineSep", "\nrow ").text(path)
    headed = F.regexp_replace("value", r"^row ", "")  # of a file's first record
    found = F.split(headed, "\n")
    heading = F.regexp_extract(found[0], r"^(.*):$", 1)
    below = records.where(found[0].endswith(":")).select(heading.alias(key), F.explode(F.slice(found, 2, F.size(found))).alias("line"))
    shape = r"^  sentence (\d+): matrix_pct=(\d+|N/A) words=(\d+)/(\d+)$"
    part = lambda k, kind: F.regexp_extract("line", shape, k).try_cast(kind)
    numbers = [(part(1, "int") - 1).alias("sentence"), part(3, "bigint").alias("matrix"), part(4, "bigint").alias("embedded"), part(2, "int").alias("matrix_pct")]
    return below.where(F.col("line").rlike(shape)).select(key, *numbers)
