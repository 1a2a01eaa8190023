"""Share of each language in the sentences of a row.

``first_letter`` tells a word's language by its first letter; ``script_majority`` by
most of its characters.  Both pool the words of all sentences and need no shuffle.
What a target means differs: with ``first_letter`` it is the percentage of the second
(embedded) language, with ``script_majority`` that of the first (matrix) language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring, scripts, text


def word_language(word: Column, first: Column, second: Column) -> Column:
    """``lang1``, ``lang2`` or ``unknown``; the first language wins where ranges overlap."""
    code, (lo1, hi1), (lo2, hi2) = text.first_letter(word), scripts.range_of(first), scripts.range_of(second)
    return F.when(code.between(lo1, hi1), "lang1").when(code.between(lo2, hi2), "lang2").otherwise("unknown")


def _all(instances: str, split: callable) -> Column:
    present = F.coalesce(F.col(instances), F.array().cast("array<string>"))
    return F.flatten(F.transform(present, lambda s: split(F.coalesce(s, F.lit("")))))


def first_letter(df: DataFrame, instances: str = "instances", first: str = "first_language", second: str = "second_language") -> DataFrame:
    """Add ``lang1_word_count``, ``lang2_word_count``, ``unknown_words``, ``total_words``, both percentages and ``computed_ratio``.

    Without a word of either language the percentages are 0, the ratio is ``0% : 0%``
    and ``unknown_words`` and ``total_words`` are null.
    """
    (lo1, hi1), (lo2, hi2) = scripts.range_of(F.col(first)), scripts.range_of(F.col(second))
    # the words of a row are split once, into the code points of their first letters
    codes, *edges = text.spare(df, "_codes", "_lo1", "_hi1", "_lo2", "_hi2")
    coded = df.withColumns({codes: text.first_letters(F.col(instances))} | dict(zip(edges, (lo1, hi1, lo2, hi2), strict=True)))
    lo1, hi1, lo2, hi2 = map(F.col, edges)
    one = lambda c: c.between(lo1, hi1)
    count = lambda test: F.size(F.filter(codes, test)).cast("bigint")
    counts = {"lang1_word_count": count(one), "lang2_word_count": count(lambda c: c.between(lo2, hi2) & ~one(c)), "unknown_words": F.size(codes).cast("bigint")}
    counted = coded.withColumns(counts).drop(codes, *edges)
    counted = counted.withColumn("unknown_words", F.col("unknown_words") - F.col("lang1_word_count") - F.col("lang2_word_count"))
    return with_shares(counted, first, second)


def with_shares(counted: DataFrame, first: str = "first_language", second: str = "second_language") -> DataFrame:
    """Percentages and ratio text from ``lang1_word_count``, ``lang2_word_count`` and ``unknown_words``."""
    one, two = F.col("lang1_word_count"), F.col("lang2_word_count")
    total = one + two
    share = lambda n: F.coalesce(F.try_divide(n.cast("double"), total.cast("double")) * 100, F.lit(0.0))
    shared = counted.withColumns({"lang1_percent": share(one), "lang2_percent": share(two), "total_words": F.when(total > 0, total), "unknown_words": F.when(total > 0, F.col("unknown_words"))})
    ratio = F.concat(text.one_decimal(F.col("lang2_percent")), F.lit("% "), F.col(second), F.lit(" : "), text.one_decimal(F.col("lang1_percent")), F.lit("% "), F.col(first))
    # fixed values: the texts of details and of an empty ratio
    details = F.concat(F.lit("Counted "), one, F.lit(" "), F.col(first), F.lit(" words and "), two, F.lit(" "), F.col(second), F.lit(" words."))
    return shared.withColumns({"computed_ratio": F.when(total > 0, ratio).otherwise("0% : 0%"), "details": F.when(total > 0, details).otherwise("No words detected in text.")})


def first_letter_grouped(df: DataFrame, key: str, instances: str = "instances", first: str = "first_language", second: str = "second_language") -> DataFrame:
    """(key, languages, counts) by exploding words and grouping: partial sums before the shuffle."""
    lines = df.select(key, first, second, F.explode_outer(instances).alias("_line"))
    exploded = lines.select(key, first, second, F.explode_outer(F.split(F.coalesce("_line", F.lit("")), text.WHITE_SPACE)).alias("_word"))
    kind = F.when(F.col("_word") != "", word_language(F.col("_word"), F.col(first), F.col(second)))
    return exploded.select(key, first, second, kind.alias("_kind")).groupBy(key, first, second).agg(
        F.count_if(F.col("_kind") == "lang1").alias("lang1_word_count"), F.count_if(F.col("_kind") == "lang2").alias("lang2_word_count"), F.count_if(F.col("_kind") == "unknown").alias("unknown_words")
    )


def per_sentence(df: DataFrame, key: str, instances: str = "instances", first: str = "first_language", second: str = "second_language") -> DataFrame:
    """(key, sentence, matrix, embedded): counts of each sentence, numbered from 0."""
    rows = df.select(key, first, second, F.posexplode(instances).alias("sentence", "_line"))
    counted = first_letter(rows.withColumn("_one", F.array("_line")), "_one", first, second)
    return counted.select(key, "sentence", F.col("lang1_word_count").alias("matrix"), F.col("lang2_word_count").alias("embedded"))


def matrix_percent(matrix: Column, embedded: Column) -> Column:
    """Rounded percentage of the matrix language, ties to even; null without words."""
    return F.bround(F.try_divide(100.0 * matrix, (matrix + embedded).cast("double")), 0).cast("int")


def script_majority(df: DataFrame, instances: str = "instances", first: str = "first_language", second: str = "second_language", target: str = "cs_ratio") -> DataFrame:
    """Add ``matrix_count``, ``embedded_count``, ``computed_ratio``, ``ratio_score`` and ``notes``.

    A character of both scripts counts for the matrix language.  ``N/A`` and score 0
    where a script is unknown, both are one, or no word is of either.
    """
    m, e, votes = text.spare(df, "_m", "_e", "_votes")
    known = df.withColumns({m: scripts.script_of(F.col(first)), e: scripts.script_of(F.col(second))})
    vote = lambda w: F.struct(scripts.characters_in(w, F.col(m)).alias("m"), scripts.characters_in_either(w, F.col(m), F.col(e)).alias("both"))
    voted = known.withColumn(votes, F.transform(_all(instances, text.word_characters), vote))
    valid = (F.col(m) != "unknown") & (F.col(e) != "unknown") & (F.col(m) != F.col(e))
    size = lambda more: F.when(valid, F.size(F.filter(votes, more))).otherwise(0).cast("bigint")
    counted = voted.withColumns({"matrix_count": size(lambda v: v["m"] > v["both"] - v["m"]), "embedded_count": size(lambda v: v["both"] - v["m"] > v["m"])}).drop(votes)
    share, total = matrix_percent(F.col("matrix_count"), F.col("embedded_count")), F.col("matrix_count") + F.col("embedded_count")
    notes = (  # fixed values
        F.when((F.col(m) == "unknown") | (F.col(e) == "unknown"), "Unknown script mapping for one or both languages; deterministic ratio not computed.")
        .when(F.col(m) == F.col(e), "Both languages share the same script; deterministic script-based ratio not possible.")
        .when(total == 0, "No identifiable script characters found for either language.")
        .otherwise(F.concat(F.lit("Deterministic script ratio using "), F.col(first), F.lit("/"), F.col(second), F.lit(" ("), F.col(m), F.lit("/"), F.col(e), F.lit(").")))
    )
    result = {"computed_ratio": F.coalesce(F.concat(share, F.lit("% : "), 100 - share, F.lit("%")), F.lit("N/A")), "ratio_score": F.when(share.isNull(), 0.0).otherwise(scoring.step_score(share.cast("double"), F.col(target))), "notes": notes}
    return counted.withColumns(result).drop(m, e)
