"""Lookups: news of a topic, one article for each topic, and words by script ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.scripts import SCRIPT_RANGES, in_script

#: Rows that a task holds while it looks for the least of each key.
HELD = 50_000


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """(topic, article) from JSON lines of news; blank lines give no row."""
    return articles(spark.read.schema("topic string, title string, content string, type string").json(path))


def articles(raw: DataFrame) -> DataFrame:
    """(topic, article) from (topic, title, content): title and content on two lines; rows with an error ``type`` are empty."""
    body = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    failed = F.coalesce(F.col("type"), F.lit("")) != "" if "type" in raw.columns else F.lit(False)
    return raw.select("topic", F.when(failed, "").otherwise(body).alias("article"))


def pick_one(news: DataFrame, seed: str = "0") -> DataFrame:
    """One article for each topic: the least by a seeded hash, found by aggregation."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("article")).cast("binary"))
    return news.groupBy("topic").agg(F.min_by("article", F.struct(order, F.col("article"))).alias("article"))


def least_of_each(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The ``k`` least rows of each key in each partition, by ``order``; the ``k`` least of all are among them.

    A task sorts what it holds and one batch of rows at a time.  Beyond ``HELD`` rows it hands on what it holds, so
    that a partition of many keys gives some more rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (b for b in batches if b.num_rows):
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            rows = rows.sort_by([(c, "ascending") for c in [key, *order]])
            codes = np.asarray(rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
            held = rows.filter(pa.array(place < k))
            if len(held) > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return df.mapInArrow(run, df.schema)


def pick_some(news: DataFrame, k: int, seed: str = "0") -> DataFrame:
    """(topic, place, article): ``k`` articles of each topic, the least by a seeded hash, numbered from 1; fewer where there are no more.

    Repeated rows count each.  At most ``k`` rows of a topic leave a partition, unless it has more topics than it holds.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("article")).cast("binary"))
    few = least_of_each(news.select("topic", "article", order.alias("order")), "topic", ["order", "article"], k)
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("order", "article")))
    return placed.where(F.col("place") <= k).select("topic", "place", "article")


def sample_one(news: DataFrame, seed: str = "0") -> DataFrame:
    """One row of all, whatever its topic: the least by a seeded hash, found by aggregation."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("topic"), F.col("article")).cast("binary"))
    row = F.struct(*news.columns)
    return news.agg(F.min_by(row, F.struct(order, F.col("topic"), F.col("article"))).alias("one")).where("one is not null").select("one.*")


def with_news(scenarios: DataFrame, news: DataFrame) -> DataFrame:
    """Add ``article``: that of the scenario's topic, else an empty text.  ``news`` has one row for each topic."""
    return scenarios.join(news.select("topic", "article"), "topic", "left").withColumn("article", F.coalesce("article", F.lit("")))


def words_by_script(df: DataFrame, key: str, instances: str = "instances") -> DataFrame:
    """(key, script, n_words): words whose first letter is in a range of the script.

    The ranges are few and fixed, so each row tests the first letters of its words
    itself, and a row for each script, not for each word, is summed by key.
    """
    coded = df.select(key, text.first_letters(F.col(instances)).alias("codes"))
    count = lambda name: F.size(F.filter("codes", lambda c: in_script(c, name))).cast("bigint")
    counts = F.array(*(F.struct(F.lit(name).alias("script"), count(name).alias("n")) for name in SCRIPT_RANGES))
    scripts = coded.select(key, F.inline(counts)).where("n > 0")
    return scripts.groupBy(key, "script").agg(F.sum("n").alias("n_words"))


def _bits_of_width(lo: str, hi: str) -> Column:
    """Bits of the width of a range that isn't empty; 63 if they are more."""
    width = F.col(hi).cast("decimal(20)") - F.col(lo).cast("decimal(20)")
    return F.when(width >= 2**62, 63).when(width > 0, F.length(F.bin(width.cast("bigint")))).otherwise(0).cast("int")


def within_ranges(points: DataFrame, ranges: DataFrame, point: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Rows of ``points`` with each row of the table ``ranges`` that holds their whole number ``point`` (``lo`` to ``hi``, both included).

    A range of up to 2^k numbers is in one or two bins of that size, whatever k is, so ranges of all widths
    meet their points by equi-joins on (k, bin); a point looks at the sizes that occur, 64 at
    most.  Empty ranges and nulls hold nothing.  Columns of both tables are kept; they must differ.
    """
    size, bin_, of, at = text.spare(points.crossJoin(ranges.limit(0)), "_size", "_bin", "_of", "_at")
    # a wider range than 63 bits hold is one or two bins of the greatest size
    sized = ranges.where(F.col(lo) <= F.col(hi)).withColumn(size, _bits_of_width(lo, hi))
    sizes = sorted(r[0] for r in sized.select(size).distinct().collect())
    bins = lambda x, k: F.expr(f"shiftright(cast(`{x}` as bigint), {k})")
    binned = sized.withColumn(bin_, F.explode(F.sequence(bins(lo, f"`{size}`"), bins(hi, f"`{size}`"))))
    looks = points.where(F.col(point).isNotNull()).withColumn(of, F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn(at, bins(point, f"`{of}`"))
    met = looks.join(binned, (F.col(of) == F.col(size)) & (F.col(at) == F.col(bin_)))
    return met.where(F.col(point).between(F.col(lo), F.col(hi))).drop(size, bin_, of, at)


def range_totals(points: DataFrame, ranges: DataFrame, point: str, most: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(point, n_ranges, most): how many rows of the table ``ranges`` hold a whole number, and the greatest ``most`` of them.

    A row for each different ``point`` that a range holds.  The pairs that ``within_ranges`` gives aren't made, as they grow with the
    product of both tables: a range is cut into two blocks at most of each size 2^k, block b being the numbers from b 2^k to
    (b + 1) 2^k - 1, the ranges of a block are added up, and a point meets its one block of each size.  Empty ranges and nulls hold nothing.
    """
    held = ranges.where(F.col(lo) <= F.col(hi)).groupBy(F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi")).agg(F.count("*").alias("n"), F.max(most).alias("most"))
    held = held.withColumn("size", _bits_of_width("lo", "hi"))
    greatest = held.agg(F.max("size")).first()[0]
    sizes = range(0 if greatest is None else greatest + 1)
    # the first and the last block of a size that lie wholly in a range; of all of them only an odd first and an even last have no part in a greater one that does
    first = "shiftright(lo, k) + IF(shiftleft(shiftright(lo, k), k) = lo, 0, 1)"
    last = "shiftright(hi, k) - IF(shiftleft(shiftright(~hi, k), k) = ~hi, 0, 1)"
    cut = held.withColumn("k", F.explode(F.sequence(F.lit(0), "size"))).selectExpr("k", f"{first} AS first", f"{last} AS last", "n", "most").where("first <= last")
    blocks = cut.selectExpr("k", "explode(filter(array(IF(first & 1 = 1, first, NULL), IF(last & 1 = 0, last, NULL)), b -> b IS NOT NULL)) AS block", "n", "most")
    blocks = blocks.groupBy("k", "block").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    looks = points.select(point).where(F.col(point).isNotNull()).distinct().select(F.col(point).alias("point"), F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("k"))
    met = looks.withColumn("block", F.expr("shiftright(cast(point as bigint), k)")).join(blocks, ["k", "block"])
    return met.groupBy(F.col("point").alias(point)).agg(F.sum("n").alias("n_ranges"), F.max("most").alias(most))


def language_votes(df: DataFrame, ranges: DataFrame, key: str, instances: str = "instances") -> DataFrame:
    """(key, language, n_words, most) by a table (language, lo, hi): words whose first letter is in a language's ranges.

    A word counts once for each language whose ranges hold it; ``most`` is the language with most words, the first by name
    of equals.  Letters are counted for each key before they meet the ranges.
    """
    letters = df.select(key, F.explode(text.first_letters(F.col(instances))).alias("code")).where("code > 0").groupBy(key, "code").agg(F.count("*").alias("n"))
    hits = within_ranges(letters, ranges.select("language", "lo", "hi"), "code").select(key, "code", "n", "language").distinct()
    votes = hits.groupBy(key, "language").agg(F.sum("n").alias("n_words"))
    best = votes.groupBy(key).agg(F.min_by("language", F.struct(-F.col("n_words"), "language")).alias("most"))
    return votes.join(best, key)


def unseen(scenarios: DataFrame, seen: DataFrame) -> DataFrame:
    """The first scenario of each topic that ``seen`` doesn't have: those that add a topic to the set."""
    first = scenarios.groupBy("topic").agg(F.min("scenario_id").alias("scenario_id"))
    return first.join(seen.select("topic").distinct(), "topic", "left_anti")


def distinct_topics(df: DataFrame) -> DataFrame:
    return df.select("topic").distinct()
