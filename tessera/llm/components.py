"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of ``links(a, b)``, of any ordered type; the root is a component's least node.

    Alternates large-star and small-star steps: each points a node's neighbours at the
    least of them, until no edge changes.  A step is aggregations and equi-joins, whose
    skewed partitions Spark splits; the number of rounds grows with the logarithm of
    the longest path.  No step adds edges, so each is written as no more files than the
    number of edges asks for; ``rows``, if given, bounds the links before they are counted.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    rows = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = cut(both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), rows)
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), rows)
        changed = after.join(edges, ["a", "b"], "left_anti").limit(1).count() or edges.join(after, ["a", "b"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
