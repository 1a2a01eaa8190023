import pytest
from pyspark.sql import functions as F

from tessera.llm import components, jaccard_join, line_dedup, shared

LINE = "one two three four five six seven eight nine ten"


@pytest.fixture
def written(spark, monkeypatch):
    """Files of each table that is written, with 24 shuffle partitions that are not merged."""
    counts = []

    def counted(*args):
        out = shared.cut(*args)
        counts.append(out.rdd.getNumPartitions())
        return out

    for module in (components, jaccard_join, line_dedup):
        monkeypatch.setattr(module, "cut", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("24", "false"), strict=True):
        spark.conf.set(k, v)
    yield counts
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_edges_are_few_files(spark, written):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in components.components(links).collect()} == {(i, 0) for i in range(61)}
    assert written[0] == 24 and len(written) > 4 and set(written[1:]) == {1}
    written.clear()
    assert components.components(links, 60).count() == 61 and set(written) == {1}


def test_edges_beyond_a_file_are_more_files(spark, written, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 16)
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in components.components(links, 60).collect()} == {(i, 0) for i in range(61)}
    assert set(written) == {4}


def test_few_documents_are_few_files(spark, written):
    texts = [f"{LINE} a b c d e f g h i j k l m n {i // 3}" + " z" * (i % 3) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    assert jaccard_join.near_duplicates(docs).count() == 30
    assert len(written) > 8 and sum(n > 2 for n in written) == 1  # the verified blocks


def test_few_lines_are_few_files(spark, written):
    docs = spark.createDataFrame([(i, f"{i}\n{LINE}\n{LINE} {i % 2}\n{i}") for i in range(20)], "doc_id bigint, text string")
    assert line_dedup.dedup(docs).where("n_removed > 0").count() == 18
    assert len(written) == 5 and sum(n == 1 for n in written) == 2
