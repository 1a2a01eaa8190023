"""Table functions in SQL, a source of configuration files, appends that may be repeated, some of each group, and reports read back."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import lookup, report
from tessera.plans import tables, tools
from tessera.sources import batches, lists, storage


def test_sentences_in_sql(spark):
    tables.register(spark, {})
    talks = spark.createDataFrame([(1, ["a", None, "c"], "x", {"k": 1}), (2, [], "y", None), (3, None, "z", None)], "k int, lines array<string>, Text string, m map<string,int>")
    found = spark.sql("SELECT * FROM sentences(TABLE({t}), 'lines')", t=talks)
    assert found.columns == ["k", "m", "sentence_index", "text"]
    assert [tuple(r) for r in found.orderBy("sentence_index").collect()] == [(1, {"k": 1}, 0, "a"), (1, {"k": 1}, 1, None), (1, {"k": 1}, 2, "c")]
    assert spark.sql("SELECT * FROM sentences(TABLE({t}), 'lines')", t=talks.limit(0)).count() == 0
    for wrong in ("sentences(TABLE({t}), 'k')", "sentences(TABLE({t}), 'none')", "sentences(1, 'lines')"):
        with pytest.raises(Exception, match="no column of lists|must be a table"):
            spark.sql(f"SELECT * FROM {wrong}", t=talks)


def test_a_failing_tool_in_sql(spark):
    tool = tools.FunctionTool("share", lambda a, b: a / b if b != 7 else None, "a", "b")
    assert tables.register(spark, {"share": tool, "word_count": tools.WordCount()}) == ["sentences", "share_rows"]
    rows = spark.createDataFrame([(1, 2, "x"), (1, 0, "y"), (None, 1, "z"), (1, 7, "w")], "a int, b int, value string")
    found = {r.b: (r.value, (r.error or "").partition(":")[0]) for r in spark.sql("SELECT * FROM share_rows(TABLE({t}))", t=rows).collect()}
    assert found == {2: ("0.5", ""), 0: (None, "ZeroDivisionError"), 1: (None, "TypeError"), 7: (None, "")}
    with pytest.raises(Exception, match="lacks b"):
        spark.sql("SELECT * FROM share_rows(TABLE({t}))", t=rows.drop("b"))


def test_configuration_files_as_a_table(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("topics: [x, 2, سلام]\ncharacter_setting:\n  age: [young]\n  empty: []\nuse_tools: true\nnone: null\n")
    (tmp_path / "b.json").write_text(json.dumps({"topics": ["y", {"k": 1}]}))
    (tmp_path / "c.txt").write_text("no configuration")
    (tmp_path / "d.json").write_text("[]")
    lists.register(spark)
    read = lambda **options: spark.read.format("scenario_lists").options(**options).load(str(tmp_path))
    good = read(files="a.yaml, b.json")
    assert good.rdd.getNumPartitions() == 2 and read(files="b.json").rdd.getNumPartitions() == 1
    a = [("a.yaml", "topics", 0, "x"), ("a.yaml", "topics", 1, "2"), ("a.yaml", "topics", 2, "سلام")]
    b = [("b.json", "topics", 0, "y"), ("b.json", "topics", 1, '{"k": 1}')]
    rest = [("a.yaml", "character_setting.age", 0, "young"), ("a.yaml", "use_tools", 0, "true"), ("a.yaml", "none", 0, None)]
    assert Counter(map(tuple, good.collect())) == Counter(a + b + rest)
    assert sorted(map(tuple, read(files="a.yaml,b.json", names="topics").collect())) == sorted(a + b)
    both = good.where("file = 'a.yaml' AND name = 'topics'").unionByName(good.where("file = 'b.json'"))
    assert sorted(map(tuple, both.collect())) == sorted(a + b)
    assert read(files="none.yaml").count() == 0
    with pytest.raises(Exception, match="d.json holds no mapping"):
        read(files="d.json").collect()


def test_appends_may_be_repeated(spark):
    path, schema = storage.folder(spark, "sink"), "id bigint, first_language string, language string"
    some = lambda lo, hi: spark.range(lo, hi).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "A/b").otherwise("English").alias("first_language"), F.lit("own").alias("language"), F.lit(1).alias("use_tools"))
    ids = lambda: sorted(r.id for r in batches.read(spark, path, schema).where("language = 'own'").collect())
    assert batches.read(spark, path, schema).count() == 0 and batches.compact(spark, path, schema) == -1
    assert batches.append(some(0, 50), path, 0) and batches.append(some(50, 90), path, 3)
    assert batches.append(some(50, 100), path, 3) and ids() == list(range(100))
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=9/language=x")  # of a batch that was killed
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    (lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p))(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/upto=7"))
    assert ids() == list(range(100))
    assert batches.compact(spark, path, schema, rows_per_file=20) == 3 and ids() == list(range(100))
    assert not batches.append(some(0, 50), path, 0) and not batches.append(some(50, 100), path, 3)
    assert batches.append(some(100, 110), path, 4) and ids() == list(range(110))
    files = batches.read(spark, path, schema).where("id < 100").withColumn("file", F.input_file_name()).groupBy("first_language").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n"))
    counted = {r.first_language: (r.files, r.n) for r in files.collect()}
    assert set(counted) == {None, "A/b", "English"} and all(f <= -(-n // 20) for f, n in counted.values())
    assert batches.compact(spark, path, schema) == 4 and ids() == list(range(110))


def test_a_stream_appends_batches(spark):
    source, sink, progress = (storage.folder(spark, n) for n in ("in", "out", "progress"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select("id", F.lit("French").alias("first_language")).coalesce(1).write.mode("append").json(source)
    failed = []

    def handle(batch, k):
        batches.append(batch, sink, k)
        if k == 1 and not failed:  # written, but not yet noted by the stream
            failed.append(k)
            raise ValueError("lost")

    rows = spark.readStream.schema("id bigint, first_language string").option("maxFilesPerTrigger", 1).json(source)
    start = lambda: rows.writeStream.foreachBatch(handle).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="lost"):
        start()
    start()
    assert sorted(r.id for r in batches.read(spark, sink, "id bigint, first_language string").collect()) == list(range(30))


def test_some_of_each_topic(spark, monkeypatch):
    random.seed(2)
    rows = [(random.choice(["a", "b", "b", "b", None, "rare"] if i else ["rare"]), random.choice([None, "same", f"text {i}"])) for i in range(3000)]
    news = spark.createDataFrame(rows, "topic string, article string").repartition(6).cache()
    few = lookup.least_of_each(news.select("topic", "article"), "topic", ["article"], 3)
    assert max(r.n for r in few.groupBy(F.spark_partition_id(), "topic").agg(F.count("*").alias("n")).collect()) == 3
    plain = news.withColumn("h", F.md5(F.concat_ws(":", F.lit("s"), "article").cast("binary"))).collect()
    for k in (1, 3, 5000):
        want = Counter()
        for topic in {r.topic for r in plain}:
            own = sorted((r for r in plain if r.topic == topic), key=lambda r: (r.h, r.article is not None, r.article or ""))
            want.update((topic, i + 1, r.article) for i, r in enumerate(own[:k]))
        assert Counter(map(tuple, lookup.pick_some(news, k, "s").collect())) == want
    one = {r.topic: r.article for r in lookup.pick_some(news, 1, "s").collect() if r.topic}
    assert lookup.pick_some(news.limit(0), 3).count() == 0 and set(one) == {"a", "b", "rare"}


def test_reports_come_back(spark):
    random.seed(4)
    counts = [(f"k{i}", j, random.choice([0, 3, 12]), random.choice([0, 5])) for i in range(40) for j in range(random.choice([1, 2, 30]))]
    table, path = spark.createDataFrame(counts, "k string, sentence int, matrix bigint, embedded bigint"), storage.folder(spark, "report")
    report.write_sentences(table, "k", path)
    spark.createDataFrame([("  sentence 1: matrix_pct=1 words=1/1",), ("row odd:",), ("something else",)], "line string").coalesce(1).write.mode("append").text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 100)  # splits within records
        found = report.read_sentences(spark, path, "k")
        assert found.rdd.getNumPartitions() > 20
        assert sorted((r.k, r.sentence, r.matrix, r.embedded) for r in found.collect()) == sorted(counts)
        assert all((r.matrix_pct is None) == (r.matrix + r.embedded == 0) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    report.write_sentences(table.limit(0), "k", storage.folder(spark, "empty"))
