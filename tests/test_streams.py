"""Streams with a deadline for each batch, state for each scenario, and topics seen so far; each ends and goes on."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import storage
from tessera.streaming import accept


def test_a_slow_batch_is_cancelled_and_the_stream_goes_on(spark):
    source, sink, late, notes, progress = (storage.folder(spark, n) for n in ("in", "out", "late", "notes", "progress"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").json(source)

    def stuck(batches):
        for batch in batches:
            if batch.num_rows and batch.column(0)[0].as_py() == 10:
                time.sleep(3600)
            yield batch

    handle = lambda batch, k: batch.mapInArrow(stuck, "id bigint").write.mode("append").json(sink)
    arriving = lambda: spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).json(source)
    began = time.monotonic()
    accept.timed_batches(arriving(), handle, progress, 15, notes, late)
    assert time.monotonic() - began < 120
    assert sorted(r.id for r in spark.read.schema("id bigint").json(sink).collect()) == [*range(10), *range(20, 30)]
    assert sorted(map(tuple, spark.read.schema("id bigint, batch_id bigint").json(late).collect())) == [(i, 1) for i in range(10, 20)]
    assert {r.batch_id: r.status for r in accept.noted(spark, notes).collect()} == {0: "done", 1: "timed out", 2: "done"}
    with pytest.raises(Exception, match="no good"):
        spark.range(5).coalesce(1).write.mode("append").json(source)

        def failing(batch, k):
            raise ValueError("no good")

        accept.timed_batches(arriving(), failing, progress, 15, notes)


def test_states_survive_a_restart(spark):
    source, sink, progress = (storage.folder(spark, n) for n in ("events", "states", "progress"))
    random.seed(3)
    schema, events = "scenario_id bigint, step int, refine_count int, decision string", []
    for run in range(2):
        for k in range(2):
            some = [(random.choice([1, 2, 3, None]), 10 * run + k + i % 2, random.choice([0, 3, None]), f"d{run}{k}{i}") for i in range(6)]
            events += some
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").json(source)
        accept.refine_states(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source), sink, progress)
        got = {r.scenario_id: (r.refine_count, r.decisions) for r in accept.refined(spark, sink).collect()}
        want = {k: (sum(e[2] or 0 for e in events if e[0] == k), sum(e[0] == k for e in events)) for k in {e[0] for e in events}}
        assert got == want
    assert spark.conf.get(accept.STATE_STORE).endswith("HDFSBackedStateStoreProvider")


def test_last_decisions_by_batch_then_step(spark):
    source, sink, progress = (storage.folder(spark, n) for n in ("events", "states", "progress"))
    schema = "scenario_id bigint, step int, refine_count int, decision string"
    parts = [[(1, 9, 1, "a"), (1, 2, 1, "z"), (2, None, 1, "n"), (3, 1, None, "x")], [(1, 3, 1, "b"), (1, 1, 1, "y"), (2, None, 0, "m"), (2, 0, 2, "l")], [(3, 0, 5, None), (None, 1, 4, "q")]]
    for some in parts:
        spark.createDataFrame(some, schema).repartition(2).write.mode("append").json(source)
        accept.refine_states(spark, spark.readStream.schema(schema).json(source), sink, progress)
    assert {r.scenario_id: (r.refine_count, r.decisions, r.decision) for r in accept.refined(spark, sink).collect()} == {1: (4, 4, "b"), 2: (3, 3, "l"), 3: (5, 2, None), None: (4, 1, "q")}


def test_states_of_many_scenarios(spark):
    n, schema = 200_000, "scenario_id bigint, step int, refine_count int, decision string"
    source, sink, progress = (storage.folder(spark, n) for n in ("events", "states", "progress"))
    spark.range(n).selectExpr("id AS scenario_id", "1 AS step", "2 AS refine_count", "'d' AS decision").write.json(source)
    began = time.monotonic()
    accept.refine_states(spark, spark.readStream.schema(schema).json(source), sink, progress)
    assert time.monotonic() - began < 60
    assert list(map(tuple, accept.refined(spark, sink).groupBy("refine_count", "decisions", "decision").count().collect())) == [(2, 1, "d", n)]


def test_parts_of_several_files_are_a_batch_each(spark, sf_dir, monkeypatch):
    from tessera import queries

    sinks, folder = [], storage.folder
    monkeypatch.setattr(queries, "FILE_ROWS", 60)
    monkeypatch.setattr(queries.results, "folder", lambda spark, name: sinks.append(folder(spark, name)) or sinks[-1])
    found = queries.q_refine_states(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert found.count() == n and found.where("decisions = 3").count() == n
    (sink,) = (path for path in sinks if "/states-" in path)
    assert [spark.read.json(f"{sink}/batch={k}").count() for k in range(3)] == [n, n, n]
    assert not any(name.endswith("batch=3") for name in os.listdir(sink))


def test_topics_come_once(spark):
    source, sink, progress = (storage.folder(spark, n) for n in ("talks", "topics", "progress"))
    schema, seen = "scenario_id bigint, topic string", spark.createDataFrame([("b",), ("b",)], "topic string")
    for topics in (["a", "b", "a"], ["c", "a"], ["c", "d", "b"]):
        spark.createDataFrame(list(enumerate(topics)), schema).coalesce(1).write.mode("append").json(source)
        accept.new_topics(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source), seen, sink, progress)
    rows = spark.read.schema(schema).json(sink)
    assert sorted(r.topic for r in rows.collect()) == ["a", "c", "d"]
    assert rows.where(F.col("topic") == "b").count() == 0
