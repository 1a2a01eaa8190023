"""Calls that fail, repeat or end half-way, and generators that never answer twice alike."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans import agents, pipeline
from tessera.sources import storage


def talks(spark, n, partitions=4):
    rows = [(i, f"t{i % 3}", "30%", "Arabic", "English", ["سلام hello", f"word{i}"]) for i in range(n)]
    return spark.createDataFrame(rows, "scenario_id bigint, topic string, cs_ratio string, first_language string, second_language string, instances array<string>").repartition(partitions)


def evaluate(df):
    return df.withColumns({"fluency_result": F.struct(F.lit(5.0).alias("fluency_score")), "naturalness_result": F.struct((F.size("instances") * 1.0).alias("naturalness_score")), "social_cultural_result": F.struct(F.lit(9.0).alias("socio_cultural_score"))})


def test_reevaluate_sees_one_evaluation(spark):
    def generate(df):  # replies differ between calls
        return agents.call(df.drop("instances"), F.col("topic"), lambda _: ["hello"] * random.choice([1, 30]))

    for _ in range(2):
        rows = pipeline.run(talks(spark, 400), generate, evaluate, refine_mode="reevaluate").select("scenario_id", "refine_count").collect()
        assert sorted(r.scenario_id for r in rows) == list(range(400))
        assert {r.refine_count for r in rows} == {0, 3}


def test_script_majority_asks_about_one_measurement(spark):
    def judge(df):
        noted = agents.call(df, F.col("topic"), lambda p: None if p == "t1" else str(random.random()), "said", retries=0, kind="string")
        return noted.withColumn("cs_ratio_result", F.when(F.col("said").isNotNull(), F.struct(F.lit(3.5).alias("ratio_score"), F.lit("x").alias("computed_ratio"), F.col("said").alias("notes"))))

    rows = pipeline.with_ratio(talks(spark, 60).withColumn("second_language", F.when(F.col("scenario_id") % 5 == 0, "Klingon").otherwise("English")), "script_majority", ask=judge).collect()
    assert sorted(r.scenario_id for r in rows) == list(range(60))
    for r in rows:
        if r.scenario_id % 5 == 0:
            assert r.cs_ratio_result.computed_ratio == "N/A" and r.said is None
        elif r.topic == "t1":  # the evaluator gave nothing: what was measured stands
            assert r.cs_ratio_result.notes.startswith("Deterministic") and r.cs_ratio_result.ratio_score != 3.5
        else:
            assert r.cs_ratio_result.ratio_score == 3.5


def test_values_are_not_rendered_again(spark):
    df = spark.createDataFrame([("say {b}", "BB", None)], "a string, b string, `{c}` string")
    shown = df.select(agents.rendered("{a}! {b}{{a}} {d} {{c}}", df.columns).alias("x"), agents.rendered("plain {a}", []).alias("y")).first()
    assert tuple(shown) == ("say {b}! BB{say {b}} {d} ", "plain {a}")


def test_a_call_that_fails_concerns_its_row_alone(spark):
    seen = []

    def function(prompt):
        seen.append(prompt)
        if prompt == "t1":
            raise ValueError("out of order")
        return [] if prompt == "t2" else [prompt]

    found = agents.answers(function, ["t0", "t1", "t2", None], 2)
    assert found == [(["t0"], None), (None, "ValueError: out of order"), (None, None), ([None], None)] and seen == ["t0", "t1", "t2", None, "t1", "t2", "t1", "t2"]
    rows = agents.call(talks(spark, 9).withColumn("_prompt", F.lit("own")), F.col("topic"), lambda p: 1 / 0 if p == "t1" else ([] if p == "t2" else [p]), error="failure", retries=1).collect()
    assert {r.topic: (r.instances, r.failure, r._prompt) for r in rows} == {"t0": (["t0"], None, "own"), "t1": (None, "ZeroDivisionError: division by zero", "own"), "t2": ([], None, "own")}


def test_prompts_in_lists(spark):
    def function(prompts):
        assert len(prompts) <= 5
        if "t1" in prompts and len(prompts) > 1 and random.random() < 0.2:
            raise OSError("flaky")
        return [None if p == "t2" else p.upper() for p in prompts]

    rows = agents.call(talks(spark, 40), F.col("topic"), function, "reply", retries=9, kind="string", at_a_time=5).collect()
    assert {(r.topic, r.reply) for r in rows} == {("t0", "T0"), ("t1", "T1"), ("t2", None)}
    short = agents.answers(lambda ps: ps[1:], ["a", "b"], 0, many=True)
    assert short == [(None, "ValueError: 1 answers to 2 prompts")] * 2


def test_a_job_that_was_killed_asks_nobody_twice(spark, tmp_path):
    asked, path = tmp_path / "asked", storage.folder(spark, "log")
    asked.mkdir()
    log, docs = agents.ReplyLog(path), talks(spark, 80).select(F.col("scenario_id").cast("string").alias("prompt"))

    def function(prompt):
        (asked / f"{prompt}-{time.monotonic_ns()}").touch()
        if (asked / "stop").exists() and int(prompt) % 7 == 3:
            time.sleep(3600)  # until the job is killed
        return f"reply {prompt}"

    (asked / "stop").touch()
    tag, ended = "killed-half-way", []

    def first():
        spark.sparkContext.addJobTag(tag)
        try:
            log.fill(docs, function, at_once=2, flush=2)
        except Exception as error:
            ended.append(error)

    from pyspark import InheritableThread

    thread = InheritableThread(target=first)
    thread.start()
    deadline = time.monotonic() + 60
    while log.replies(spark).count() < 8 and time.monotonic() < deadline:
        time.sleep(0.5)
    spark.sparkContext.cancelJobsWithTag(tag)
    thread.join(30)
    assert ended and not thread.is_alive()
    (asked / "stop").unlink()
    kept = {r.prompt_sha256 for r in log.replies(spark).collect()}
    assert len(kept) >= 8
    calls = lambda: [re.sub("-.*", "", p.name) for p in asked.iterdir()]
    before = len(calls())
    log.fill(docs, function)
    assert len(calls()) - before == 80 - len(kept)
    log.fill(docs, function)
    assert len(calls()) - before == 80 - len(kept)
    out = log.ask(function)(docs, F.col("prompt"), "reply").collect()
    assert {(r.prompt, r.reply) for r in out} == {(str(i), f"reply {i}") for i in range(80)}
    small = log.compact(spark, 2)
    assert small.replies(spark).count() == 80
    assert storage.removed(spark, path) and not storage.removed(spark, path)
    assert log.entries(spark).count() == 0


def test_a_task_that_runs_again_reads_what_it_wrote(spark):
    path = storage.folder(spark, "lines")
    assert list(storage.read_lines(path)) == []
    storage.write_lines(path, ["{\"a\": 1}", "é"])
    storage.write_lines(path, [])
    assert list(storage.read_lines(path)) == ["{\"a\": 1}", "é"]


def test_calls_at_once_are_bounded(spark, tmp_path):
    def function(prompt):
        mine = tmp_path / prompt
        mine.touch()
        now = len(list(tmp_path.iterdir()))
        time.sleep(0.01)
        mine.unlink()
        return str(now)

    log = agents.ReplyLog(storage.folder(spark, "log"))
    log.fill(talks(spark, 30, 1).select(F.col("scenario_id").cast("string").alias("prompt")).coalesce(1), function, at_once=3)
    assert max(int(r.reply) for r in log.replies(spark).collect()) <= 3


@pytest.mark.parametrize("raw,kind", [('["a"]', "list"), (" [1, null]", "list"), ('{"a": 1}', "object"), ("12", "number"), ("1.5", "number"), ("1e400x", "text"), ("true", "boolean"), ("null", "null"), ("[a", "text"), ("", "text"), ('"q"', "text"), (None, None)])
def test_kinds(spark, raw, kind):
    assert spark.createDataFrame([(raw,)], "raw string").select(text.kind_of(F.col("raw")).alias("k")).first().k == kind
