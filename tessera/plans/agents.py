"""Generators and evaluators: recorded replies or calls of a function, never a network by themselves."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring, text
from tessera.plans import prompts
from tessera.sources.storage import read_lines, stored, write_lines, written_lines

# Fields of typed replies.  Those whose JSON type varies are raw text.
GENERATION_REPLY = "instances string"
FLUENCY_REPLY = "fluency_score double, errors string, summary string"
NATURALNESS_REPLY = "naturalness_score double, observations string, summary string"
CS_RATIO_REPLY = "ratio_score double, computed_ratio string, notes string"
SOCIAL_CULTURAL_REPLY = "socio_cultural_score double, issues string, summary string"

#: Adds a column of replies: (rows, prompt, name of the column).
Ask = Callable[[DataFrame, Column, str], DataFrame]


def rendered(template: str, names: list[str]) -> Column:
    """A template with ``{name}`` filled in from columns; nulls fill in nothing."""
    known = {"{" + name + "}": name for name in names}
    if not known:
        return F.lit(template)
    # the template is split once: braces in a value are text
    parts = re.split("(" + "|".join(map(re.escape, known)) + ")", template)
    return F.concat(*(F.coalesce(F.col("`" + known[p].replace("`", "``") + "`").cast("string"), F.lit("")) if p in known else F.lit(p) for p in parts))


def replay(df: DataFrame, replies: DataFrame, prompt: Column, reply: str) -> DataFrame:
    """Add column ``reply`` from a table (prompt_sha256, reply) of recorded replies; null where none is recorded.

    Rerunning a task or a job asks nobody again.
    """
    recorded = replies.select(F.col("prompt_sha256"), F.col("reply").alias(reply))
    return df.withColumn("prompt_sha256", F.sha2(prompt, 256)).join(recorded, "prompt_sha256", "left").drop("prompt_sha256")


def replayed(replies: DataFrame) -> Ask:
    return lambda df, prompt, reply: replay(df, replies, prompt, reply)


def answers(function: Callable, texts: list[str | None], retries: int, many: bool = False) -> list[tuple[object, str | None]]:
    """(answer, error) of a function for each prompt, asked again while it fails or gives nothing, ``retries`` times more at most.

    With ``many`` the function takes a list of prompts and gives a list as long; only those without an answer are asked again.
    """
    found: list[tuple[object, str | None]] = [(None, None)] * len(texts)
    left = list(range(len(texts)))
    for _ in range(1 + retries):
        if not left:
            break
        for some in [left] if many else [[i] for i in left]:
            try:
                given = list(function([texts[i] for i in some])) if many else [function(texts[some[0]])]
                if len(given) != len(some):
                    raise ValueError(f"{len(given)} answers to {len(some)} prompts")
                for i, answer in zip(some, given, strict=True):
                    found[i] = (answer or None, None)
            except Exception as error:
                for i in some:
                    found[i] = (None, f"{type(error).__name__}: {error}")
        left = [i for i in left if found[i][0] is None]
    return found


def call(df: DataFrame, prompt: Column, function: Callable, reply: str = "instances", retries: int = 4, kind: str = "array<string>", error: str | None = None, at_a_time: int | None = None) -> DataFrame:
    """Add ``reply`` by calling a function for each row, again while it fails or gives nothing, at most ``retries`` times more.

    A row at which it fails to the end gets null (an empty list where it gave nothing) and the failure's text
    in column ``error``, if one is named; other rows are not touched by it.  With ``at_a_time`` the function takes a list of so
    many prompts and gives a list of answers.  Write the result before it is used twice: tasks may
    be repeated, and so may calls; ``ReplyLog`` keeps the answers of calls.
    """
    (asked_by,) = text.spare(df, "_prompt")
    asked = df.withColumn(asked_by, prompt)
    array = kind == "array<string>"
    arrow = pa.list_(pa.string()) if array else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, at_a_time or whole.num_rows or 1):
                batch = whole.slice(at, at_a_time) if at_a_time else whole
                found = answers(function, batch.column(asked_by).to_pylist(), retries, at_a_time is not None)
                names = [n for n in batch.schema.names if n != asked_by]
                new = {reply: pa.array([[] if array and a is None and e is None else a for a, e in found], arrow)}
                if error is not None:
                    new[error] = pa.array([e for _, e in found], pa.string())
                own = [n for n in names if n not in new]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in own] + list(new.values()), names=[*own, *new])

    new = {reply: kind} | ({error: "string"} if error is not None else {})
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in new] + [f"`{n}` {k}" for n, k in new.items()])
    return asked.mapInArrow(run, schema)


def called(function: Callable, retries: int = 4, error: str | None = None, at_a_time: int | None = None) -> Ask:
    return lambda df, prompt, reply: call(df, prompt, function, reply, retries, "string", error, at_a_time)


@dataclass(frozen=True)
class ReplyLog:
    """Replies of calls, kept as the calls end, in a folder that the driver and all executors share.

    A prompt with a reply in the log isn't asked again, by no task, job or session: pending prompts are found
    by an anti-join, a task writes its replies ``flush`` at a time, and one that runs anew reads what an earlier attempt of it
    wrote.  Equal prompts are asked once.  Failures are kept with their text, and asked again by the next job.
    """

    path: str

    SCHEMA = "prompt_sha256 string, reply string, error string, job string, asked_at timestamp"

    def entries(self, spark: SparkSession) -> DataFrame:
        """All that was written, failures included."""
        found = written_lines(spark, self.path, self.SCHEMA)
        return found.where("prompt_sha256 is not null")

    def replies(self, spark: SparkSession) -> DataFrame:
        """(prompt_sha256, reply): one for each prompt."""
        return self.entries(spark).where("reply is not null").groupBy("prompt_sha256").agg(F.min_by("reply", F.struct("asked_at", "reply")).alias("reply"))

    def fill(self, prompts_of: DataFrame, function: Callable, retries: int = 4, at_once: int = 4, flush: int = 16) -> str:
        """Ask for the prompts (prompt) that have no reply yet, ``at_once`` in a task; returns the job's name in the log."""
        spark, job = prompts_of.sparkSession, uuid.uuid4().hex
        keyed = prompts_of.select(F.sha2("prompt", 256).alias("prompt_sha256"), "prompt").where("prompt is not null").dropDuplicates(["prompt_sha256"])
        pending = stored(keyed.join(self.replies(spark).select("prompt_sha256"), "prompt_sha256", "left_anti"), "pending")
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            folder = f"{path}/{job}-{TaskContext.get().partitionId()}"
            known = {json.loads(line)["prompt_sha256"] for line in read_lines(folder)}
            asked = 0
            with ThreadPoolExecutor(at_once) as pool:
                for batch in batches:
                    rows = [r for r in zip(*(batch.column(c).to_pylist() for c in ("prompt_sha256", "prompt")), strict=True) if r[0] not in known]
                    for at in range(0, len(rows), flush):
                        some = rows[at : at + flush]
                        found = pool.map(lambda r: answers(function, [r[1]], retries)[0], some)
                        write_lines(folder, [json.dumps({"prompt_sha256": k, "reply": a, "error": e, "job": job, "asked_at": datetime.now(timezone.utc).isoformat()}, ensure_ascii=False) for (k, _), (a, e) in zip(some, found, strict=True)])
                        asked += len(some)
            yield pa.RecordBatch.from_arrays([pa.array([asked])], names=["asked"])

        pending.mapInArrow(run, "asked bigint").write.format("noop").mode("overwrite").save()
        return job

    def ask(self, function: Callable, retries: int = 4, at_once: int = 4, flush: int = 16) -> Ask:
        """Asks through the log.  The rows are looked at twice, so their prompts must be the same each time."""

        def through(df: DataFrame, prompt: Column, reply: str) -> DataFrame:
            self.fill(df.select(prompt.alias("prompt")), function, retries, at_once, flush)
            return replay(df, self.replies(df.sparkSession), prompt, reply)

        return through

    def compact(self, spark: SparkSession, files: int = 1) -> "ReplyLog":
        """A log of the same entries in few files, at a new place; the old one can go when nothing reads it."""
        path = f"{self.path.rstrip('/')}-{uuid.uuid4().hex}"
        self.entries(spark).repartition(files).write.json(path)
        return ReplyLog(path)


def parsed(reply: Column, fields: str) -> Column:
    """A typed reply from its JSON text; null fields where it has none, null for null or unreadable text."""
    return F.when(F.try_parse_json(reply).isNotNull() & F.ltrim(reply).startswith("{"), F.from_json(reply, f"struct<{fields}>"))


@dataclass(frozen=True)
class Evaluator:
    """Asks about each row by a template, and adds the typed reply as column ``result``."""

    result: str
    template: str
    fields: str
    ask: Ask

    def __call__(self, df: DataFrame) -> DataFrame:
        (reply,) = text.spare(df, f"_{self.result}_reply")
        asked = self.ask(df, rendered(self.template, df.columns), reply)
        return asked.withColumn(self.result, parsed(F.col(reply), self.fields)).drop(reply)


@dataclass(frozen=True)
class Generator:
    """Asks for sentences, or better ones with the refiner's template, and adds them as ``instances``."""

    ask: Ask
    template: str = prompts.GENERATION

    def __call__(self, df: DataFrame) -> DataFrame:
        (reply,) = text.spare(df, "_instances_reply")
        asked = self.ask(df, rendered(self.template, df.columns), reply)
        return asked.withColumn("instances", text.sentences(parsed(F.col(reply), GENERATION_REPLY)["instances"])).drop(reply)


def standard(ask: Ask) -> dict[str, Evaluator]:
    """The four evaluators by result."""
    made = {
        "fluency_result": (prompts.FLUENCY, FLUENCY_REPLY),
        "naturalness_result": (prompts.NATURALNESS, NATURALNESS_REPLY),
        "cs_ratio_result": (prompts.CS_RATIO, CS_RATIO_REPLY),
        "social_cultural_result": (prompts.SOCIAL_CULTURAL, SOCIAL_CULTURAL_REPLY),
    }
    return {result: Evaluator(result, template, fields, ask) for result, (template, fields) in made.items()}


def ratio_context(df: DataFrame, percent: str = "lang2_percent", target: str = "cs_ratio") -> DataFrame:
    """Add what the ratio's prompt names: ``actual_percent``, ``target_second_percent`` and its complement; an unreadable target counts as 0."""
    goal = F.coalesce(scoring.target_percent(F.col(target)), F.lit(0.0))
    shown = {"actual_percent": F.col(percent), "target_second_percent": goal, "target_first_percent": 100.0 - goal}
    return df.withColumns({name: F.concat(text.one_decimal(x), F.lit("%")) for name, x in shown.items()})
