"""Decide on results as files of them arrive; append the accepted ones, and those to refine elsewhere."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import InheritableThread, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions import scoring


def accept_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, files_per_batch: int = 40, refine_sink: str | None = None) -> None:
    """Read new JSON files in micro-batches, add ``decision``, and append accepted rows by first language.

    Rows to refine go to ``refine_sink``, with a checkpoint of their own, if there is one.
    Handles what is there and ends; the checkpoints make a later call go on from
    there, and a batch that failed is written once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    decided = rows.withColumn("decision", scoring.decision(F.col("score"), F.col("refine_count"))).withColumn("language", F.col("first_language"))
    started = [_append(decided.where("decision = 'ACCEPT'"), sink, checkpoint)]
    if refine_sink is not None:
        started.append(_append(decided.where("decision = 'REFINE'"), refine_sink, f"{checkpoint}-refine"))
    for query in started:
        query.awaitTermination()


def _append(rows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).partitionBy("language").trigger(availableNow=True).start()


def refine_counts(events: DataFrame) -> DataFrame:
    """(scenario_id, refine_count): the running sum of refinements, of a table or of a stream in ``complete`` or ``update`` mode."""
    return events.groupBy("scenario_id").agg(F.sum("refine_count").cast("int").alias("refine_count"))


def accepted(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, decision string, language string").json(sink).drop("language")


def timed_batches(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, limit: float, notes: str, late: str | None = None) -> None:
    """Hand a stream's micro-batches to ``handle``; one that isn't done after ``limit`` seconds is cancelled, and the stream goes on.

    A batch's Spark jobs are cancelled by a tag of its own; work of ``handle`` outside of jobs is not.  Each batch is noted as
    a row (batch_id, status, seconds, noted_at) in the folder ``notes``, ``done`` or ``timed out``; a batch that is handed out again is noted again, and
    ``handle`` must bear that, as with any sink.  The rows of a cancelled batch are appended to ``late``, if given, with
    their ``batch_id``.  Other failures end the stream.  Handles what is there and ends.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark, tag, failed = batch.sparkSession, f"batch-{uuid.uuid4().hex}", []
        context, began = spark.sparkContext, time.monotonic()

        def work() -> None:
            context.addJobTag(tag)
            try:
                handle(batch, batch_id)
            except Exception as error:
                failed.append(error)
            finally:
                context.removeJobTag(tag)

        thread = InheritableThread(target=work)
        thread.start()
        thread.join(limit)
        out_of_time = thread.is_alive()
        while thread.is_alive():  # again, as its next job may have begun in between
            context.cancelJobsWithTag(tag)
            thread.join(1)
        if failed and not out_of_time:
            raise failed[0]
        if out_of_time and late is not None:
            batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").json(late)
        status = "timed out" if out_of_time else "done"
        spark.createDataFrame([(batch_id, status, time.monotonic() - began, time.time())], NOTES).coalesce(1).write.mode("append").json(notes)

    rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


NOTES = "batch_id bigint, status string, seconds double, noted_at double"


def noted(spark: SparkSession, notes: str) -> DataFrame:
    """The last note of each batch."""
    return spark.read.schema(NOTES).json(notes).groupBy("batch_id").agg(F.max_by(F.struct("status", "seconds"), "noted_at").alias("n")).select("batch_id", "n.*")


#: Spark's local property of the number of a stream's batch.
BATCH = "streaming.sql.batchId"


def _with_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their batch as the last column; it doesn't change if a batch comes again."""
    number = TaskContext.get().getLocalProperty(BATCH)
    if number is None:
        raise RuntimeError(f"{BATCH} isn't set: without the order of batches a last decision can't be told")
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([int(number)] * batch.num_rows, pa.int64())], [*batch.schema.names, "batch"])


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
REFINED = "scenario_id bigint, refine_count int, decisions int, decision string"


def refine_states(spark: SparkSession, events: DataFrame, sink: str, checkpoint: str) -> None:
    """Keep each scenario's refinements as state over a stream of (scenario_id, step, refine_count, decision), and append what changed.

    State are the sum of refinements, the number of decisions and the last decision.  Handles what is there and ends; a later
    call with the same checkpoint goes on with the state as it was.  Steps of a scenario in one batch are taken in their
    order, those without one first, and of equal ones the greatest decision last.  ``refined`` reads the last states.
    """
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        kept = events.select("scenario_id", "step", "refine_count", "decision")
        numbered = kept.mapInArrow(_with_batch, StructType([*kept.schema, StructField("batch", LongType())]))
        last = F.max_by("decision", F.struct("batch", F.col("step").isNotNull(), "step", "decision"))
        states = numbered.groupBy("scenario_id").agg(F.sum(F.coalesce("refine_count", F.lit(0))).cast("int").alias("refine_count"), F.count("*").cast("int").alias("decisions"), last.alias("decision"))
        write = lambda batch, k: batch.withColumn("batch_id", F.lit(k).cast("bigint")).write.mode("overwrite").json(f"{sink}/batch={k}")
        states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)


def refined(spark: SparkSession, sink: str) -> DataFrame:
    """The last state of each scenario."""
    states = spark.read.schema(f"{REFINED}, batch_id bigint").option("recursiveFileLookup", True).json(sink)
    return states.groupBy("scenario_id").agg(F.max_by(F.struct("refine_count", "decisions", "decision"), "batch_id").alias("s")).select("scenario_id", "s.*")


def new_topics(scenarios: DataFrame, seen: DataFrame, sink: str, checkpoint: str) -> None:
    """Append the rows of a stream that are the first of their topic, over all batches and calls, and whose topic isn't in the table ``seen``.

    Topics that came are state of the stream, so that a later call with the same checkpoint goes on from there; the table
    is joined as it is when a batch runs.
    """
    fresh = scenarios.join(seen.select("topic").distinct(), "topic", "left_anti").dropDuplicates(["topic"])
    fresh.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
