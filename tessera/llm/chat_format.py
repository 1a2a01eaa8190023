"""Chat formatting in budgeted windows.

A conversation's turns are marked by a template and packed into windows of at most
``budget`` tokens.  Prefix sums of the turns' tokens choose turn-aligned spans: what is
left of a window besides the system turn and the history is the room for new turns,
and the prefix sums are cut into cells of three quarters of it.  A turn belongs to the
window of the cell that it begins in if it ends there as well, or is no longer than the
last quarter; any other has a window of its own.  So each turn finds its window from
its own prefix sum, and a conversation of any length is dealt to all tasks.

Each window begins with the conversation's first turn if that is a system turn, repeats
the last turns that fit into ``history`` tokens, and goes on with new turns.  The loss
mask covers the text of each assistant turn in the one window where it is new, and
never a repeated turn.

A turn is never cut: one that is longer than a window is alone in its window, behind
the system turn.  Tokens are those of ``model_file`` (see ``bpe``), template included; the
template ends lines, and white space ends tokens, so that a window has as many as its
turns have.  Without a file, runs of word characters and other visible characters count.

Null texts and roles count as empty; a null ``conv_id`` is a conversation of its own;
rows are ordered by turn, role and text (nulls first), and repeated rows are repeated
turns.  Further columns are left out.  ``read_back`` reads the windows of a conversation
as a stream in one task, as the digest is one sequential hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm import bpe
from tessera.llm import textbytes as tb
from tessera.llm.shared import cut

START, END = "<|im_start|>", "<|im_end|>\n"
BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    """Text in which ``<|`` cannot occur: every ``<``, backslashes, ``|`` gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _escaped(text: Column) -> Column:
    """``escape`` as an expression."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _head(role: Column) -> Column:
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(START), _escaped(one_line), F.lit("\n"))


def counted(turns: DataFrame, model_file: str | None) -> DataFrame:
    """(conv_id, system, tokens, pid, seq) of ``turns``: ``tokens`` of each one in its template."""
    piece = F.concat(_head(F.col("role")), _escaped(F.col("text")), F.lit(END))
    pieces = turns.select("conv_id", (F.col("role") == "system").alias("system"), "pid", "seq", piece.alias("piece"))
    if model_file is None:
        pieces = pieces.withColumn("tokens", F.regexp_count("piece", F.lit(r"(?U)\w+|[^\w\s]")).cast("bigint"))
    else:
        pieces = bpe.encode(pieces, model_file, "piece", "ids").withColumn("tokens", F.size("ids").cast("bigint"))
    return pieces.select("conv_id", "system", "tokens", "pid", "seq")


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text, pid, seq): turns by range partitions; ``seq`` numbers them in order."""
    order, n = ["conv_id", "turn", "role", "text"], int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = conversations.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(ranged.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("seq")))


def placed(turns: DataFrame) -> DataFrame:
    """(seq, talk, system, tokens, fixed, start) of counted turns.

    ``talk`` is the first ``seq`` of the conversation, ``system`` marks its system turn, and
    ``fixed`` has that turn's tokens; ``start`` counts the tokens before a turn, that
    turn left out.  Sums are made in each partition; only those of the one conversation
    that each partition goes on with, a row at most for each, are carried from
    partition to partition by the driver.
    """
    turns = cut(turns)
    first = F.struct("seq", F.when(F.col("system"), F.col("tokens")).otherwise(0).alias("fixed"))
    parts = turns.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.min(first).alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("pid", F.sum("n").over(earlier).alias("n"), F.sum("tokens").over(earlier).alias("tokens"), F.min("first").over(earlier).alias("first")).where("n is not null")
    state = {r.pid: (r.first.seq, r.n, r.tokens, r.first.fixed) for r in carried.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, talk, number, before, fixed = None, None, 0, 0, 0, 0
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for conv_id, system, tokens, pid, seq in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "system", "tokens", "pid", "seq")), strict=True):
                if pid != part and pid in state:
                    talk, number, before, fixed = state[pid]
                elif pid != part or conv_id != conv:
                    talk, number, before, fixed = seq, 0, 0, tokens if system else 0
                conv, part = conv_id, pid
                for values, x in zip(out, (talk, number, fixed, max(0, before - fixed)), strict=True):
                    values.append(x)
                number += 1
                before += tokens
            talks, numbers, fixes, starts = (pa.array(x, pa.int64()) for x in out)
            system = pc.and_(batch.column("system"), pc.equal(numbers, 0))
            yield pa.RecordBatch.from_arrays([batch.column("seq"), talks, system, batch.column("tokens"), fixes, starts], names=["seq", "talk", "system", "tokens", "fixed", "start"])

    in_order = turns.repartition("pid").sortWithinPartitions("pid", "seq")
    return cut(in_order.mapInArrow(tb.tidy(run), "seq bigint, talk bigint, system boolean, tokens bigint, fixed bigint, start bigint"))


def windows(conversations: DataFrame, budget: int = 2048, history: int = 512, model_file: str | None = None) -> DataFrame:
    """(conv_id, talk, window, n_repeated, n_turns, n_tokens, formatted, loss) of all conversations.

    ``talk`` tells conversations apart, null ids included, and ``window`` orders those of
    one, with gaps.  ``loss`` holds the spans of ``formatted`` (in code points) to learn
    from; ``n_repeated`` tells how many leading turns an earlier window had as well.
    """
    rows = ordered(conversations)
    turns = placed(counted(rows, model_file))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.col("fixed"))
    spare = F.floor(room / 4)
    cell = F.greatest(F.lit(1), room - spare)
    begins, ends = F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("tokens") - 1) / cell)
    shared = (begins >= ends) | (F.col("tokens") <= spare) | (F.col("start") % cell == 0)
    window = F.when(F.col("system"), 0).when(shared, 2 * begins).otherwise(2 * begins + 1).cast("bigint")
    new = turns.withColumn("window", window)

    plain = new.where(~F.col("system"))
    spans = cut(plain.groupBy("talk", "window").agg(F.min("start").alias("begin"), F.sum("tokens").alias("new"), F.max("fixed").alias("fixed")))
    again = new.where("system").select("talk", "seq", "tokens").join(spans.where("window > 0").select("talk", "window"), "talk").select("seq", "talk", "window", "tokens")
    if history > 0:  # the turns before a window meet it by ranges of their tokens, each of which lies in two or three
        bucket = lambda x: F.floor(x / history)
        near = F.explode(F.sequence(bucket(F.col("start") + F.col("tokens")), bucket(F.col("start") + F.lit(history))))
        past = plain.where(F.col("tokens") <= history).select("talk", "seq", "start", "tokens", near.alias("bucket"))
        left = F.least(F.lit(history), F.lit(budget) - F.col("fixed") - F.col("new"))
        to_come = spans.select("talk", "window", "begin", left.alias("left"), bucket(F.col("begin")).alias("bucket"))
        met = past.join(to_come, ["talk", "bucket"]).where("start + tokens <= begin and start >= begin - left")
        again = again.unionByName(met.select("seq", "talk", "window", "tokens"))
    both = new.select("seq", "talk", "window", "tokens", F.lit(False).alias("repeated")).unionByName(again.withColumn("repeated", F.lit(True)))
    listed = F.array_sort(F.collect_list(F.struct("seq", "role", "text", "repeated"))).alias("turns")
    grouped = both.join(rows.select("conv_id", "role", "text", "seq"), "seq").groupBy("talk", "window").agg(F.first("conv_id").alias("conv_id"), F.sum("tokens").alias("n_tokens"), listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a window at a time
                row = batch.slice(k, 1)
                parts, loss, at, old = [], [], 0, 0
                listed = row.column("turns").to_pylist()[0]
                for t in listed:
                    head, body = f"{START}{escape_role(t['role'])}\n", escape(t["text"])
                    if t["repeated"]:
                        old += 1
                    elif t["role"] == "assistant":
                        loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
                    parts += [head, body, END]
                    at += len(head) + len(body) + len(END)
                made = [pa.array([old], pa.int64()), pa.array([len(listed)], pa.int64()), row.column("n_tokens"), pa.array(["".join(parts)]), pa.array([loss], span)]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("conv_id", "talk", "window")), *made], names=[*(f.name for f in schema)])

    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    rest = StructType.fromDDL("talk bigint, window bigint, n_repeated bigint, n_turns bigint, n_tokens bigint, formatted string, loss array<struct<start: bigint, stop: bigint>>")
    schema = StructType([rows.schema["conv_id"], *rest.fields])
    return grouped.mapInArrow(tb.tidy(run), schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, sizes: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sizes(row)
        if size >= BATCH_CHARS or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def turns_of(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the span of the escaped text, of each turn of a window."""
    found, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        stop = formatted.index(END, line + 1)
        found.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop]), line + 1, stop))
        at = stop + len(END)
    return found


def read_back(spans: DataFrame) -> DataFrame:
    """A digest of each conversation from its windows alone.

    New turns are those behind ``n_repeated``; what the loss mask covers is cut out
    of ``formatted`` and unescaped.
    """
    rest = StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint, n_repeated_turns bigint")
    schema = StructType([StructField("conv_id", spans.schema["conv_id"].dataType), *rest.fields])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        talk, state = None, None
        for batch in batches:
            for k in range(batch.num_rows):  # a window at a time
                row = batch.slice(k, 1).to_pylist()[0]
                if row["talk"] != talk:
                    if state:
                        yield state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]
                    talk, state = row["talk"], [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text, _, _ in turns_of(row["formatted"])[row["n_repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape(row["formatted"][span["start"] : span["stop"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(row["formatted"])
                state[6] += 1
                state[7] += row["n_repeated"]
        if state:
            yield state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(digests(batches), arrow, lambda _: 300)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return spans.repartition("talk").sortWithinPartitions("talk", "window").mapInArrow(tb.tidy(run), schema)
