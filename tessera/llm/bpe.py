"""BPE encoding and decoding.

Ids are those that the tokenizers library gives for the whole text.  Where ASCII white
space only ends tokens, which is tried out (``drops_white_space``), each distinct run of
other characters is encoded once in a slice of text, and its ids are laid out for all
its places; runs are told apart by their bytes.  Texts of other tokenizers go to the
library as they are.

A run without white space that is longer than ``LEAF`` characters is encoded as
a tree: halves down to leaves, which are encoded together, then joined pairwise.
At each join a window around it is encoded anew and grows until two consecutive
tokens of it agree with both sides in id and place.  Neighbouring tokens that
are a valid pair anywhere are one everywhere, so the result is the encoding of the
unsplit text.  Runs of more than ``SPREAD`` characters are cut into rows that any tasks
encode; a run's parts then meet in one task, which encodes no more than the windows.

Null and empty texts have no ids; decoding no ids, or null, gives an empty text.
Repeated rows give a row each.  A column named like the result is replaced; others
are carried along.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.shared import Carried, cut

#: Characters of the longest run that is encoded at once, and of the longest that stays in one task.
LEAF, SPREAD = 1024, 1 << 16
LONG_RUN = rf"[^\x20\x09-\x0D]{{{SPREAD + 1},}}"
#: Characters of short runs that are encoded at once, and distinct runs that a task remembers before it starts afresh.
CALL, REMEMBERED = 4096, 400_000

Tokens = list[tuple[int, int, int]]


def load(model: str):
    """A tokenizer of the tokenizers library from the text of its file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def drops_white_space(tokenizer) -> bool:
    """Whether ASCII white space ends tokens and leaves no trace, so that runs between it can be encoded apart."""
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    parts = ["hello", "World's", "x1", "<|endoftext|>", "é."]
    spaces = [" ", "\n", "\t", "\x0b", "\x0c", "\r", "  ", " \n "]
    want = [i for p in parts for i in ids(p)]
    return all(ids(w + w.join(parts) + w) == want for w in spaces)


def _agree(side: Tokens, window: Tokens, last: bool) -> tuple[int, int] | None:
    """Where two consecutive tokens of ``side`` are also in ``window``: index of the second (of the first if ``last``) in both."""
    place = {(side[i], side[i + 1]): i for i in range(len(side) - 1)}
    for j in range(len(window) - 2, -1, -1) if last else range(len(window) - 1):
        if (i := place.get((window[j], window[j + 1]))) is not None:
            return i + 1, j + 1
    return None


def _joined(text: str, lo: int, at: int, hi: int, left: Tokens, right: Tokens, encode: Callable[[str, int], Tokens]) -> Tokens:
    reach = 32
    while True:
        a, b = max(lo, at - reach), min(hi, at + reach)
        window = encode(text[a:b], a)
        near = [k for k, t in enumerate(left) if t[2] > a]
        head = left[near[0] :] if near else []
        tail = [t for t in right if t[1] < b]
        first = (0, 0) if a == lo else _agree(head, window, last=False)
        final = (len(tail), len(window)) if b == hi else _agree(tail, window, last=True)
        if first and final and first[1] <= final[1]:
            kept = [] if a == lo else left[: len(left) - len(head) + first[0]]
            return kept + window[first[1] : final[1]] + right[final[0] :]
        if a == lo and b == hi:
            return window
        reach *= 2


def encode_tree(text: str, tokenizer, leaf: int = LEAF) -> Tokens:
    """(id, start, stop) of each token of a text without ASCII white space."""

    def encode(part: str, at: int) -> Tokens:
        found = tokenizer.encode(part, add_special_tokens=False)
        return [(i, a + at, b + at) for i, (a, b) in zip(found.ids, found.offsets, strict=True)]

    edges = [0, len(text)]
    while edges[1] - edges[0] > leaf:
        edges = sorted({*edges, *((a + b) // 2 for a, b in zip(edges, edges[1:], strict=False))})
    spans = list(zip(edges, edges[1:], strict=False))
    leaves = tokenizer.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False)
    parts = [(a, b, [(i, x + a, y + a) for i, (x, y) in zip(e.ids, e.offsets, strict=True)]) for (a, b), e in zip(spans, leaves, strict=True)]
    return joined_parts(text, parts, encode)


def joined_parts(text: str, parts: list[tuple[int, int, Tokens]], encode: Callable[[str, int], Tokens]) -> Tokens:
    """Tokens of a text from (start, stop, tokens) of its consecutive parts, by pairwise joins."""
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [(p[0][0], p[1][1], _joined(text, p[0][0], p[0][1], p[1][1], p[0][2], p[1][2], encode)) if len(p) == 2 else p[0] for p in pairs]
    return parts[0][2]


def spread_runs(texts: DataFrame, model) -> DataFrame:
    """(run, ids) of each different run of ``text`` beyond SPREAD characters: ``run`` is its sha256."""
    runs = texts.where(F.length("text") > SPREAD).select(F.explode(F.regexp_extract_all("text", F.lit(LONG_RUN), 0)).alias("piece"))
    runs = runs.withColumn("run", F.sha2("piece", 256)).dropDuplicates(["run"])
    places = F.sequence(F.lit(0), ((F.length("piece") - 1) / F.lit(SPREAD)).cast("int"))
    leaves = runs.select("run", "piece", F.explode(places).alias("k")).select("run", "k", F.expr(f"substring(piece, k * {SPREAD} + 1, {SPREAD})").alias("piece"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model.value)
        for batch in tb.slices(batches, "piece"):
            found = [np.array(encode_tree(t, tokenizer), np.int64).reshape(-1, 3) for t in batch.column("piece").to_pylist()]
            tokens = pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], names=["run", "k", "piece", "tokens"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model.value)

        def encode(part: str, at: int) -> Tokens:
            e = tokenizer.encode(part, add_special_tokens=False)
            return [(i, a + at, b + at) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

        rows = (r for batch in batches for part in tb.slices(iter([batch]), "piece") for r in zip(*(part.column(c).to_pylist() for c in ("run", "piece", "tokens")), strict=True))
        for run, group in groupby(rows, lambda r: r[0]):
            parts, text, at = [], [], 0
            for _, piece, tokens in group:
                parts.append((at, at + len(piece), [(i, a + at, b + at) for i, a, b in np.frombuffer(tokens, np.int64).reshape(-1, 3).tolist()]))
                text.append(piece)
                at += len(piece)
            ids = [t[0] for t in joined_parts("".join(text), parts, encode)]
            yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([ids], pa.list_(pa.int32()))], names=["run", "ids"])

    dealt = leaves.repartition("run", "k").mapInArrow(tb.tidy(encoded), "run string, k int, piece string, tokens binary")
    return dealt.repartition("run").sortWithinPartitions("run", "k").mapInArrow(tb.tidy(met), "run string, ids array<int>")


class Encoder:
    """Ids of texts; remembers the ids of runs by their bytes."""

    def __init__(self, model: str, seed: int) -> None:
        self.tokenizer, self.hasher = load(model), tb.Hasher(seed)
        self.in_runs = drops_white_space(self.tokenizer)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self, runs: list[bytes], long: dict[str, list[int]]) -> None:
        """Encode new runs; ``long`` has the ids of some by their sha256."""
        texts = [r.decode() for r in runs]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        owners, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        # short runs are encoded many at a time, with spaces between them; a token's start tells its run
        short = np.flatnonzero(sizes <= LEAF)
        ends = np.cumsum(sizes[short] + 1)
        edges = [0, *np.unique(np.searchsorted(ends, np.arange(CALL, int(ends[-1]), CALL))).tolist(), len(short)] if len(short) else [0]
        pieces = list(zip(edges, edges[1:], strict=False))
        found = self.tokenizer.encode_batch([" ".join(texts[i] for i in short[lo:hi].tolist()) for lo, hi in pieces], add_special_tokens=False)
        for (lo, hi), e in zip(pieces, found, strict=True):
            base = int(ends[lo - 1]) if lo else 0
            begins = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            owners.append(short[lo + np.searchsorted(ends[lo:hi] - base, begins, "right")])
            ids.append(np.array(e.ids, np.int32))
        for i in np.flatnonzero(sizes > LEAF).tolist():
            known = long.get(hashlib.sha256(runs[i]).hexdigest()) if sizes[i] > SPREAD else None
            ids.append(np.array([x[0] for x in encode_tree(texts[i], self.tokenizer)] if known is None else known, np.int32))
            owners.append(np.full(len(ids[-1]), i))
        owner = np.concatenate(owners)
        counts = np.bincount(owner, minlength=len(runs))
        self.known.update(zip(runs, range(len(self.counts), len(self.counts) + len(runs)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, np.concatenate(ids)[np.argsort(owner, kind="stable")]])

    def encode(self, text: pa.Array, long: dict[str, list[int]]) -> pa.Array:
        if not self.in_runs:
            found = self.tokenizer.encode_batch([t or "" for t in text.to_pylist()], add_special_tokens=False)
            return pa.array([e.ids for e in found], pa.list_(pa.int32()))
        data, offsets = tb.text_bytes(text)
        begins, ends, words = tb.spans_of(~tb.ASCII_SPACE[data], offsets)
        numbers = tb.numbered(data, begins, ends, self.hasher)
        one = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
        one[numbers] = np.arange(len(numbers))
        raw = data.tobytes()
        runs = [raw[a:b] for a, b in zip(begins[one].tolist(), ends[one].tolist(), strict=True)]
        if len(self.known) > REMEMBERED:
            self.forget()
        self.learn([r for r in runs if r not in self.known], long)
        at = np.fromiter((self.known[r] for r in runs), np.int64, len(runs))
        counts, starts = self.counts[at][numbers], self.starts[at][numbers]
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.ids[np.arange(total) + np.repeat(starts - stops + counts, counts)]
        bounds = np.concatenate([[0], stops])[words]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def _encoded(docs: DataFrame, model_file: str, carried: Carried, begin: Callable[[], Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch]]) -> DataFrame:
    """What a task's function, which it gets by ``begin()``, makes of each batch and its texts' ids."""
    model, seed = docs.sparkSession.sparkContext.broadcast(Path(model_file).read_text()), tb.draw()
    packed, runs = carried.pack(docs), F.lit(None).cast("map<string,array<int>>").alias("runs")
    spread = cut(spread_runs(packed.select("text"), model)) if drops_white_space(load(model.value)) else None
    if spread is None or spread.isEmpty():
        packed = packed.select("row", "text", runs)
    else:  # texts with such runs get their ids beside them
        has = F.coalesce((F.length("text") > SPREAD) & F.col("text").rlike(LONG_RUN), F.lit(False))
        some = packed.where(has).withColumn("of", F.sha2("text", 256))
        one = some.select("of", "text").dropDuplicates(["of"]).select("of", F.explode(F.regexp_extract_all("text", F.lit(LONG_RUN), 0)).alias("piece"))
        held = one.select("of", F.sha2("piece", 256).alias("run")).distinct().join(spread, "run").groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("run", "ids"))).alias("runs"))
        packed = packed.where(~has).select("row", "text", runs).unionByName(some.join(held, "of").select("row", "text", "runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, finish = Encoder(model.value, seed), begin()
        for batch in tb.slices(batches, "text"):
            column = batch.column("runs")
            long = {} if column.null_count == len(column) else {k: v for row in column.to_pylist() if row for k, v in row}
            yield finish(batch, encoder.encode(batch.column("text"), long))

    return carried.unpack(carried.map(packed, run))


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the token ids of each whole text, by the tokenizer in ``model_file`` (read on the driver)."""
    carried = Carried(docs, f"`{ids}` array<int>", text)
    return _encoded(docs, model_file, carried, lambda: lambda batch, found: carried.batch(batch, [found]))


def _rows(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each has about ``limit`` list items, or one row."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def _joiner(spark: SparkSession, model_file: str) -> Callable[[], Callable[[pa.Array], list[str]]]:
    """Gives a task its function from ids to decoded texts.

    Without a decoder in its file a tokenizer joins its tokens by spaces; for others
    its own ``decode`` is called for each row.
    """
    model = Path(model_file).read_text()
    tokenizer = load(model)
    vocabulary = tokenizer.get_vocab()
    strings = [""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        strings[i] = token
    plain = tokenizer.decoder is None
    shared = spark.sparkContext.broadcast(strings if plain else model)

    def begin() -> Callable[[pa.Array], list[str]]:
        if not plain:
            tokenizer = load(shared.value)
            return lambda column: [tokenizer.decode(x or [], skip_special_tokens=False) for x in column.to_pylist()]
        tokens = np.array(shared.value, object)

        def joined(column: pa.Array) -> list[str]:
            strings = tokens[np.asarray(column.flatten())]
            ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)), dtype=np.int64).tolist()
            return [" ".join(strings[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

        return joined

    return begin


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``, what the tokenizer's ``decode(ids, skip_special_tokens=False)`` gives."""
    carried, begin = Carried(encoded, f"`{decoded}` string", ids), _joiner(encoded.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = begin()
        for batch in _rows(batches, "text"):
            yield carried.batch(batch, [pa.array(join(batch.column("text")), pa.string())])

    return carried.unpack(carried.map(carried.pack(encoded), run))


def round_trip(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", digest: str = "decoded_sha256") -> DataFrame:
    """Put ``ids`` as by ``encode``, and ``digest``, the sha256 of what ``decode`` makes of them, in place of the text.

    Both are done by one Python worker of each task, and no text leaves it.
    """
    carried, joiner = Carried(docs, f"`{ids}` array<int>, `{digest}` string", text), _joiner(docs.sparkSession, model_file)

    def begin() -> Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch]:
        join = joiner()

        def finish(batch: pa.RecordBatch, found: pa.Array) -> pa.RecordBatch:
            digests = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in join(found)], pa.string())
            at = batch.schema.get_field_index("text")
            gone = pa.nulls(batch.num_rows, batch.schema.field(at).type)
            return carried.batch(batch.set_column(at, "text", gone), [found, digests])

        return finish

    return _encoded(docs, model_file, carried, begin).drop(text)
