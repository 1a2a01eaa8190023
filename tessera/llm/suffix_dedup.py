"""Suffix-array deduplication of repeated byte strings.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts earlier:
in a document with a smaller (id, text hash), or further left in the same one.

The suffix array is sparse.  In each string of LENGTH bytes the least hash of its
GRAM-byte tokens (the last of equals) selects an anchor, so that equal strings have
anchors at equal places; only suffixes at anchors are looked at, each standing for
a run of neighbouring string starts that share it.

1. Culling.  Anchors meet by the hash of their token.  Suffixes at tokens that occur
   once cannot be repeated and end here.
2. The other suffixes are range-partitioned by their leading bytes, with splitters that
   Spark samples, and sorted in each bucket.  Neighbours of equal bytes around are
   one run: all but the first are repeats.  The longest prefix that a suffix has in
   common with a neighbour bounds the strings of its run that can occur elsewhere; those
   of one token are sorted by a multikey quicksort over words of eight bytes, and of
   equal strings all but the first are repeats.
3. Boundaries.  A token whose suffixes reach the end of a bucket, or are more than a task
   sorts at once (``SORTED``), leaves the first of its strings undecided.  These are
   range-partitioned and sorted once more, as strings, so that equal ones are neighbours.

Hashes only cull; whatever is removed was compared byte by byte.  Equal runs that a task
gathers become one before the shuffle, which keeps strings that very many documents
share small.

Null texts count as empty.  Null ids come first.  Rows of one id and text are at one
place: neither is a repeat of the other.  Rows of one id are told apart by 64 bits of
their texts' hashes.  Ids of any ordered type: those that are no integers are numbered by
a global sort.  Columns named like a result are replaced; others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm import textbytes as tb
from tessera.llm.shared import Carried, cut, quoted

LENGTH, GRAM = 100, 40
NO_ID = -(1 << 63)
#: Anchors that a task gathers before it hands them on, about 27 bytes each; bytes of runs that it gathers.
HELD, GATHERED = 400_000, 2 << 20
#: Known anchors in a packet of their own, at least.
KNOWN = 4096
#: Suffixes that a task sorts at once, and strings.
SORTED, STRINGS = 1 << 14, 1 << 16
#: Bits of a position in ``least_at``; the rest of 64 bits are of the hash.
PLACE = 30
RUN = np.dtype([("h", "<u8"), ("doc", "<u4"), ("tie", "<i8"), ("at", "<u4"), ("n", "u1"), ("anchor", "u1"), ("many", "u1")])
RESULTS = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
PACKETS = "part bigint, base bigint, runs binary"
SHARED = "doc bigint, tie bigint, at int, n int, anchor int"
SUFFIXES = "decided boolean, doc bigint, tie bigint, at int, n int, anchor int, span binary"
MARKS = "doc bigint, tie bigint, at int, n int, string binary"


def least_at(hashes: np.ndarray, width: int) -> np.ndarray:
    """Where each window of ``width`` hashes has its least one, the last of equals."""
    top, place = tb.U64((1 << 64) - (1 << PLACE)), tb.U64((1 << PLACE) - 1)
    least = (hashes & top) | (place - np.arange(len(hashes), dtype=tb.U64))
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (place - (least & place)).astype(np.int64)


def runs_of(data: np.ndarray, offsets: np.ndarray, hasher: tb.Hasher) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one anchor: hash of its token, text, start, starts, and the anchor's place behind the start."""
    starts = tb.windows(offsets, LENGTH)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(tb.U64), none, none, none, none
    at = np.arange(len(data) - GRAM + 1)
    grams = hasher.spans(hasher.sums(data), at, at + GRAM)
    anchor = least_at(grams, LENGTH - GRAM + 1)[starts]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lo, n = starts[first], np.diff(np.append(first, len(starts)))
    text = np.searchsorted(offsets, lo, "right") - 1
    return grams[anchor[first]], text, lo - offsets[text], n, anchor[first] - lo


def packed(h: np.ndarray, doc: np.ndarray, tie: np.ndarray, at: np.ndarray, n: np.ndarray, anchor: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, base, runs): one run of each token by ranges of its hash, the others, known to be shared, dealt to negative parts."""
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    many = ~np.concatenate([new[1:], [True]])[new] if len(h) else new
    # mixed, as anchors have the least of many hashes
    part = ((tb.mix(h[order] + tb.BASE) >> tb.U64(32)) * tb.U64(parts) >> tb.U64(32)).astype(np.int64)
    n_known = int((~new).sum())
    packets = min(parts, 1 + n_known // KNOWN)
    part[~new] = -1 - (np.arange(n_known) * packets // max(1, n_known) + int(h[0] % tb.U64(parts))) % parts
    flag = np.ones(len(h), np.uint8)
    flag[new] = many
    group = np.lexsort((doc[order], part))
    order, part, flag = order[group], part[group], flag[group]
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for a, b in zip(edges, edges[1:], strict=False):
        while a < b:  # ids further apart than 32 bits go on with another base
            low = doc[order[a]]
            above = doc[order[a:b]].astype(tb.U64) - low.astype(tb.U64)
            some = order[a : a + int(np.searchsorted(above, tb.U64(1 << 32)))]
            out = np.empty(len(some), RUN)
            for name, values in (("h", h), ("tie", tie), ("at", at), ("n", n), ("anchor", anchor)):
                out[name] = values[some]
            out["doc"], out["many"] = above[: len(some)], flag[a : a + len(some)]
            yield int(part[a]), int(low), out.tobytes()
            a += len(some)


def first_pass(docs: DataFrame, parts: int, seed: int) -> DataFrame:
    """Packets of the runs of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = tb.Hasher(seed), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size:
                rows = list(packed(*map(np.concatenate, zip(*held, strict=True)), parts))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "base", "runs"])
            held, size = [], 0

        for batch in tb.slices(batches, "text"):
            h, text, at, n, anchor = runs_of(*tb.text_bytes(batch.column("text")), hasher)
            held.append((h, np.asarray(batch.column("doc"))[text], np.asarray(batch.column("tie"))[text], at, n, anchor))
            size += len(h)
            if size >= HELD:
                yield from flush()
        yield from flush()

    return docs.select("doc", "tie", "text").mapInArrow(tb.tidy(run), PACKETS)


def shared_runs(packets: DataFrame) -> DataFrame:
    """(doc, tie, at, n, anchor) of the runs whose token occurs in another place as well."""

    def met(part: int, bases: list[int], runs: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(runs), RUN)
        doc = rows["doc"].astype(np.int64) + np.repeat(np.array(bases, np.int64), [len(r) // RUN.itemsize for r in runs])
        keep = rows["many"] > 0
        if part >= 0:
            order = np.argsort(rows["h"], kind="stable")
            same = rows["h"][order[1:]] == rows["h"][order[:-1]]
            keep[order[1:][same]] = True
            keep[order[:-1][same]] = True
        columns = [pa.array(doc[keep]), pa.array(rows["tie"][keep]), *(pa.array(rows[c][keep].astype(np.int32)) for c in ("at", "n", "anchor"))]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "tie", "at", "n", "anchor"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bases, runs = None, [], []
        for batch in batches:
            for p, base, some in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "runs")), strict=True):
                if p != part:
                    if runs:
                        yield met(part, bases, runs)
                    part, bases, runs = p, [], []
                bases.append(base)
                runs.append(some)
                if p < 0:  # known ones meet nobody
                    yield met(part, bases, runs)
                    bases, runs = [], []
        if runs:
            yield met(part, bases, runs)

    n = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packets.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part").mapInArrow(tb.tidy(run), SHARED)


def spans_array(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte spans as a column."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data[place].tobytes())])


def suffixes_of(marked: DataFrame, seed: int) -> DataFrame:
    """The suffixes at the anchors of shared runs, with their run's bytes.

    Of equal runs that a task gathers the first one remains; the others are
    ``decided``, and only lead their first bytes to be dealt by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = tb.Hasher(seed), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size:
                data, doc, tie, at, n, anchor = map(np.concatenate, zip(*held, strict=True))
                length = n - 1 + LENGTH
                begin = np.cumsum(length) - length
                number = tb.numbered(data, begin, begin + length, hasher)
                order = np.lexsort((at, tie, doc, number))
                head = np.maximum.accumulate(np.where(np.concatenate([[True], number[order[1:]] != number[order[:-1]]]), np.arange(len(order)), 0))
                first = order[head]
                again = np.zeros(len(order), bool)
                again[order] = (doc[order] != doc[first]) | (tie[order] != tie[first]) | (at[order] != at[first])
                spans = spans_array(data, np.where(again, begin + anchor, begin), np.where(again, 8, length))
                yield pa.RecordBatch.from_arrays([pa.array(again), pa.array(doc), pa.array(tie), *(pa.array(x.astype(np.int32)) for x in (at, n, np.where(again, 0, anchor))), spans], names=["decided", "doc", "tie", "at", "n", "anchor", "span"])
            held, size = [], 0

        for batch in tb.slices(batches, "text"):
            data, offsets = tb.text_bytes(batch.column("text"))
            marks = batch.column("marks")
            of = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(marks)).astype(np.int64))
            at, n, anchor = (np.asarray(c).astype(np.int64) for c in marks.flatten().flatten())
            for lo in range(0, len(of), GATHERED // (2 * LENGTH)):
                some = slice(lo, lo + GATHERED // (2 * LENGTH))
                length = n[some] - 1 + LENGTH
                ends = np.cumsum(length)
                place = np.arange(ends[-1]) + np.repeat(offsets[of[some]] + at[some] - ends + length, length)
                held.append((data[place], np.asarray(batch.column("doc"))[of[some]], np.asarray(batch.column("tie"))[of[some]], at[some], n[some], anchor[some]))
                size += int(ends[-1])
                if size >= GATHERED:
                    yield from flush()
        yield from flush()

    # in order, so that a task that runs again gathers the same
    return marked.select("doc", "tie", "text", "marks").sortWithinPartitions("doc", "tie").mapInArrow(tb.tidy(run), SUFFIXES)


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of eight-byte words) that have equals, in an order in which equals are on end, and the number of each one's group.

    All rows are divided by their first word, and those that still have company by the next.
    """
    order, group = np.arange(len(words)), np.zeros(len(words), np.int64)
    for column in words.T:
        word = column[order]
        sort = np.lexsort((word, group))
        order, group, word = order[sort], group[sort], word[sort]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])])[: len(order)]
        group = np.cumsum(new) - 1
        company = np.bincount(group)[group] > 1 if len(group) else new
        order, group = order[company], group[company]
    return order, group


def _in_common(suffixes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix (rows of bytes) and the one before it; LENGTH for the first."""
    out = np.full(len(sizes), LENGTH)
    differ = suffixes[1:] != suffixes[:-1]
    out[1:] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def repeats_in(rows: pa.Table, first: bool, last: bool) -> Iterator[tuple]:
    """(doc, tie, at, n, string) of the repeats among sorted suffixes; with a string, undecided ones.

    ``first`` and ``last`` tell that suffixes before or behind these may have the token of
    the first or last one.
    """
    doc, tie, at, n, anchor = (np.asarray(rows.column(c)).astype(np.int64) for c in ("doc", "tie", "at", "n", "anchor"))
    data, begin = tb_bytes(rows.column("span"))
    size = n - 1 + LENGTH
    # equal runs are neighbours, the first one in front
    same = np.concatenate([[False], (size[1:] == size[:-1]) & (anchor[1:] == anchor[:-1])])
    pairs = np.flatnonzero(same)
    same[pairs] = tb.same_bytes(data, begin[pairs], begin[pairs - 1], size[pairs])
    head = np.maximum.accumulate(np.where(~same, np.arange(len(same)), 0))
    again = (doc != doc[head]) | (tie != tie[head]) | (at != at[head])
    yield doc[again], tie[again], at[again], n[again], None
    keep = np.flatnonzero(~same)
    doc, tie, at, anchor, begin, size = (x[keep] for x in (doc, tie, at, anchor, begin, size))
    tail = size - anchor
    strings_at = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(LENGTH, np.uint8)]), LENGTH)
    matrix = np.where(np.arange(LENGTH) < tail[:, None], strings_at[begin + anchor], np.uint8(0))
    before = _in_common(matrix, tail)
    if not first:
        before[0] = 0
    common = np.maximum(before, np.append(before[1:], LENGTH if last else 0))
    # a string that starts j bytes into the run reaches j + LENGTH - anchor bytes into the suffix
    strings = np.clip(np.minimum(common - LENGTH + anchor, size - LENGTH) + 1, 0, None)
    gram = matrix[:, :GRAM]
    token = np.concatenate([[0], np.cumsum((gram[1:] != gram[:-1]).any(1))])
    undecided = ((token == 0) & first) | ((token == token[-1]) & last)
    ends, lo = np.cumsum(strings), 0
    while lo < len(keep):  # whole tokens, as long as there is room
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STRINGS, "right")))
        split = np.zeros(len(keep), bool)
        if hi < len(keep) and token[hi] == token[hi - 1]:
            whole = int(np.searchsorted(token, token[hi]))
            hi, split[:] = (whole, False) if whole > lo else (hi, token == token[hi])
            if whole <= lo:
                undecided |= split
        row = np.repeat(np.arange(lo, hi), strings[lo:hi])
        step = np.arange(len(row)) - np.repeat(np.cumsum(strings[lo:hi]) - strings[lo:hi], strings[lo:hi])
        if len(row):
            bytes_of = strings_at[begin[row] + step]
            words = np.zeros((len(row), -(-LENGTH // 8) * 8), np.uint8)
            words[:, :LENGTH] = bytes_of
            order, group = multikey_quicksort(words.view(">u8").astype(np.uint64))
            place = (doc[row], tie[row], at[row] + step)
            order = order[np.lexsort((place[2][order], place[1][order], place[0][order], group))]
            head = np.concatenate([[True], group[1:] != group[:-1]])[: len(order)]
            lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
            later = np.any([p[order] != p[lead] for p in place], axis=0)
            gone = order[later]
            yield *(p[gone] for p in place), np.ones(len(gone), np.int64), None
            open_ = undecided[row]
            open_[order[~head]] = False
            rest = np.flatnonzero(open_)
            if len(rest):
                yield *(p[rest] for p in place), np.ones(len(rest), np.int64), bytes_of[rest]
        lo = hi


def tb_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of binaries, and where each begins."""
    column = column.combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1])), offsets[:-1]


def _marks(found: tuple) -> pa.RecordBatch:
    doc, tie, at, n, strings = found
    column = pa.nulls(len(doc), pa.binary()) if strings is None else spans_array(strings.ravel(), np.arange(len(doc)) * LENGTH, np.full(len(doc), LENGTH))
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), column], names=["doc", "tie", "at", "n", "string"])


def bucket_marks(suffixes: DataFrame) -> DataFrame:
    """The repeats that buckets of sorted suffixes show, and strings that are undecided at their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first = True  # the rows before may have the first one's token: those of another bucket, or ones that were sorted by themselves

        def token(table: pa.Table, k: int) -> bytes:
            span, anchor = table.column("span")[k].as_py(), table.column("anchor")[k].as_py()
            return span[anchor : anchor + GRAM]

        for batch in batches:
            decided = batch.filter(batch.column("decided"))
            if decided.num_rows:
                yield _marks((*(np.asarray(decided.column(c)).astype(np.int64) for c in ("doc", "tie", "at", "n")), None))
            held.append(batch.filter(pc.invert(batch.column("decided"))))
            if sum(b.num_rows for b in held) > SORTED:
                rows = pa.Table.from_batches(held)
                last, lo, hi = token(rows, rows.num_rows - 1), 0, rows.num_rows - 1
                while lo < hi:  # the first row of the last token
                    middle = (lo + hi) // 2
                    lo, hi = (lo, middle) if token(rows, middle) == last else (middle + 1, hi)
                whole = lo > 0
                end = lo or rows.num_rows  # one token fills it all
                yield from map(_marks, repeats_in(rows.slice(0, end), first, not whole))
                held, first = rows.slice(end).to_batches(), not whole
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield from map(_marks, repeats_in(rows, first, True))

    suffix = F.expr("substring(span, anchor + 1)")
    count = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [suffix, F.col("span"), F.col("doc"), F.col("tie"), F.col("at")]
    return suffixes.repartitionByRange(count, *order).sortWithinPartitions(*order).mapInArrow(tb.tidy(run), MARKS)


def boundary_marks(undecided: DataFrame) -> DataFrame:
    """(doc, tie, at, n): all but the first of equal strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            keep = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("string", "doc", "tie", "at")), strict=True):
                if lead is None or row[0] != lead[0]:
                    lead = row
                keep.append(row != lead)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["doc", "tie", "at", "n"])

    order = ["string", "doc", "tie", "at"]
    count = int(undecided.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = undecided.repartitionByRange(count, "string").sortWithinPartitions(*order)
    return sorted_.mapInArrow(tb.tidy(run), "doc bigint, tie bigint, at int, n int")


def _numbered(packed: DataFrame) -> DataFrame:
    """``packed`` with ``doc``, a bigint in the order of ``id``, the least one for null."""
    if packed.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return packed.withColumn("doc", F.coalesce(F.col("id").cast("bigint"), F.lit(NO_ID)))
    order = cut(packed.select(F.col("id").alias("of")).where("of is not null").distinct().sort("of").withColumn("doc", F.monotonically_increasing_id()))
    return packed.join(order, F.col("id") == F.col("of"), "left").drop("of").withColumn("doc", F.coalesce("doc", F.lit(NO_ID)))


def cleaned(text: pa.Array, runs: pa.Array) -> list[pa.Array]:
    """Of each text its bytes, removed bytes, maximal removed runs and the remaining bytes."""
    data, offsets = tb.text_bytes(text)
    of = np.repeat(np.arange(len(text)), np.asarray(pc.fill_null(pc.list_value_length(runs), 0)).astype(np.int64))
    at, n = (np.asarray(c).astype(np.int64) for c in runs.flatten().flatten())
    gone = tb.covered(offsets[of] + at, n - 1 + LENGTH, len(data))
    spans = np.diff(tb.spans_of(gone, offsets)[2])
    bounds = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    kept = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[~gone])])
    return [pa.array(np.diff(offsets)), pa.array(tb.per_text(gone, offsets)), pa.array(spans), kept]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the remaining bytes.

    A task of the culling holds one of ``parts`` ranges of hashes, about a byte in all for
    each byte of text; by default there are four for each of spark.sql.shuffle.partitions.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seed, key = tb.draw(), F.xxhash64("doc", "tie")
    carried = Carried(docs, RESULTS, text)
    own = _numbered(carried.pack(docs, id=quoted(doc_id), tie=F.xxhash64(quoted(text), F.lit(3)))).drop("id").withColumn("key", key)
    texts = own.select("doc", "tie", F.coalesce("text", F.lit("")).alias("text"), "key")

    shared = cut(shared_runs(first_pass(texts, parts, seed)).groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "n", "anchor")).alias("marks")).withColumn("key", key))
    thinned = bloom.tested(texts, shared.select("key"), "key", "hit").where("hit").drop("key", "hit")
    marked = thinned.join(shared.drop("key"), ["doc", "tie"]).dropDuplicates(["doc", "tie"])
    marks = cut(bucket_marks(suffixes_of(marked, seed)))
    found = marks.where("string is null").drop("string").unionByName(boundary_marks(marks.where("string is not null")))
    spans = cut(found.groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "n")).alias("runs")).withColumn("key", key))

    split = bloom.tested(own, spans.select("key"), "key", "hit")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    whole_texts = split.where("not hit").select("row", "text", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            yield carried.batch(batch, cleaned(batch.column("text"), batch.column("runs")))

    rest = carried.map(split.where("hit").join(spans.drop("key"), ["doc", "tie"], "left").select("row", "text", "runs"), run)
    return carried.unpack(whole_texts.unionByName(rest))
