"""Line deduplication by winnowing.

A repeated run is a run of consecutive lines, of ``min_words`` words or more, whose
lines all occur in a row earlier as well: in a document with a smaller (id, text hash),
or higher up in the same document.  All lines of repeated runs are deleted; the
first occurrence stays.

Windows are the shortest runs of lines with ``min_words`` words, one for each line
they can begin or end at.  A window selects its least line hash (the last of
equals) as fingerprint, so that equal runs are sure to share one.  Fingerprints that
occur once end there.  A position of another one is joined with the fingerprint's
first position, and the match extended line by line both ways, as far as windows that selected it
reach.  A match of ``min_words`` words or more is a repeated run, and settles all windows inside.

One line may stand in different surroundings, so windows of a position that its match
doesn't settle remain.  Equal windows remain together, as they match the first position alike;
they are grouped by two hashes of all their lines, and all but the first of a group are
repeats.  So no pairs of positions are made.  Lines and windows are told apart by two independent
hashes, 122 bits.  Repeats that touch are one run.

A line counts without the ASCII white space around it; lines without words are
skipped, and deleted when inside a repeated run (one between two lines of ``min_words`` words
or more is between two runs, and stays).  Null texts stay null.  Rows of
one id and text are one document at one place: neither is a repeat of the other.
Null ids come first.  ``n_lines`` and ``n_removed`` replace columns of those names;
others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm import textbytes as tb
from tessera.llm.shared import Carried, cut, field, quoted

MIN_WORDS = 20


def lines_of(text: pa.Array, hashers: list[tb.Hasher]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Lines with words: hashes, words and number (all lines count) of each, and where each text's begin."""
    data, offsets = tb.text_bytes(text)
    starts, ends, _ = tb.spans_of(~tb.ASCII_SPACE[data], offsets)
    breaks = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    stops = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    of = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
    number = np.arange(len(of)) - np.searchsorted(of, of)
    lo, hi = np.searchsorted(starts, begins), np.searchsorted(starts, stops)
    full = hi > lo
    lo, hi = lo[full], hi[full]
    hashes = [h.spans(h.sums(data), starts[lo], ends[hi - 1]) for h in hashers]
    return hashes, hi - lo, number[full], np.searchsorted(of[full], np.arange(len(offsets)))


def windows(hashes: list[np.ndarray], words: np.ndarray, lines: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """First and last line of each window, its fingerprint's line, and its hashes."""
    n, sums = len(words), np.concatenate([[0], np.cumsum(words)])
    owner, at = tb.owners(lines), np.arange(n)
    last = np.searchsorted(sums, sums[:-1] + min_words) - 1
    first = np.searchsorted(sums, sums[1:] - min_words, "right") - 1
    down, up = last < lines[owner + 1], first >= lines[owner]
    pairs = np.unique(np.concatenate([at[down] * n + last[down], first[up] * n + at[up]]))
    first, last = (pairs // n, pairs % n) if n else (pairs, pairs)
    chosen, least, whole = first.copy(), hashes[0][first], [tb.mix(h[first]) for h in hashes]
    open_ = np.arange(len(first))
    step = 0
    while len(open_ := open_[first[open_] + step < last[open_]]):
        step += 1
        here = first[open_] + step
        for w, h in zip(whole, hashes, strict=True):
            w[open_] = tb.mix(w[open_] * tb.BASE + h[here])
        lower = hashes[0][here] <= least[open_]
        chosen[open_[lower]], least[open_[lower]] = here[lower], hashes[0][here[lower]]
    return first, last, chosen, whole


def fingerprints(docs: DataFrame, min_words: int, seed: int) -> DataFrame:
    """The fingerprint of each selected line of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [tb.Hasher(seed)]
        for batch in tb.slices(batches, "text"):
            hashes, words, _, lines = lines_of(batch.column("text"), hashers)
            chosen = windows(hashes, words, lines, min_words)[2]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[0][np.unique(chosen)].view(np.int64))], names=["fingerprint"])

    return docs.select("text").mapInArrow(tb.tidy(run), "fingerprint bigint")


LINE = pa.struct([("hash", pa.int64()), ("more", pa.int64()), ("words", pa.int32()), ("number", pa.int32())])


def positions(docs: DataFrame, min_words: int, seed: int) -> DataFrame:
    """(fingerprint, doc_id, key, line, at, lines) of (doc_id, key, text): selected lines, each as number ``at`` of the lines that its windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [tb.Hasher(seed), tb.Hasher(seed + 1)]
        for batch in tb.slices(batches, "text"):
            hashes, words, number, lines = lines_of(batch.column("text"), hashers)
            first, last, chosen, _ = windows(hashes[:1], words, lines, min_words)
            order = np.argsort(chosen, kind="stable")
            line, start = np.unique(chosen[order], return_index=True)
            low, high = (f.reduceat(x[order], start) if len(start) else line for f, x in ((np.minimum, first), (np.maximum, last)))
            size = high - low + 1
            offsets = np.concatenate([[0], np.cumsum(size)])
            reached = np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])
            parts = [*(pa.array(h[reached].view(np.int64)) for h in hashes), *(pa.array(x[reached].astype(np.int32)) for x in (words, number))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(LINE)))
            owner = pa.array(np.searchsorted(lines, line, "right") - 1)
            places = [pa.array(hashes[0][line].view(np.int64)), batch.column("doc_id").take(owner), batch.column("key").take(owner), pa.array(number[line].astype(np.int32)), pa.array((line - low).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*places, lists], names=["fingerprint", "doc_id", "key", "line", "at", "lines"])

    rest = StructType.fromDDL("fingerprint bigint, key bigint, line int, at int, lines array<struct<hash: bigint, more: bigint, words: int, number: int>>").fields
    return docs.select("doc_id", "key", "text").mapInArrow(tb.tidy(run), StructType([rest[0], field(docs, "doc_id", "doc_id"), *rest[1:]]))


class Surroundings:
    """The lines around a batch of positions: all on end, where each position's begin, and the positions themselves."""

    def __init__(self, lines: pa.ListArray, at: pa.Array) -> None:
        flat = lines.flatten()
        self.hashes = [np.asarray(flat.field(i)).view(tb.U64) for i in (0, 1)]
        self.words, self.number = (np.asarray(flat.field(i)).astype(np.int64) for i in (2, 3))
        self.offsets = np.concatenate([[0], np.cumsum(np.asarray(lines.value_lengths(), np.int64))])
        self.at = self.offsets[:-1] + np.asarray(at)

    def equal(self, here: np.ndarray, other: Surroundings, there: np.ndarray) -> np.ndarray:
        return np.logical_and(*(a[here] == b[there] for a, b in zip(self.hashes, other.hashes, strict=True)))

    def extended(self, other: Surroundings, step: int) -> np.ndarray:
        """How many lines beyond each position, in the direction of ``step``, equal those beyond the other's."""
        count = np.zeros(len(self.at), np.int64)
        going = np.arange(len(self.at))
        while len(going):
            here, there = (s.at[going] + step * (count[going] + 1) for s in (self, other))
            inside = [(s.offsets[going] <= x) & (x < s.offsets[going + 1]) for s, x in ((self, here), (other, there))]
            inside = inside[0] & inside[1]
            going, here, there = going[inside], here[inside], there[inside]
            going = going[self.equal(here, other, there)]
            count[going] += 1
        return count


def matches(joined: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, first, last, hash, more) of positions (doc_id, key, at, lines) with another (later, other_at, other_lines).

    Repeated runs, without hashes, and the windows that no match settles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (Surroundings(batch.column(x + "lines"), batch.column(x + "at")) for x in ("", "other_"))
            begin, end = own.at - own.extended(other, -1), own.at + own.extended(other, 1)
            sums = np.concatenate([[0], np.cumsum(own.words)])
            matched = own.equal(own.at, other, other.at) & (sums[end + 1] - sums[begin] >= min_words)
            run_of = np.flatnonzero(matched & np.asarray(batch.column("later").to_numpy(zero_copy_only=False), bool))
            first, last, chosen, whole = windows(own.hashes, own.words, own.offsets, min_words)
            of = np.searchsorted(own.offsets, first, "right") - 1
            left = np.flatnonzero((chosen == own.at[of]) & ~(matched[of] & (begin[of] <= first) & (last <= end[of])))
            owner = pa.array(np.concatenate([run_of, of[left]]))
            spans = [pa.array(own.number[np.concatenate([x[run_of], y[left]])].astype(np.int32)) for x, y in ((begin, first), (end, last))]
            hashes = [pa.concat_arrays([pa.nulls(len(run_of), pa.int64()), pa.array(h[left].view(np.int64))]) for h in whole]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("key").take(owner), *spans, *hashes], names=["doc_id", "key", "first", "last", "hash", "more"])

    rest = StructType.fromDDL("key bigint, first int, last int, hash bigint, more bigint").fields
    return joined.mapInArrow(tb.tidy(run), StructType([field(joined, "doc_id", "doc_id"), *rest]))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, runs) of (doc_id, key, text): spans of lines of the later repeated runs of each document that has any."""
    seed = tb.draw()
    shared = cut(fingerprints(docs, min_words, seed).groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))
    places = cut(positions(docs, min_words, seed).join(shared, "fingerprint", "left_semi"))
    place = F.struct("doc_id", "key", "line")
    # written, so that the join reads two exchanges and a common fingerprint's partition can be split
    first = cut(places.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "key", "line", "at", "lines")).alias("other")), shared.count())
    later = place > F.struct("other.doc_id", "other.key", "other.line")
    joined = places.join(first, "fingerprint").select("doc_id", "key", "at", "lines", later.alias("later"), F.col("other.at").alias("other_at"), F.col("other.lines").alias("other_lines"))
    found = cut(matches(joined, min_words))
    left, position = found.where("hash IS NOT NULL"), F.struct("doc_id", "key", "first")
    earliest = cut(left.groupBy("hash", "more").agg(F.min(position).alias("earliest"), F.count("*").alias("n")).where("n > 1").select("hash", "more", "earliest"), found.count() // 2)
    again = left.join(earliest, ["hash", "more"]).where(position > F.col("earliest"))
    runs = found.where("hash IS NULL").select("doc_id", "key", "first", "last").unionByName(again.select("doc_id", "key", "first", "last"))
    return runs.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"))


def without(text: str, runs: list[dict[str, int]]) -> tuple[str, int]:
    """The text without the lines of the runs, and how many of those had words."""
    lines, drop = text.split("\n"), set()
    for run in runs:
        drop.update(range(run["first"], run["last"] + 1))
    gone = sum(1 for i in drop if lines[i].strip(" \t\n\x0b\x0c\r"))
    return "\n".join(line for i, line in enumerate(lines) if i not in drop), gone


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later repeated runs, with ``n_lines`` (with words, before) and ``n_removed``."""
    carried = Carried(docs, "n_lines bigint, n_removed bigint", text)
    packed = carried.pack(docs, doc_id=quoted(doc_id), key=F.xxhash64(quoted(text)))
    found = repeats(packed, min_words).withColumnsRenamed({"doc_id": "of", "key": "with"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            texts, gone, count = batch.column("text").to_pylist(), [], []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                count.append(sum(1 for line in (texts[i] or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")))
                texts[i], n = without(texts[i], runs) if runs else (texts[i], 0)
                gone.append(n)
            cut_texts = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))
            yield carried.batch(cut_texts, [pa.array(count, pa.int64()), pa.array(gone, pa.int64())])

    joined = packed.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("with")), "left").select("row", "text", "runs")
    return carried.unpack(carried.map(joined, run))
