"""Removal of long repeated passages of words, found by recompression.

A window is ``WINDOW`` consecutive words of one document.  Every word that is covered by a window
whose words also start anywhere else goes, at all of its places; windows are judged on the input.

Recompression names strings by rounds.  A round replaces each maximal run of one symbol by a
name for (symbol, length), then each pair of a left and a right symbol by a name for the pair;
a symbol's side follows from its name.  Names are keyed digests of words and mixes of names, drawn
for each job, so that equal runs and pairs have one name in all tasks without a dictionary.  What
stands beside a string can change no more than the symbols at its edges (``interior``), so
equal windows have equal interiors.  The symbol of least mixed name in the interior of the last round
(``ROUNDS``, or the last that leaves a window any) is its anchor; neighbouring windows mostly share one.

1. All documents: runs of windows with one anchor, known by the name of the anchor with the words
   that every such window has around it, and by a hash of all words of the run.
2. Spark brings equal anchors of all documents together.  Those that occur once end here.  If all
   runs of an anchor have the same words, all their windows are repeats.
3. The others, runs at the edges of repeated passages, are looked at window by window: Spark
   brings equal names of single windows together, two hashes of all their words.

A task sends one run of each anchor that it gathers, and one of each window: what it holds several
times is a repeat already, and runs of an anchor that differ in one task are known to do so.  So a passage
that very many documents have in common makes one row for each ``HELD`` runs at most.  Windows are
told apart by 122 bits and runs of one anchor by 61, over digests of 128 bits of each word, all drawn
at random for each job.

Null texts have no words.  Every row is a document: rows of one id and text are copies of one
another, and so are repeated parts of one text.  Ids may have any type that can be hashed.  Columns named like a
result are replaced; others are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm import textbytes as tb
from tessera.llm.shared import Carried, cut, quoted

WINDOW = 35
#: Rounds of naming.  More leave fewer symbols of a window to choose from, and so more anchors.
ROUNDS = 3
#: Runs or windows that a task gathers before it hands them on.
HELD = 200_000
#: Flags of a row: its windows are repeats; they are to be looked at singly; it meets its like; its like differ.
MARK, EDGE, SENT, MIXED = 1, 2, 4, 8
#: ``a`` is what equal rows share, ``w`` tells them apart; ``p`` packs first window, windows and flags.
RUNS = "a bigint, w bigint, k1 bigint, k2 bigint, p bigint"
#: Bits of a place in ``least``; the rest of 64 bits are of a name.
PLACE = 30
RESULTS = "n_words bigint, n_removed bigint, kept string"


class Words:
    """Names of words, and hashes of spans of words."""

    def __init__(self, seed: int) -> None:
        self.seed, self.key = seed, seed.to_bytes(8, "little")
        self.hasher = tb.Hasher(seed)
        self.pair = tb.Hasher(seed + 1), tb.Hasher(seed + 2)

    def read(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A name of each word of the texts, and where each text's words begin; spans can be hashed until the next call."""
        data, offsets = tb.text_bytes(text)
        starts, ends, words = tb.spans_of(~tb.ASCII_SPACE[data], offsets)
        numbers = tb.numbered(data, starts, ends, self.hasher)
        one = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
        one[numbers] = np.arange(len(numbers))
        raw = data.tobytes()
        digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16, key=self.key).digest() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
        names = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        for k, hasher in enumerate(self.pair):
            hasher.values = names[:, k] % tb.PRIME
        self.sums = [hasher.sums(numbers) for hasher in self.pair]
        return names[:, 0][numbers], words

    def spans(self, k: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of words, by the first or second function."""
        return self.pair[k].spans(self.sums[k], starts, ends)


def named(*parts: np.ndarray) -> np.ndarray:
    """A name of each row of symbols."""
    out = np.zeros(len(parts[0]), tb.U64)
    for part in parts:
        out = tb.mix(out * tb.BASE + part.astype(tb.U64))
    return out


def least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the least of ``values[lo:hi]`` is, the first of equals, for each (lo, hi)."""
    low = tb.U64((1 << PLACE) - 1)
    table = [(values & ~low) | np.arange(len(values), dtype=tb.U64)]
    log = np.frexp(hi - lo)[1] - 1
    out = np.zeros(len(lo), np.int64)
    for k in range(int(log.max(initial=-1)) + 1):
        some = np.flatnonzero(log == k)
        out[some] = (np.minimum(table[k][lo[some]], table[k][hi[some] - (1 << k)]) & low).astype(np.int64)
        table.append(np.minimum(table[k][: -(1 << k)], table[k][1 << k :]))
    return out


def interior(symbols: np.ndarray, offsets: np.ndarray, starts: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows at ``starts``: their round, and first and last word (exclusive).

    Round 0 is a window that no round leaves a symbol: its anchor is the window itself.  In later
    rounds each side of a window has at least as many words outside its interior as there were rounds.
    """
    n = len(symbols)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    place, live = np.arange(n), np.arange(len(starts))
    lo, hi = starts.copy(), starts + width
    level, at, end = np.zeros(len(starts), np.int64), lo.copy(), hi.copy()

    def upto(place: np.ndarray) -> np.ndarray:
        begins = np.zeros(n + 1, np.int64)
        begins[place] = 1
        return np.cumsum(begins)

    for step in range(1, rounds + 1):
        # runs; whatever stands before a window may lengthen its first one, so that one is left out
        new = np.ones(len(place), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | first[place[1:]]
        head = np.flatnonzero(new)
        times = np.diff(np.append(head, len(place)))
        symbols, place = symbols[head], place[head]
        several = np.flatnonzero(times > 1)
        symbols[several] = named(symbols[several], times[several], np.full(len(several), 2 * step))
        before, after = upto(place), np.append(place, n)
        lo, hi = after[before[lo]], place[before[hi - 1] - 1]
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
        # pairs; a right symbol in front may belong to a left one outside, a left one at the end to a right one
        left = tb.mix(symbols + tb.U64(step)) >> tb.U64(63) == 1
        joined = np.zeros(len(place), bool)
        joined[1:] = left[:-1] & ~left[1:] & ~first[place[1:]]
        front, back = before[lo] - 1, before[hi - 1] - 1
        lo, hi = np.where(left[front], lo, after[front + 1]), np.where(left[back], place[back], hi)
        second = np.flatnonzero(joined)
        symbols[second - 1] = named(symbols[second - 1], symbols[second], np.full(len(second), 2 * step + 1))
        symbols, place = symbols[~joined], place[~joined]
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
        if not len(live):
            break
        before = upto(place)
        chosen = least(tb.mix(symbols ^ tb.BASE), before[lo] - 1, before[hi - 1])
        level[live], at[live], end[live] = step, place[chosen], np.append(place, n)[chosen + 1]
    return level, at, end


def runs_of(text: pa.Array, words: Words) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor's name, hash of the run's words, text, first window's place, windows)."""
    symbols, offsets = words.read(text)
    starts = tb.windows(offsets, WINDOW)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(tb.U64), none.astype(tb.U64), none, none, none
    level, at, end = interior(symbols, offsets, starts, WINDOW)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (level[1:] != level[:-1]) | (starts[1:] != starts[:-1] + 1)])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(starts)))
    level, at, end, lo = level[head], at[head], end[head], starts[head]
    anchor = named(words.spans(0, at - level, end + level), level)
    whole = named(words.spans(1, lo, lo + n - 1 + WINDOW), at - lo, n)
    text_of = np.searchsorted(offsets, lo, "right") - 1
    return anchor, whole, text_of, lo - offsets[text_of], n


def gathered(parts: list[tuple[np.ndarray, ...]], windows: bool) -> pa.RecordBatch:
    """Rows of (a, w, k1, k2, at, n): flagged by what those of one ``a`` say of one another.

    ``windows`` are alike only if they have one ``a`` and one ``w``.
    """
    a, w, k1, k2, at, n = map(np.concatenate, zip(*parts, strict=True))
    order = np.lexsort((w, a))
    a, w, k1, k2, at, n = (x[order] for x in (a, w, k1, k2, at, n))
    lead = np.ones(len(a), bool)
    lead[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    head = np.ones(len(a), bool)
    head[1:] = lead[1:] if windows else a[1:] != a[:-1]
    kind, group = np.cumsum(lead) - 1, np.cumsum(head) - 1
    mixed = (np.bincount(group[lead], minlength=1) > 1)[group]
    flags = np.where(np.bincount(kind, minlength=1)[kind] > 1, MARK, 0) + np.where(head, SENT, 0) + np.where(head & mixed, MIXED, 0) + np.where(lead & mixed, EDGE, 0)
    a = np.where(head, a, named(w, k1, at))  # rows that meet nobody are dealt evenly
    columns = [a.view(np.int64), w.view(np.int64), k1, k2, (at << 12) | (n << 4) | flags]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "w", "k1", "k2", "p"])


def _gather(batches: Iterator[pa.RecordBatch], found, windows: bool) -> Iterator[pa.RecordBatch]:
    """``gathered`` rows of what ``found`` gives for each slice of texts."""
    held, size = [], 0
    for batch in tb.slices(batches, "text"):
        *names, text, at, n = found(batch)
        held.append((*names, np.asarray(batch.column("k1"))[text], np.asarray(batch.column("k2"))[text], at, n))
        size += len(at)
        if size >= HELD:
            yield gathered(held, windows)
            held, size = [], 0
    if size:
        yield gathered(held, windows)


def runs(texts: DataFrame, seed: int) -> DataFrame:
    """The runs of windows of all texts (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(seed)
        yield from _gather(batches, lambda batch: runs_of(batch.column("text"), words), False)

    return texts.mapInArrow(tb.tidy(run), RUNS)


def single_windows(marked: DataFrame, seed: int) -> DataFrame:
    """The windows of the runs ``marks`` of each text, as runs of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(seed)

        def found(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            _, offsets = words.read(batch.column("text"))
            marks = batch.column("marks")
            text = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(marks)).astype(np.int64))
            at, n = (np.asarray(c).astype(np.int64) for c in marks.flatten().flatten())
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            text, at = np.repeat(text, n), np.repeat(at, n) + step
            starts = offsets[text] + at
            return *(words.spans(k, starts, starts + WINDOW) for k in (0, 1)), text, at, np.ones(len(at), np.int64)

        yield from _gather(batches, found, True)

    return marked.select("k1", "k2", "text", "marks").mapInArrow(tb.tidy(run), RUNS)


def met(rows: DataFrame, *by: str) -> DataFrame:
    """(k1, k2, at, n, mark, edge) of the rows that are repeats, or have their like but not their equals."""
    like = Window.partitionBy(*by)
    flag = lambda bit: F.col("p").bitwiseAND(bit) > 0
    seen = rows.withColumns({"c": F.count("*").over(like), "mixed": F.max(flag(MIXED)).over(like) | (F.min("w").over(like) != F.max("w").over(like))})
    shared = flag(SENT) & (F.col("c") > 1)
    at, n = F.shiftright("p", 12).cast("int"), F.shiftright("p", 4).bitwiseAND(255).cast("int")
    seen = seen.select("k1", "k2", at.alias("at"), n.alias("n"), (flag(MARK) | (shared & ~F.col("mixed"))).alias("mark"), (flag(EDGE) | (shared & F.col("mixed"))).alias("edge"))
    return seen.where("mark or edge")


def repeats(texts: DataFrame, seed: int) -> DataFrame:
    """(k1, k2, at, n): runs of windows that are repeats, ``n`` from the word ``at`` on, of texts (k1, k2, text)."""
    place = ["k1", "k2", "at", "n"]
    found = cut(met(runs(texts, seed), "a"))
    edges = cut(found.where("edge").groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n")).alias("marks")))
    some = bloom.tested(texts, edges.select("k1"), "k1", "hit").where("hit").select("k1", "k2", "text")
    windows = met(single_windows(some.join(edges, ["k1", "k2"]), seed), "a", "w")
    return found.where("mark").select(place).unionByName(windows.where("mark").select(place))


def cleaned(text: pa.Array, marks: pa.Array) -> list[pa.Array]:
    """Of each text its words, removed words, and the remaining ones with a space between them."""
    data, offsets = tb.text_bytes(text)
    starts, ends, words = tb.spans_of(~tb.ASCII_SPACE[data], offsets)
    of = np.repeat(np.arange(len(text)), np.asarray(pc.fill_null(pc.list_value_length(marks), 0)).astype(np.int64))
    at, n = (np.asarray(c).astype(np.int64) for c in marks.flatten().flatten())
    gone = tb.covered(words[of] + at, n - 1 + WINDOW, len(starts))
    kept = np.flatnonzero(~gone)
    # a kept word's bytes, and what follows it if another one does
    last = np.append(np.searchsorted(words, kept[1:], "right") != np.searchsorted(words, kept[:-1], "right"), True)[: len(kept)]
    spaced = kept[~last]
    out = np.append(data, np.uint8(0x20))
    out[ends[spaced]] = 0x20
    size = len(data) + 2
    depth = np.bincount(starts[kept], minlength=size) - np.bincount(ends[kept] + ~last, minlength=size)
    taken = np.cumsum(depth)[: len(data) + 1] > 0
    bounds = np.concatenate([[0], np.cumsum(taken)])[offsets]
    column = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out[taken])])
    return [pa.array(np.diff(words)), pa.array(tb.per_text(gone, words)), column]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the remaining words with one space between them."""
    seed, carried = tb.draw(), Carried(docs, RESULTS, text)
    of = [quoted(doc_id), quoted(text)]
    own = carried.pack(docs, k1=F.xxhash64(F.lit(1), *of, of[0].isNull()), k2=F.xxhash64(F.lit(2), *reversed(of), of[0].isNull()))
    found = repeats(own.select("k1", "k2", "text"), seed)
    marks = cut(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n")).alias("marks")))
    split = bloom.tested(own, marks.select("k1"), "k1", "hit")
    none = F.lit(None).cast("array<struct<at:int,n:int>>").alias("marks")
    hit = split.where("hit").join(marks, ["k1", "k2"], "left").select("row", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            yield carried.batch(batch, cleaned(batch.column("text"), batch.column("marks")))

    return carried.unpack(carried.map(split.where("not hit").select("row", "text", none).unionByName(hit), run))
