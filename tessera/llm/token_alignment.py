"""Alignment of the tokens of two tokenizers, with corpus-wide counts of token pairs.

Tokenizer A is a byte-level BPE of the tokenizers library, which encodes a space and the
text; B is a sentencepiece model, which adds that space itself.  Both cut the same bytes.
Where both cut, a group ends; tokens whose byte ranges overlap are linked.

1. Each task encodes its texts and writes their alignments: a table of its different units into the
   folder that the cluster shares, and for each text the numbers of its units there.  It counts the
   pairs of a table as packed 64-bit keys (B's id above A's), by ``np.unique``.
2. Spark range-partitions the partial counts by B's id and sorts them; runs of equal keys are
   summed, and all pairs of a B id are in one range, so that its highest count is known.
   Each range is written as sorted shards, into the same folder.
3. A pass over what was written maps the shards into memory and looks the pairs of each table up by
   ``searchsorted``.  Pages are shared by all tasks of a machine, none holds all counts.

Both tokenizers cut before a single space between visible characters (``separable`` reads
that off their files), so a text is cut there, and each different unit is encoded and aligned
once in a task.  Other tokenizers get whole texts.

Texts that are null, empty, or not reproduced by A's or B's tokens byte by byte have no tokens.
Repeated rows count as often as they occur.  Columns named like a result are replaced;
others are carried along.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm import textbytes as tb
from tessera.llm.bpe import load
from tessera.llm.shared import Carried, cut, open_array, quoted, read_batch, shared_folder, write_array, write_batch

RESULTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
#: Bytes of units that are encoded at once.
CALL = 4096
#: Different units, and links of them, that a task remembers before it starts afresh, and pairs of a shard.
REMEMBERED, GATHERED, SHARD = 300_000, 1 << 20, 1 << 20
LOW32 = np.int64((1 << 32) - 1)
#: Lead bytes of characters that might be white space; they are treated as such.
MAYBE_SPACE = np.zeros(256, bool)
MAYBE_SPACE[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
SEPARATORS = (",", "|", ";")


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def bytes_of_a(tokenizer) -> list[bytes]:
    values, vocabulary = byte_values(), tokenizer.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
    return out


def bytes_of_b(processor) -> list[bytes]:
    ids = range(processor.get_piece_size())
    return [bytes([int(p[3:-1], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, processor.id_to_piece(i)) for i in ids)]


def separable(model_a: str, processor) -> bool:
    """Whether both tokenizers always cut before a single space between visible characters.

    A does if it splits text by the usual pattern, unchanged before; B if none of its pieces
    goes on behind a space that follows another character.
    """
    read = json.loads(model_a)
    first = read.get("pre_tokenizer") or {}
    plain = read.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return bool(plain and not any("▁" in p.lstrip("▁") for p in pieces))


def units_of(text: pa.Array, cuts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a space and each text, starts and ends of their units, and where each text's units begin.  Empty texts have none."""
    data, offsets = tb.text_bytes(text)
    full, bounds = np.insert(data, offsets[:-1], np.uint8(0x20)), offsets + np.arange(len(offsets))
    if not cuts or len(full) < 3:
        starts = bounds[:-1]
    else:
        head = np.maximum.accumulate(np.where((full & 0xC0) != 0x80, np.arange(len(full)), 0))
        visible = ~MAYBE_SPACE[full[head]]
        new = np.zeros(len(full), bool)
        new[1:-1] = (full[1:-1] == 0x20) & visible[:-2] & visible[2:]
        new[bounds[:-1]] = True
        starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(full))[: len(starts)]
    some = ends - starts > 1  # a text's only unit is a bare space where the text is empty
    some |= ~np.isin(starts, bounds[:-1])
    starts, ends = starts[some], ends[some]
    return full, starts, ends, np.searchsorted(starts, bounds)


class Aligner:
    """Alignments of units; remembers them by their bytes."""

    def __init__(self, model_a: str, model_b: bytes, seed: int) -> None:
        import sentencepiece

        self.a, self.b = load(model_a), sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.a.encode_special_tokens = True
        self.cuts = separable(model_a, self.b)
        self.hasher = tb.Hasher(seed)
        self.bytes = bytes_of_a(self.a), bytes_of_b(self.b)
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in self.bytes]
        self.table = None
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        none = np.zeros(0, np.int64)
        self.n_a = self.n_b = self.n_groups = self.starts = self.n_links = none
        self.ok, self.keys = np.zeros(0, bool), none
        self.groups: list[bytes] = []

    def full(self) -> bool:
        return len(self.known) > REMEMBERED or len(self.keys) > GATHERED

    def encoded(self, units: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """An order of the units, A's and B's ids in it, how many of each a unit has, and which units they reproduce."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(units), np.uint8)
        head = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
        visible = ~MAYBE_SPACE[data[head]]
        # between units that begin and end visibly both tokenizers cut, so many are encoded at once
        clean = visible[ends - sizes + 1] & visible[ends - 1] & self.cuts
        inner = np.flatnonzero(clean)
        calls = np.flatnonzero(np.diff(np.cumsum(sizes[inner]) // CALL)) + 1
        pieces = [x for x in np.split(inner, calls) if len(x)] + [np.array([i]) for i in np.flatnonzero(~clean).tolist()]
        order, ok, ids, counts = [], [], ([], []), ([], [])
        while pieces:
            again = []
            raws = [b"".join([units[i] for i in p.tolist()]) for p in pieces]
            texts = [r.decode() for r in raws]
            found = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)
            for piece, raw, *both in zip(pieces, raws, *found, strict=True):
                stops, n = np.cumsum(sizes[piece]), []
                if good := all(b"".join(map(table.__getitem__, x)) == raw for table, x in zip(self.bytes, both, strict=True)):
                    for size, x in zip(self.sizes, both, strict=True):
                        cuts = np.cumsum(size[x])
                        at = np.searchsorted(cuts, stops)
                        good &= bool((cuts[at] == stops).all())
                        n.append(np.diff(at, prepend=-1))
                if not good and len(piece) > 1:
                    again += [piece[i : i + 1] for i in range(len(piece))]
                    continue
                order.append(piece)
                ok.append(np.full(len(piece), good))
                for k in (0, 1):
                    ids[k].append(np.array(both[k] if good else [], np.int64))
                    counts[k].append(n[k] if good else np.zeros(1, np.int64))
            pieces = again
        return np.concatenate(order), [np.concatenate(x) for x in ids], [np.concatenate(x) for x in counts], np.concatenate(ok)

    def learn(self, units: list[bytes], strings: bool) -> None:
        """Encode and align new units."""
        order, (a, b), counts, ok = self.encoded(units)
        units = [units[i] for i in order.tolist()]
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        marks = np.zeros((2, int(ends_a[-1]) + 1 if len(ends_a) else 1), bool)
        marks[0, ends_a] = marks[1, ends_b] = True
        both = marks[0] & marks[1]
        # between two neighbouring cuts of either lies the overlap of one A and one B token
        places = np.flatnonzero(marks[0] | marks[1])
        of_a, of_b = (np.cumsum(m)[places] - m[places] for m in marks)
        owner = np.repeat(np.arange(len(units)), counts[0])
        n_links = np.bincount(owner[of_a], minlength=len(units))
        self.known.update(zip(units, range(len(self.ok), len(self.ok) + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.keys) + np.cumsum(n_links) - n_links])
        self.keys = np.concatenate([self.keys, (b[of_b] << 32) | a[of_a]])
        n_groups = np.bincount(owner[both[ends_a]], minlength=len(units))
        for name, values in (("ok", ok), ("n_a", counts[0]), ("n_b", counts[1]), ("n_groups", n_groups), ("n_links", n_links)):
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        if strings:
            self.groups += self.spelled(a, b, both, ends_a, ends_b, counts)

    def spelled(self, a: np.ndarray, b: np.ndarray, both: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, counts: list[np.ndarray]) -> list[bytes]:
        """Groups of each unit as ``a1,a2|b1;a3|b2,b3;``."""
        if self.table is None:
            n = max(map(len, self.bytes))
            self.table = np.array([f"{i}{s}".encode() for i in range(n) for s in SEPARATORS])
            self.table_size = np.char.str_len(self.table)
        before = np.cumsum(both)
        group_a, group_b = before[ends_a] - both[ends_a], before[ends_b] - both[ends_b]
        # A's tokens of a group stand before B's of it, and behind B's of earlier groups
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a], codes[place_b] = 3 * a + both[ends_a], 3 * b + 2 * both[ends_b]
        letters = self.table[codes].view(np.uint8)
        text = letters[letters != 0].tobytes()
        bounds = np.concatenate([[0], np.cumsum(self.table_size[codes])])[np.concatenate([[0], np.cumsum(counts[0] + counts[1])])].tolist()
        return [text[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]

    def units(self, text: pa.Array, strings: bool) -> tuple[np.ndarray, np.ndarray]:
        """The known unit of each unit of the texts, and where each text's begin; texts without tokens have none."""
        at, first = self._placed(text, self.cuts, strings)
        bad = tb.per_text(~self.ok[at], first) > 0
        if bad.any() and self.cuts:  # not reproduced in units: as a whole, then
            some = np.flatnonzero(bad)
            whole, _ = self._placed(text.take(pa.array(some)), False, strings)
            keep = np.repeat(~bad, np.diff(first))
            sizes = np.where(bad, 0, np.diff(first))
            sizes[some] = self.ok[whole]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty(bounds[-1], np.int64)
            out[np.repeat(~bad, sizes)] = at[keep]
            out[np.repeat(bad, sizes)] = whole[self.ok[whole]]
            return out, bounds
        if bad.any():
            return at[np.repeat(~bad, np.diff(first))], np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(first)))])
        return at, first

    def _placed(self, text: pa.Array, cuts: bool, strings: bool) -> tuple[np.ndarray, np.ndarray]:
        full, starts, ends, first = units_of(text, cuts)
        numbers = tb.numbered(full, starts, ends, self.hasher)
        one = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
        one[numbers] = np.arange(len(numbers))
        raw = full.tobytes()
        units = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        if new := [u for u in units if u not in self.known]:
            self.learn(new, strings)
        return np.fromiter((self.known[u] for u in units), np.int64, len(units))[numbers], first


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    found, inverse = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, inverse, counts)
    return found, sums


def encoded(packed: DataFrame, models, seed: int, folder: str | None, keep_text: bool = True) -> DataFrame:
    """(row, text, path, units, key, n) of (row, text): what texts have, and counts of linked pairs.

    Each text has a row with the file of a table of units, in ``folder``, and numbers of units there (32 bits each).
    Each table has a row for each pair that its texts link, with ``key`` and ``n`` only.  Without a folder these are all.
    """
    kinds = packed.schema["row"].dataType, packed.schema["text"].dataType
    names = ["row", "text", "path", "units", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, path, times, types = Aligner(*models.value, seed), "", np.zeros(0, np.int64), None

        def ended() -> pa.RecordBatch:
            seen = times > 0  # units of a text that was encoded whole in the end may be without a place
            keys, n_links = aligner.keys[np.repeat(seen, aligner.n_links)], np.where(seen, aligner.n_links, 0)
            if folder:
                links = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)])), pa.array(keys))
                columns = [*(pa.array(x.astype(np.int32)) for x in (aligner.n_a, aligner.n_b, aligner.n_groups)), pa.array(aligner.groups, pa.large_binary()), links]
                write_batch(path, pa.RecordBatch.from_arrays(columns, names=["n_a", "n_b", "n_groups", "groups", "links"]))
            found, n = summed(keys, np.repeat(times, n_links))
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(found), t) for t in (*types, pa.string(), pa.binary())), pa.array(found), pa.array(n)], names=names)

        for batch in tb.slices(batches, "text"):
            if not path or aligner.full():
                if path:
                    yield ended()
                    aligner.forget()
                path, times, types = f"{folder}/{uuid.uuid4().hex}", times[:0], (batch.column("row").type, batch.column("text").type)
            at, first = aligner.units(batch.column("text"), bool(folder))
            more = np.bincount(at, minlength=len(aligner.ok))
            more[: len(times)] += times
            times, n = more, batch.num_rows
            if folder:
                units = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(at.astype(np.int32))])
                text = batch.column("text") if keep_text else pa.nulls(n, types[1])
                yield pa.RecordBatch.from_arrays([batch.column("row"), text, pa.array([path] * n), units, *(pa.nulls(n, pa.int64()) for _ in "kn")], names=names)
        if path:
            yield ended()

    rest = StructType.fromDDL("path string, units binary, key bigint, n bigint").fields
    return packed.mapInArrow(tb.tidy(run), StructType([StructField("row", kinds[0]), StructField("text", kinds[1]), *rest]))


def count_shards(partial: DataFrame, folder: str) -> DataFrame:
    """(path, n, low, high): files of sorted keys and counts; a count is doubled, plus one if no pair of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held, done, size = (none, none), [], 0

        def written() -> pa.RecordBatch:
            keys, values = (np.concatenate(x) for x in zip(*done, strict=True))
            path = f"{folder}/{uuid.uuid4().hex}"
            write_array(path, np.concatenate([keys, values]))
            return pa.RecordBatch.from_pylist([{"path": path, "n": len(keys), "low": int(keys[0]), "high": int(keys[-1])}])

        def whole(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
            most = np.repeat(np.maximum.reduceat(counts, new), np.diff(np.append(new, len(keys))))
            return keys, 2 * counts + (counts == most)

        for batch in batches:
            keys, counts = (np.concatenate([h, np.asarray(batch.column(c))]) for h, c in zip(held, ("key", "n"), strict=True))
            if not len(keys):
                continue
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, counts = keys[new], np.add.reduceat(counts, new)
            last = int(np.searchsorted(keys, keys[-1] >> 32 << 32))  # the last B id may go on
            held = keys[last:], counts[last:]
            if last:
                done.append(whole(keys[:last], counts[:last]))
                size += last
            if size >= SHARD:
                yield written()
                done, size = [], 0
        if len(held[0]):
            done.append(whole(*held))
        if done:
            yield written()

    n = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = partial.where("key is not null").select(F.shiftright("key", 32).alias("b"), "key", "n")
    ranges = partial.repartitionByRange(n, "b").sortWithinPartitions("key")
    return ranges.mapInArrow(tb.tidy(run), "path string, n bigint, low bigint, high bigint")


class Counts:
    """Lookup in shards that are mapped into memory as they are needed."""

    def __init__(self, shards: list[tuple[str, int, int, int]]) -> None:
        self.shards = sorted(shards, key=lambda s: s[2])
        self.low = np.array([s[2] for s in self.shards], np.int64)
        self.open: dict[int, np.ndarray] = {}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of keys, and whether each one's is the highest of its B id."""
        found, inverse = np.unique(keys, return_inverse=True)
        values = np.zeros(len(found), np.int64)
        shard = np.searchsorted(self.low, found, "right") - 1
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(found)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                k = int(shard[a])
                path, n = self.shards[k][:2]
                if k not in self.open:
                    self.open[k] = open_array(path)
                values[a:b] = self.open[k][n + np.searchsorted(self.open[k][:n], found[a:b])]
        return (values >> 1)[inverse], (values & 1)[inverse]


def _models(docs: DataFrame, model_a: str, model_b: str):
    return docs.sparkSession.sparkContext.broadcast((Path(model_a).read_text(), Path(model_b).read_bytes()))


def _shards(partial: DataFrame) -> list[tuple]:
    return [tuple(r) for r in cut(count_shards(partial, shared_folder(partial.sparkSession, "pair-counts"))).collect()]


def pair_counts(docs: DataFrame, model_a: str, model_b: str, text: str = "text") -> DataFrame:
    """(a_id, b_id, n, best): how many links hold each pair, and whether no pair of the B id has more."""
    packed = docs.select(F.lit(0).alias("row"), quoted(text).alias("text"))
    shards = _shards(cut(encoded(packed, _models(docs, model_a, model_b), tb.draw(), None)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(*(batch.column(c).to_pylist() for c in ("path", "n")), strict=True):
                held = open_array(path)
                keys, values = np.array(held[:n]), np.array(held[n:])
                yield pa.RecordBatch.from_arrays([pa.array(keys & LOW32), pa.array(keys >> 32), pa.array(values >> 1), pa.array(values % 2 == 1)], names=["a_id", "b_id", "n", "best"])

    listed = docs.sparkSession.createDataFrame([s[:2] for s in shards], "path string, n bigint").repartition(max(1, len(shards)))
    return listed.mapInArrow(tb.tidy(run), "a_id bigint, b_id bigint, n bigint, best boolean")


def align(docs: DataFrame, model_a: str, model_b: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add tokens, groups and links of each text, the links of highest count, the sum of counts, and ``groups``.

    ``n_best`` counts the links whose pair no other pair of its B id exceeds in the corpus, ``count_sum``
    adds the corpus-wide counts of all links; ``groups`` spells the alignment as ``a1,a2|b1;a3|b2,b3``.
    Rows are written once on the way, without the texts where they are not kept.
    The models' files are read on the driver.
    """
    models, spark = _models(docs, model_a, model_b), docs.sparkSession
    carried = Carried(docs, RESULTS, text)
    held = cut(encoded(carried.pack(docs), models, tb.draw(), shared_folder(spark, "units"), keep_text))
    shards = spark.sparkContext.broadcast(_shards(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of = Counts(shards.value), None
        for whole in batches:
            paths = whole.column("path").to_pylist()
            edges = [*(i for i in range(len(paths)) if i == 0 or paths[i] != paths[i - 1]), len(paths)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                batch = whole.slice(lo, hi - lo)
                if paths[lo] != of:
                    of = paths[lo]
                    known = read_batch(of)
                    bounds = np.asarray(known.column("links").offsets)
                    n, best = counts.find(np.asarray(known.column("links").values))
                    per_unit = [*(np.asarray(known.column(c)) for c in ("n_a", "n_b", "n_groups")), np.diff(bounds), tb.per_text(best, bounds), tb.per_text(n, bounds)]
                    spelled = known.column("groups").to_pylist()
                cells = batch.column("units").to_pylist()
                units = np.frombuffer(b"".join(cells), np.int32)
                first = np.concatenate([[0], np.cumsum([len(c) // 4 for c in cells], dtype=np.int64)])
                numbers, ends = units.tolist(), first.tolist()
                groups = [b"".join(map(spelled.__getitem__, numbers[a:b]))[:-1].decode() for a, b in zip(ends, ends[1:], strict=False)]
                yield carried.batch(batch, [*(pa.array(tb.per_text(x[units], first)) for x in per_unit), pa.array(groups, pa.string())])

    found = carried.unpack(carried.map(held.where("path is not null").select("row", "text", "path", "units"), run))
    return found if keep_text else found.drop(text)
