"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: a row is a shard of some documents, with its
dictionary of terms and, for each term, the ascending word positions of its postings.
A window of test words starts from the postings of its rarest term in the shard,
shifted by that term's offset, and keeps those that the shifted lists of its other
terms, rarest next, hold as well.

Words are runs of ASCII letters (case folded), digits and non-ASCII characters; terms
are compared as such, not by hashes.  A window is ``width`` consecutive words of an
item; an item of fewer words, but not none, is one window.  A proximity match has all
different terms of a window, in any order, within ``reach`` consecutive words.

Items of up to ``ITEM_BYTES`` of text are broadcast to the shards, whose documents aren't
shuffled then.  Beyond that nothing is broadcast or collected: windows are sent to the
shards that have their rarest term, by counts over the whole index (``routed``).
Matches are the same.

Null and empty texts have no words.  Items with a null id mark words as hit but
are not listed.  Repeated documents give a row each; items of one id count as
one.  Ids may be of any type.  ``annotate`` replaces columns named like its results and
carries others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tessera.llm import textbytes as tb
from tessera.llm.shared import Carried, cut, field, quoted

MEMBER = np.zeros(256, bool)
MEMBER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WIDTH, REACH = 10, 12
#: Text of all items that are broadcast, at most; text of a shard that is kept as a table; windows looked up together.
ITEM_BYTES, SHARD_BYTES, LOOKED_UP = 1 << 24, 1 << 21, 1 << 16
#: Candidate places that are looked at together.
PLACES = 1 << 20
SHARD = ("words", "terms", "ends", "starts", "postings")


def words_of(text: pa.Array, hasher: tb.Hasher) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words of all texts, the number of each word among them, and where each text's words begin."""
    data, offsets = tb.text_bytes(text)
    data = FOLD[data]
    starts, ends, words = tb.spans_of(MEMBER[data], offsets)
    numbers = tb.numbered(data, starts, ends, hasher)
    one = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
    one[numbers] = np.arange(len(numbers))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], numbers, words


class Shard:
    """Postings of some documents: word positions by term, and where each document's words begin."""

    def __init__(self, words: np.ndarray, terms: list[bytes], starts: np.ndarray, postings: np.ndarray) -> None:
        self.words, self.terms, self.starts, self.postings = words, terms, starts, postings
        self.counts = np.diff(starts)
        self.size = len(postings) + 1
        #: All lists on end: (term, position) as ascending numbers.
        self.lists = np.repeat(np.arange(len(terms)), self.counts) * self.size + postings

    @classmethod
    def of(cls, text: pa.Array, hasher: tb.Hasher) -> Shard:
        terms, numbers, words = words_of(text, hasher)
        counts = np.bincount(numbers, minlength=len(terms))
        return cls(words, terms, np.concatenate([[0], np.cumsum(counts)]), np.argsort(numbers, kind="stable"))

    @classmethod
    def read(cls, row: dict[str, bytes]) -> Shard:
        words, ends, starts, postings = (np.frombuffer(row[k], kind) for k, kind in (("words", np.int64), ("ends", np.int64), ("starts", np.int64), ("postings", np.int32)))
        at = [0, *ends.tolist()]
        return cls(words, [row["terms"][a:b] for a, b in zip(at, at[1:], strict=False)], starts, postings.astype(np.int64))

    def write(self) -> dict[str, bytes]:
        ends = np.cumsum(np.fromiter(map(len, self.terms), np.int64, len(self.terms)))
        return {"words": self.words.astype(np.int64).tobytes(), "terms": b"".join(self.terms), "ends": ends.astype(np.int64).tobytes(), "starts": self.starts.astype(np.int64).tobytes(), "postings": self.postings.astype(np.int32).tobytes()}

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words, at, "right") - 1

    def first_from(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first posting of a term from a position on; beyond the last position if there is none."""
        k = np.searchsorted(self.lists, term * self.size + np.maximum(at, 0))
        found = self.lists[np.minimum(k, len(self.lists) - 1)] - term * self.size
        return np.where((k < len(self.lists)) & (found < self.size), found, self.size)


def grouped(rows: list[tuple[tuple[bytes, ...], int]]) -> tuple[dict[bytes, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of (words, owner): numbers of all terms, and for each width the terms of the different windows, and pairs (window, owner)."""
    numbers: dict[bytes, int] = {}
    by_width: dict[int, tuple[list, list]] = {}
    for words, owner in rows:
        terms, owners = by_width.setdefault(len(words), ([], []))
        terms.append([numbers.setdefault(w, len(numbers)) for w in words])
        owners.append(owner)
    groups = []
    for _, (terms, owners) in sorted(by_width.items()):
        found, which = np.unique(np.array(terms, np.int64), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.array(owners, np.int64)], 1), axis=0)
        groups.append((found, pairs[:, 0], pairs[:, 1]))
    return numbers, groups


def item_windows(texts: list[str | None], width: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """(words, index of the item) of each window."""
    terms, numbers, words = words_of(pa.array(texts, pa.string()), tb.Hasher(tb.draw()))
    for i, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist(), strict=True)):
        own = [terms[n] for n in numbers[a:b]]
        for at in range(max(1, len(own) - width + 1) if own else 0):
            yield tuple(own[at : at + width]), i


def places(shard: Shard, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The terms of windows (rows of the shard's term numbers) rarest first, with their offsets, for each posting of the rarest.

    Yields (window, terms, offsets, posting), blocks of about ``PLACES`` postings.
    """
    order = np.argsort(shard.counts[terms], axis=1, kind="stable")
    terms = np.take_along_axis(terms, order, 1)
    ends, lo = np.cumsum(shard.counts[terms[:, 0]]), 0
    while lo < len(terms):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PLACES, "right")))
        counts = shard.counts[terms[lo:hi, 0]]
        row = np.repeat(np.arange(lo, hi), counts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield row, terms[row], order[row], shard.postings[shard.starts[terms[row, 0]] + step].astype(np.int64)
        lo = hi


def exact(shard: Shard, window: np.ndarray, terms: np.ndarray, offset: np.ndarray, posting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) where the shifted lists of all its terms meet."""
    n, start = terms.shape[1], posting - offset[:, 0]
    text = shard.text_of(posting)
    keep = np.flatnonzero((start >= shard.words[text]) & (start + n <= shard.words[text + 1]))
    for j in range(1, n):
        at = start[keep] + offset[keep, j]
        keep = keep[shard.first_from(terms[keep, j], at) == at]
    return window[keep], start[keep]


def near(shard: Shard, window: np.ndarray, terms: np.ndarray, posting: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, posting) where all different terms of the window are within ``reach`` words, the rarest at the posting.

    A bit for each of the ``reach`` spans around a posting tells whether it has all terms so far.
    """
    text = shard.text_of(posting)
    lowest, highest = shard.words[text], shard.words[text + 1]
    keep, bits = np.arange(len(window)), np.full(len(window), (1 << reach) - 1, np.int64)
    for j in range(1, terms.shape[1]):
        term, here, mask = terms[keep, j], posting[keep], np.zeros(len(keep), np.int64)
        at = np.maximum(here - reach + 1, lowest[keep])
        last = np.minimum(here + reach, highest[keep])
        open_ = np.arange(len(keep))
        while len(open_):
            found = shard.first_from(term[open_], at[open_])
            open_, found = open_[found < last[open_]], found[found < last[open_]]
            # bit k: the span that begins at here - k; it has the posting if k - reach < here - found <= k
            shift = here[open_] - found
            mask[open_] |= np.where(shift >= 0, ((1 << reach) - 1) & -(1 << np.maximum(shift, 0)), (1 << np.maximum(reach + shift, 0)) - 1)
            at[open_] = found + 1
        bits[keep] &= mask
        keep = keep[bits[keep] != 0]
    return window[keep], posting[keep]


def look_up(shard: Shard, numbers: dict[bytes, int], groups: list, reach: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that are hit, and pairs (text, owner) by phrase and by proximity; owners below 0 are left out."""
    hit = np.zeros(len(shard.postings), bool)
    pairs: list[list[np.ndarray]] = [[np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]]
    here = np.full(len(numbers) + 1, -1, np.int64)
    here[np.fromiter((numbers.get(t, -1) for t in shard.terms), np.int64, len(shard.terms))] = np.arange(len(shard.terms))
    here[-1] = -1
    for terms, pair_window, pair_owner in groups:
        at = here[terms]
        found = np.flatnonzero((at >= 0).all(1))

        def owned(window: np.ndarray, place: np.ndarray) -> np.ndarray:
            got = np.unique(np.stack([found[window], shard.text_of(place)], 1), axis=0)  # noqa: B023
            lo, hi = np.searchsorted(pair_window, got[:, 0]), np.searchsorted(pair_window, got[:, 0], "right")  # noqa: B023
            row = np.repeat(np.arange(len(got)), hi - lo)
            owner = pair_owner[np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]  # noqa: B023
            return np.stack([got[row, 1], owner], 1)[owner >= 0]

        for window, own, offset, posting in places(shard, at[found]):
            met, start = exact(shard, window, own, offset, posting)
            hit |= tb.covered(start, terms.shape[1], len(hit))
            pairs[0].append(owned(met, start))
            if reach is not None:
                pairs[1].append(owned(*near(shard, window, own, posting, reach)))
    return hit, *(np.unique(np.concatenate(p), axis=0) for p in pairs)


def _lists(pairs: np.ndarray, n: int, names: pa.Array | None = None) -> pa.ListArray:
    """The second of (text, owner) for each text, as numbers or as ``names``."""
    values = pa.array(pairs[:, 1]) if names is None else names.take(pa.array(pairs[:, 1]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(n + 1)), pa.int32()), values)


def _checked(reach: int | None) -> None:
    if reach is not None and not 0 < reach < 63:
        raise ValueError(f"reach is {reach}; it must be from 1 to 62")


def _broadcast(items: DataFrame, item_id: str, text: str, width: int):
    """(ids, numbers, groups) of all items, whose text is known to fit."""
    rows = items.select(quoted(item_id).alias("id"), quoted(text).alias("text")).collect()
    ids = sorted({r.id for r in rows if r.id is not None})
    place = {i: k for k, i in enumerate(ids)}
    numbers, groups = grouped([(words, place.get(rows[i].id, -1)) for words, i in item_windows([r.text for r in rows], width)])
    return items.sparkSession.sparkContext.broadcast((ids, numbers, groups))


def _fits(items: DataFrame, text: str, limit: int) -> bool:
    size = items.agg(F.coalesce(F.sum(F.octet_length(quoted(text)) + F.lit(64)), F.lit(0))).first()[0]
    return size <= limit


def _index(docs: DataFrame, size: int = SHARD_BYTES) -> DataFrame:
    """(shard, docs, and the columns of SHARD) of (doc, text)."""
    seed = tb.draw()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, task, n = tb.Hasher(seed), TaskContext.get().partitionId(), 0
        for batch in tb.slices(batches, "text", size):
            row = Shard.of(batch.column("text"), hasher).write()
            listed = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc"))
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n], pa.int64()), listed, *(pa.array([row[c]], pa.binary()) for c in SHARD)], names=["shard", "docs", *SHARD])
            n += 1

    rest = StructType.fromDDL("shard bigint, " + ", ".join(f"{c} binary" for c in SHARD)).fields
    return docs.select("doc", "text").mapInArrow(tb.tidy(run), StructType([rest[0], StructField("docs", ArrayType(docs.schema["doc"].dataType)), *rest[1:]]))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of the index: the ``key`` of each document and the postings.  It can be written and searched again."""
    return _index(docs.select(quoted(key).alias("doc"), quoted(text).alias("text")))


def search(index: DataFrame, items: DataFrame, key: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = WIDTH, reach: int | None = REACH, limit: int = ITEM_BYTES) -> DataFrame:
    """A row for each indexed document: ``n_words``, ``n_hit`` and the items by phrase (``items``) and by proximity (``near_items``).

    Items beyond ``limit`` bytes are routed to the shards instead of broadcast.
    """
    _checked(reach)
    kind = StructField("doc", index.schema["docs"].dataType.elementType)
    if not _fits(items, text, limit):
        return routed(index, items, item_id, text, width, reach).withColumnRenamed("doc", key)
    shared, names = _broadcast(items, item_id, text, width), field(items, item_id, "id")
    results = _results(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard.read({c: batch.column(c)[k].as_py() for c in SHARD})
                yield pa.RecordBatch.from_arrays([batch.column("docs")[k].values, *annotated(shard, shared.value, results, reach)], names=["doc", *(f.name for f in results)])

    return index.mapInArrow(tb.tidy(run), StructType([kind, *results])).withColumnRenamed("doc", key)


def _results(names: StructField) -> list[StructField]:
    return [*StructType.fromDDL("n_words bigint, n_hit bigint").fields, StructField("items", ArrayType(names.dataType)), StructField("near_items", ArrayType(names.dataType))]


def annotated(shard: Shard, windows: tuple, results: list[StructField], reach: int | None) -> list[pa.Array]:
    from pyspark.sql.pandas.types import to_arrow_type

    ids, numbers, groups = windows
    hit, listed, nearby = look_up(shard, numbers, groups, reach)
    names, n = pa.array(ids, to_arrow_type(results[2].dataType.elementType)), len(shard.words) - 1
    return [pa.array(np.diff(shard.words), pa.int64()), pa.array(tb.per_text(hit, shard.words), pa.int64()), _lists(listed, n, names), _lists(nearby, n, names)]


def routed(index: DataFrame, items: DataFrame, item_id: str, text: str, width: int, reach: int | None) -> DataFrame:
    """(doc, n_words, n_hit, items, near_items) without a broadcast: windows go to the shards that have their rarest term."""
    index = cut(index)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            found = list(item_windows(batch.column("text").to_pylist(), width))
            for at in range(0, len(found), 10_000):
                some = found[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([i for _, i in some], pa.int64())), pa.array([[w.decode() for w in words] for words, _ in some], pa.list_(pa.string()))], names=["id", "words"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard.read({c: batch.column(c)[k].as_py() for c in SHARD})
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("shard")[k].as_py()] * len(shard.terms), pa.int64()), pa.array([t.decode() for t in shard.terms], pa.string()), pa.array(shard.counts, pa.int64())], names=["shard", "term", "n"])

    own = items.select(quoted(item_id).alias("id"), quoted(text).alias("text"))
    listed = own.mapInArrow(tb.tidy(windows), StructType([own.schema["id"], *StructType.fromDDL("words array<string>").fields])).distinct()
    listed = cut(listed.withColumn("key", F.sha2(F.array_join("words", " "), 256)))
    single = listed.groupBy("key").agg(F.first("words").alias("words"))
    posted = cut(index.mapInArrow(tb.tidy(terms), "shard bigint, term string, n bigint"))
    counts = posted.groupBy("term").agg(F.sum("n").alias("n"))
    spelled = single.select("key", "words", F.explode(F.array_distinct("words")).alias("term"))
    rarest = spelled.join(counts, "term").groupBy("key").agg(F.count("*").alias("met"), F.min(F.struct("n", "term")).alias("rarest"), F.first("words").alias("words"))
    rarest = rarest.where(F.col("met") == F.size(F.array_distinct("words"))).select("key", "words", F.col("rarest.term").alias("term"))
    # the search numbers windows within a shard; an answer names them by their keys
    sent = posted.select("shard", "term").join(rarest, "term").select("shard", "key", "words")
    nothing = {c: F.lit(None).cast(index.schema[c].dataType) for c in ("docs", *SHARD)}
    both = index.select("shard", "docs", *SHARD, F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<string>").alias("words_of"))
    both = both.unionByName(sent.select("shard", *(v.alias(k) for k, v in nothing.items()), "key", F.col("words").alias("words_of")))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("shard", "key", "words_of")
        rows = ((*r, batch, k) for batch in batches for k, r in enumerate(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)))
        for at, group in groupby(rows, lambda r: r[0]):
            *_, batch, k = next(group)  # the index's own row
            listed_docs = batch.column("docs")[k].values
            shard = Shard.read({c: batch.column(c)[k].as_py() for c in SHARD})
            hit, found, held = np.zeros(len(shard.postings), bool), ([], []), []

            def look() -> None:
                nonlocal hit
                numbers, groups = grouped([(tuple(w.encode() for w in words), i) for i, (_, words) in enumerate(held)])  # noqa: B023
                some, *pairs = look_up(shard, numbers, groups, reach)  # noqa: B023
                hit |= some
                for kept, new in zip(found, pairs, strict=True):  # noqa: B023
                    kept += [(t, held[i][0]) for t, i in new.tolist()]  # noqa: B023
                held.clear()  # noqa: B023

            for _, key, words, *_ in group:
                held.append((key, words))
                if len(held) >= LOOKED_UP:
                    look()
            look()
            n, lists = len(shard.words) - 1, []
            for kept in found:
                of: list[list[str]] = [[] for _ in range(n)]
                for t, key in kept:
                    of[t].append(key)
                lists.append(pa.array(of, pa.list_(pa.string())))
            place = pa.array([at] * n, pa.int64()), pa.array(range(n), pa.int64())
            yield pa.RecordBatch.from_arrays([*place, listed_docs, pa.array(np.diff(shard.words), pa.int64()), pa.array(tb.per_text(hit, shard.words), pa.int64()), *lists], names=["shard", "i", "doc", "n_words", "n_hit", "keys", "near_keys"])

    ordered = both.repartition("shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first())
    schema = StructType.fromDDL("shard bigint, i bigint, n_words bigint, n_hit bigint, keys array<string>, near_keys array<string>").fields
    answers = cut(ordered.mapInArrow(tb.tidy(met), StructType([*schema[:2], StructField("doc", index.schema["docs"].dataType.elementType), *schema[2:]])))
    pairs = [answers.select("shard", "i", F.explode(c).alias("key"), F.lit(c).alias("kind")) for c in ("keys", "near_keys")]
    named = pairs[0].unionByName(pairs[1]).join(listed.where("id is not null").select("key", "id"), "key")
    of = lambda c: F.array_sort(F.collect_set(F.when(F.col("kind") == c, F.col("id"))))
    lists = named.groupBy("shard", "i").agg(of("keys").alias("items"), of("near_keys").alias("near_items"))
    none = F.array().cast(ArrayType(own.schema["id"].dataType))
    return answers.join(lists, ["shard", "i"], "left").select("doc", "n_words", "n_hit", F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def annotate(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", text: str = "text", width: int = WIDTH, reach: int | None = REACH, limit: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with their matches; a shard is searched as soon as it is built if the items fit."""
    _checked(reach)
    kind = field(items, item_id, "id").dataType.simpleString()
    carried = Carried(docs, f"n_words bigint, n_hit bigint, items array<{kind}>, near_items array<{kind}>", doc_text)
    packed = carried.pack(docs)
    if not _fits(items, text, limit):
        whole = packed.select(F.struct("row", "text").alias("doc"), "text")
        return carried.unpack(routed(_index(whole), items, item_id, text, width, reach).select("doc.row", "doc.text", "n_words", "n_hit", "items", "near_items"))
    shared, results, seed = _broadcast(items, item_id, text, width), _results(field(items, item_id, "id")), tb.draw()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tb.Hasher(seed)
        for batch in tb.slices(batches, "text"):
            yield carried.batch(batch, annotated(Shard.of(batch.column("text"), hasher), shared.value, results, reach))

    return carried.unpack(carried.map(packed, run))
