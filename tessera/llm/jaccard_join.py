"""N-gram Jaccard self-join by a MinHash LSH forest and exact verification.

A document is the set of its runs of ``WORDS`` words (ASCII case folded; one of fewer
words, but not none, is one run).  Documents of one set (by two hashes, 128 bits)
are copies and take part as one.

Each tree of the forest sorts the documents by a label of ``DEEPEST`` MinHash values: a
prefix trie.  A document walks its trie from the longest prefix that it has in common
with others, and shortens it value by value, until it meets a leader that is close, or
down to the length at which a pair at the threshold shares a prefix in some tree with
the target probability.  It joins every leader within reach that it meets, and leads
itself if none is close.  How far it reaches allows for the distance of a close leader and
for the sketches' errors.  A subtree of more than ``CROWD`` documents is dealt to several
tasks, whose leaders meet in a second round.

A walk gives a forest of these joins, never its pairs.  What hangs together is
verified exactly, in blocks of documents against blocks, which give each document's
number of links and a spanning forest.

Null texts, and those without words, are classes of their own without links.  Rows
of one id and text are copies.  Null ids come last.  Columns named like a result are
replaced; others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import textbytes as tb
from tessera.llm.components import components
from tessera.llm.decontaminate import FOLD
from tessera.llm.shared import Carried, cut, field, free_shuffles, quoted

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Trees, and values of a label, of which a byte each is kept.
TREES, DEEPEST = 32, 8
#: Documents of a subtree that one task walks.
CROWD = 4096
#: Documents on either side of a verified block, and columns of a block's matrices.
BLOCK, COLUMNS = 256, 2048


def depth_for(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> int:
    """The longest prefix that a pair at the threshold shares in some tree with probability ``recall``."""
    for depth in range(DEEPEST, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees cannot find pairs at {threshold} with probability {recall}")


def shingles(text: pa.Array, hasher: tb.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text (64-bit hashes), and where each text's begin."""
    data, offsets = tb.text_bytes(text)
    data = FOLD[data]
    starts, ends, words = tb.spans_of(~tb.ASCII_SPACE[data], offsets)
    hashes, size = hasher.spans(hasher.sums(data), starts, ends), np.diff(words)
    first = tb.windows(words, WORDS)
    found, owner = [tb.chain(hashes, WORDS)[first]], [tb.owners(words)[first]]
    for n in range(1, WORDS):
        few = np.flatnonzero(size == n)
        found.append(tb.chain(hashes, n)[words[few]])
        owner.append(few)
    hashes, owner = np.concatenate(found), np.concatenate(owner).astype(np.uint32)
    keys = tb.mix(hashes ^ tb.mix(owner.astype(tb.U64) + tb.BASE))
    one = np.unique(keys, return_index=True)[1]
    one = one[np.argsort(owner[one].astype(np.uint16) if len(offsets) <= 1 << 16 else owner[one], kind="stable")]
    return hashes[one], np.searchsorted(owner[one], np.arange(len(offsets)))


def signatures(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, key, set_a, set_b, size, labels) of each (doc_id, key, text) with words; ``labels`` has one for each tree."""
    factors = tb.mix(np.arange(1, TREES * DEEPEST + 1, dtype=tb.U64) * tb.BASE) | tb.U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tb.Hasher(seed)
        for batch in tb.slices(batches, "text"):
            found, at = shingles(batch.column("text"), hasher)
            size = np.diff(at)
            full = np.flatnonzero(size)
            mixed, begin = tb.mix(found + tb.BASE), at[:-1][full]
            least = np.empty((len(full), TREES * DEEPEST), tb.U64)
            for k in range(TREES * DEEPEST if len(full) else 0):
                least[:, k] = np.minimum.reduceat(mixed * factors[k], begin)
            # the first value of a label is its highest byte
            labels = (tb.mix(least) & tb.U64(255)).astype(np.uint8).view(">u8").astype(np.int64)
            sets = [np.add.reduceat(x, begin).view(np.int64) if len(full) else np.zeros(0, np.int64) for x in (mixed, tb.mix(mixed))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * TREES, pa.int32()), pa.array(labels.ravel()))
            columns = [batch.column("doc_id").take(pa.array(full)), batch.column("key").take(pa.array(full)), pa.array(sets[0]), pa.array(sets[1]), pa.array(size[full]), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "set_a", "set_b", "size", "labels"])

    rest = StructType.fromDDL("key bigint, set_a bigint, set_b bigint, size bigint, labels array<bigint>").fields
    return docs.select("doc_id", "key", "text").mapInArrow(tb.tidy(run), StructType([field(docs, "doc_id", "doc_id"), *rest]))


def reach(threshold: float = THRESHOLD, close: float = 0.85, apart: int = 1) -> float:
    """Share of equal label values from which a leader is joined.

    Who is ``close`` to a leader is within a distance of it; who is at the threshold to
    that one is within this distance (of ``apart`` leaders) and 1 - threshold.  Four
    standard errors of a share lie between a sketch's and the true similarity.
    """
    error = lambda share: 4 * np.sqrt(share * (1 - share) / (TREES * DEEPEST))
    near = max(0.0, threshold - apart * (1 - close + error(close)))
    return max(0.0, near - error(near))


def walks(subtrees: DataFrame, depth: int, close: float, joined: float) -> DataFrame:
    """(a, b, leads, node, label, labels): links of documents to leaders and among leaders, and each leader.

    Links of one walk hold together whoever joined one leader; there are fewer than
    two for each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last, first = None, 0, [0] * (DEEPEST + 2)
        leaders, parent, sketches = [], [], np.zeros((8, TREES * DEEPEST), np.uint8)

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "part", "label", "member")), strict=True)
            values = np.ascontiguousarray(batch.column("labels").flatten()).view(np.uint8).reshape(batch.num_rows, TREES * DEEPEST)
            a, b, led = [], [], []
            for at, (node, part, label, member) in enumerate(rows):
                if (node, part) != of:
                    of, leaders, parent, sketches, first = (node, part), [], [], sketches[:8], [0] * (DEEPEST + 2)
                else:  # leaders that share a prefix with this label are the last ones
                    shared = (64 - ((label ^ last) & (2**64 - 1)).bit_length()) // 8
                    first[shared + 1 :] = [len(leaders)] * (DEEPEST + 1 - shared)
                last, one, group, led_by = label, values[at], None, False
                for length in range(DEEPEST, depth - 1, -1):
                    lo, hi = first[length], first[length + 1]
                    share = (sketches[lo:hi] == one).mean(1) if hi > lo else ()
                    for k in np.flatnonzero(np.asarray(share) >= joined).tolist():
                        met = root(lo + k)
                        if group is None:
                            group = met
                            a.append(member)
                            b.append(leaders[met])
                        elif met != group:  # this document holds two groups of leaders together
                            a.append(leaders[met])
                            b.append(leaders[group])
                            parent[met] = group
                        if share[k] >= close:  # whoever is near this one joins that leader as well
                            led_by = True
                            break
                    if led_by:
                        break
                if not led_by:
                    if len(leaders) == len(sketches):
                        sketches = np.concatenate([sketches, np.zeros_like(sketches)])
                    sketches[len(leaders)] = one
                    parent.append(len(leaders) if group is None else group)
                    leaders.append(member)
                    led.append(at)
            links = np.unique(np.array([a, b], np.int64), axis=1)
            rows = batch.take(pa.array(led, pa.int64()))
            n, m = links.shape[1], len(led)
            ids = [pa.array(np.concatenate([x, np.asarray(rows.column("member"))])) for x in links]
            others = [pa.concat_arrays([pa.nulls(n, rows.schema.field(c).type), rows.column(c)]) for c in ("node", "label", "labels")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array([False] * n + [True] * m), *others], names=["a", "b", "leads", "node", "label", "labels"])

    ordered = subtrees.repartition("node", "part").sortWithinPartitions("node", "part", "label", "member")
    return ordered.mapInArrow(tb.tidy(run), "a bigint, b bigint, leads boolean, node bigint, label bigint, labels array<bigint>")


def candidates(alone: DataFrame, depth: int, threshold: float, close: float = 0.85) -> tuple[DataFrame, int]:
    """(a, b): links that hold together all documents (member, labels) that may be at the threshold; and a bound of their number."""
    prefix = F.shiftrightunsigned("label", 8 * (DEEPEST - depth))
    placed = alone.select("member", F.posexplode("labels").alias("tree", "label")).withColumn("node", F.xxhash64("tree", prefix))
    crowded = cut(placed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), TREES * alone.count() // 2)
    part = F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / F.lit(CROWD)))
    members = placed.join(crowded, "node").join(alone.select("member", "labels"), "member")
    walked = crowded.agg(F.sum("n")).first()[0] or 0
    found = cut(walks(members.select("node", part.alias("part"), "label", "member", "labels"), depth, close, reach(threshold, close)), walked)
    leaders = found.where("leads").join(crowded.where(F.col("n") > CROWD).select("node"), "node", "left_semi")
    again = walks(leaders.select("node", F.lit(0).alias("part"), "label", F.col("a").alias("member"), "labels"), depth, 2.0, reach(threshold, close, 2))
    links = found.where("not leads").select("a", "b").unionByName(again.where("not leads").select("a", "b")).distinct()
    return links, 2 * found.count()  # fewer than two of a second walk for each leader that was found


def overlaps(text: pa.Array, hasher: tb.Hasher, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared shingles of texts before ``split`` (rows) and from it on (columns; all if 0), and all sizes."""
    found, at = shingles(text, hasher)
    n, size = len(at) - 1, np.diff(at)
    order = np.argsort(found, kind="stable")
    ids = np.cumsum(np.concatenate([[0], found[order[1:]] != found[order[:-1]]])) if len(order) else order
    owner = tb.owners(at)[order]
    common = np.bincount(ids)[ids] > 1 if len(ids) else np.zeros(0, bool)
    ids, owner = np.unique(ids[common], return_inverse=True)[1], owner[common]
    out = np.zeros((split or n, n - split if split else n), np.int64)
    for lo in range(0, int(ids.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(ids, [lo, lo + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[a:b], ids[a:b] - lo] = 1
        out += (part[: split or n] @ part[split:].T).astype(np.int64)
    return out, size


def at_threshold(shared: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have a similarity of ``threshold`` or more, by whole numbers: the threshold counts as the fraction nearest to it."""
    share = Fraction(threshold).limit_denominator(10_000)
    return shared * (share.numerator + share.denominator) >= share.numerator * (left[:, None] + right[None, :])


def verified(texts: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(a, b, n): a document with ``n`` links in a block, and the root of its part of the block's forest."""

    def block(first: int, second: int, keys: list[int], sides: list[int], text: list[str], hasher: tb.Hasher) -> list[tuple[int, int, int]]:
        split = 0 if first == second else sum(1 for s in sides if s == first)
        if first != second and split in (0, len(keys)):
            return []
        shared, size = overlaps(pa.array(text, pa.large_string()), hasher, split)
        left, right = size[: split or len(size)], size[split:]
        linked = at_threshold(shared, left, right, threshold)
        if not split:
            np.fill_diagonal(linked, False)
        count = linked.sum(1) if not split else np.concatenate([linked.sum(1), linked.sum(0)])
        whole = linked if not split else np.block([[np.zeros((split, split), bool), linked], [linked.T, np.zeros((len(right), len(right)), bool)]])
        root = np.arange(len(keys))
        while True:
            new = np.minimum(root, np.where(whole, root[None, :], len(keys)).min(1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        return [(keys[i], keys[root[i]], int(count[i])) for i in np.flatnonzero(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tb.Hasher(seed)
        names = ("root", "first", "second", "side", "key", "text")
        rows = (r for batch in batches for part in tb.slices(iter([batch]), "text") for r in zip(*(part.column(c).to_pylist() for c in names), strict=True))
        for (_, first, second), group in groupby(rows, lambda r: r[:3]):
            _, _, _, sides, keys, text = zip(*group, strict=True)
            if found := block(first, second, list(keys), list(sides), list(text), hasher):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "n"])

    ordered = texts.repartition("root", "first", "second").sortWithinPartitions("root", "first", "second", "side", "key")
    return ordered.mapInArrow(tb.tidy(run), "a bigint, b bigint, n bigint")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, class_id, keeper, n_links) of each (doc_id, key, text) with words: see ``near_duplicates``; ``keeper`` is the key of the least one."""
    depth, seed, sets = depth_for(threshold, recall), tb.draw(), ["set_a", "set_b", "size"]
    signed = cut(signatures(docs, seed))
    one = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    n = signed.count()
    copies = signed.groupBy(*sets).agg(F.min(one).alias("one"), F.first("labels").alias("labels"))
    alone = cut(copies.withColumn("member", F.monotonically_increasing_id()), n)
    groups = cut(components(*candidates(alone, depth, threshold)), n)
    free_shuffles(docs.sparkSession)
    blocks = groups.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    side = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    sided = groups.join(blocks, "root").select("root", F.col("node").alias("member"), "blocks", side.alias("side")).join(alone.select("member", F.col("one.doc_id").alias("of"), F.col("one.key").alias("with")), "member")
    texts = docs.join(sided, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("with"))).dropDuplicates(["member"])
    other = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("root", F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second"), "side", F.col("member").alias("key"), "text")
    links = cut(verified(pairs, threshold, seed))
    free_shuffles(docs.sparkSession)
    counts = links.groupBy(F.col("a").alias("member")).agg(F.sum("n").alias("n_links"))
    roots = components(links.select("a", "b"), links.count()).withColumnRenamed("node", "member")
    known = alone.select(*sets, "one", "member").join(counts, "member", "left").join(roots, "member", "left")
    known = cut(known.select(*sets, "one", F.coalesce("root", "member").alias("root"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), n)
    named = known.groupBy("root").agg(F.min("one").alias("least")).select("root", F.col("least.doc_id").alias("class_id"), F.col("least.key").alias("keeper"))
    results = known.join(named, "root").select(*sets, "class_id", "keeper", "n_links")
    return signed.select("doc_id", "key", *sets).distinct().join(results, sets).drop(*sets)


def _placed(docs: DataFrame, carried: Carried, doc_id: str, text: str, threshold: float, recall: float) -> DataFrame:
    """(row, text, doc_id, key) and, for documents with words, (class_id, keeper, n_links)."""
    packed = carried.pack(docs, doc_id=quoted(doc_id), key=F.xxhash64(quoted(text)))
    found = classes(packed.select("doc_id", "key", "text"), threshold, recall).withColumnsRenamed({"doc_id": "of", "key": "with"})
    return packed.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("with")), "left")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does: that of the least id.

    Documents without words stay; repeated rows of one id and text become one.
    """
    carried = Carried(docs, "", text)
    found = _placed(docs, carried, doc_id, text, threshold, recall)
    least: Column = F.col("keeper").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("keeper")))
    return carried.unpack(found.where(least).dropDuplicates(["doc_id", "key"]))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Add ``class_id`` and ``n_links`` to every row.

    ``class_id`` is the least id of the documents that links connect, copies included
    (null only if all are null); ``n_links`` counts the different sets within the
    threshold of a document's own.
    """
    kind = docs.select(quoted(doc_id)).schema[0].dataType.simpleString()
    carried = Carried(docs, f"class_id {kind}, n_links bigint", text)
    found = _placed(docs, carried, doc_id, text, threshold, recall)
    class_id = F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return carried.unpack(found.withColumns({"class_id": class_id, "n_links": F.coalesce("n_links", F.lit(0)).cast("bigint")}))
