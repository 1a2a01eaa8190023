"""Language identification by interpolated Kneser-Ney character models.

Texts are folded to lower-case letters and single spaces; each letter is its code
point (those beyond 16 bits share 2048 codes), so that an n-gram of up to four
characters is one number.  Counts of the longest n-grams, continuation counts of the
shorter ones, discounts and totals are aggregations over all training rows.  The model
holds, for each order, a sorted array of hashed n-grams, and for each of these the
languages that have it with their log-probabilities; and likewise the backoff weights
of hashed histories.  A text gets the language of the lowest cross-entropy for each
character.

A model holds every n-gram of the training rows, so it, and its broadcast, grow with
the distinct n-grams of the corpus: 12 bytes for each, and 6 for each language that
has it.  At most ``MAX_LANGUAGES`` languages fit.

Two things are calibrated on a fold of the training rows that the counts leave out.  A
text is rejected if its cross-entropy is above the ``1 - reject`` quantile of that
of the fold's texts in the predicted language; and a score is the language's share of
exp(-sharpness * cross-entropy), with the sharpness that makes the fold's true
languages likeliest.

Null texts, and those without a letter, are ``und`` with score 0 and not accepted.
Rows of null language are not learned from.  Repeated rows count, and give a row,
each.  Columns named like a result are replaced; others are carried along.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.shared import Carried, cut, quoted

BITS, ORDER = 16, 4
CLASSES = 1 << BITS
MAX_LANGUAGES = 256
#: Characters scored together, n-grams a task holds before it hands them on, and cells of a matrix of log-probabilities.
PART, HELD, CELLS = 1 << 20, 1 << 20, 1 << 22
RESULTS = "lang_pred string, score double, cross_entropy double, accepted boolean"
#: Sharpnesses among which calibration chooses.
SHARPNESS = [2.0 ** (k / 2) for k in range(-2, 21)]


class Folder:
    """Turns texts into codes: 0 for a space, else a letter's class."""

    def __init__(self) -> None:
        points = np.arange(0x110000)
        # the codes of surrogates are no letters'
        self.codes = np.where(points < CLASSES, points, 0xD800 + points % 0x800).astype(np.uint16)
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.codes[~letter] = 0

    def fold(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts on end and where each begins; a text begins with ``ORDER - 1`` spaces if it has letters."""
        low = [(t or "").lower() for t in texts]
        lengths = np.fromiter(map(len, low), np.int64, len(low))
        codes = self.codes[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(low)), lengths)
        after = np.concatenate([[0], codes[:-1]]) if len(codes) else codes
        after = np.where(np.concatenate([[True], owner[1:] != owner[:-1]]), 0, after) if len(codes) else codes
        keep = (codes != 0) | (after != 0)  # single spaces, none at the start
        codes, owner = codes[keep], owner[keep]
        sizes = np.bincount(owner, minlength=len(low)) if len(owner) else np.zeros(len(low), np.int64)
        ends = np.cumsum(sizes + (ORDER - 1) * (sizes > 0))
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        out[np.arange(len(codes)) + (np.cumsum(sizes > 0) * (ORDER - 1))[owner]] = codes
        return out, np.concatenate([[0], ends])


def grams(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-gram that ends at each character behind the padding, and its text."""
    key = np.zeros(max(0, len(codes) - ORDER + 1), np.int64)
    for i in range(ORDER):
        key = (key << BITS) | codes[i : i + len(key)]
    starts = tb.windows(offsets, ORDER)
    return key[starts], tb.owners(offsets)[starts]


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(_fold(doc_id) == 0, F.lit(False))


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows; a task sums what it can hold before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, held = Folder(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (keys, counts) in held.items():
                for at in range(0, len(keys), 1 << 16):
                    k, c = keys[at : at + (1 << 16)], counts[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(c)], schema=schema)
            held.clear()

        for batch in tb.slices(batches, "text", PART):
            names = batch.column("lang").to_pylist()
            keys, owner = grams(*folder.fold(batch.column("text").to_pylist()))
            ids = {n: i for i, n in enumerate(dict.fromkeys(names))}
            of = np.array([ids[n] for n in names], np.int64)[owner] if len(owner) else owner
            for name, i in ids.items():
                new = np.unique(keys[of == i], return_counts=True)
                held[name] = merged([held[name], new]) if name in held else new
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    known = docs.select(quoted(lang).alias("lang"), quoted(text).alias("text")).where("text is not null and lang is not null")
    return known.mapInArrow(tb.tidy(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def hashed(gram: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, different for different ones."""
    return tb.mix(gram.astype(np.int64).view(tb.U64) + tb.BASE)


@dataclass
class Sparse:
    """A number for some pairs of an n-gram and a language."""

    #: Sorted hashes of n-grams, and where each one's languages begin.
    keys: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        """From n-grams and numbers of each language."""
        gram = np.concatenate([hashed(g) for g, _ in parts]) if parts else np.zeros(0, tb.U64)
        language = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(g) for g, _ in parts])
        order = np.argsort(gram, kind="stable")
        keys, starts = np.unique(gram[order], return_index=True)
        values = np.concatenate([v for _, v in parts])[order] if parts else np.zeros(0)
        return cls(keys, np.append(starts, len(order)), language[order], values.astype(np.float32))

    def fill(self, gram: np.ndarray, out: np.ndarray) -> None:
        """Write the numbers that there are into ``out``, a row for each n-gram."""
        if not len(self.keys):
            return
        h = hashed(gram)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[at] == h)
        lo, n = self.starts[at[row]], self.starts[at[row] + 1] - self.starts[at[row]]
        place = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        out[np.repeat(row, n), self.languages[place]] = self.values[place]

    def __len__(self) -> int:
        return len(self.keys)


@dataclass
class Model:
    languages: list[str]
    #: For each order: log-probabilities of n-grams, and log backoff weights of histories.
    keys: list[Sparse]
    histories: list[Sparse]
    limits: np.ndarray
    sharpness: float = 1.0

    def log_probabilities(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row for each n-gram (low bits used), a column for each language."""
        if order == 0:
            return np.full((len(gram), len(self.languages)), -np.log(CLASSES), np.float32)
        gram = gram & ((1 << (BITS * order)) - 1) if order < ORDER else gram
        out = self.log_probabilities(gram, order - 1)
        backoff = np.zeros_like(out)
        self.histories[order - 1].fill(shifted(gram), backoff)
        out += backoff
        self.keys[order - 1].fill(gram, out)
        return out

    def cross_entropy(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nats for each character by text and language, and the characters of each text."""
        gram, owner = grams(codes, offsets)
        n_texts, n_languages = len(offsets) - 1, len(self.languages)
        sums, counts = np.zeros((n_texts, n_languages)), np.bincount(owner, minlength=n_texts)
        distinct, which = np.unique(gram, return_inverse=True)
        step = max(1, CELLS // max(1, n_languages))
        logs = np.empty((len(distinct), n_languages), np.float32)
        for lo in range(0, len(distinct), step):
            logs[lo : lo + step] = self.log_probabilities(distinct[lo : lo + step])
        for lo in range(0, len(gram), step):
            of = owner[lo : lo + step]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sums[of[first]] += np.add.reduceat(logs[which[lo : lo + step]].astype(np.float64), first, axis=0)
        return -sums / np.maximum(1, counts)[:, None], counts


def shifted(gram: np.ndarray) -> np.ndarray:
    """The history of an n-gram: all but its last character."""
    return (gram.view(tb.U64) >> tb.U64(BITS)).view(np.int64)


def _tables(counts: DataFrame) -> tuple[list[dict], list[dict]]:
    """For each order, tables by language: all n-grams with counts, and the totals of their histories; discounts."""
    tables, discounts = [], []
    level = counts
    for order in range(ORDER, 0, -1):
        d = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"))
        discounts.insert(0, {r.lang: r.one / (r.one + 2 * r.two) if r.one and r.two else 0.5 for r in d.collect()})
        sums = level.groupBy("lang", F.shiftrightunsigned("gram", BITS).alias("history")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        joined = level.withColumn("history", F.shiftrightunsigned("gram", BITS)).join(sums, ["lang", "history"])
        rows = joined.select("lang", "gram", "n", "total", "kinds").toArrow()
        tables.insert(0, {name: {c: np.asarray(rows.column(c))[at] for c in ("gram", "n", "total", "kinds")} for name, at in _by_language(rows).items()})
        if order > 1:
            level = cut(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1)).alias("gram")).agg(F.count("*").alias("n")))
    return tables, discounts


def _by_language(rows: pa.Table) -> dict[str, np.ndarray]:
    names = rows.column("lang").dictionary_encode().combine_chunks()
    codes = np.asarray(names.indices)
    return {n: np.flatnonzero(codes == i) for i, n in sorted(enumerate(names.dictionary.to_pylist()), key=lambda x: x[1])}


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", reject: float = 0.005) -> Model:
    """A model of all rows outside the held-out fold, calibrated on the fold behind it."""
    known = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), quoted(lang).alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    learned = known.where(F.coalesce(_fold(F.col("doc_id")) != 1, F.lit(True)))
    model = estimate(count_grams(learned))
    if not model.languages:
        return model
    scored = cut(_scored(known.where(_fold(F.col("doc_id")) == 1).select("lang", "text"), model))
    levels = scored.where(F.col("lang") == F.col("lang_pred")).groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", 1 - reject, 10_000).alias("level"))
    for r in levels.collect():
        model.limits[model.languages.index(r.lang_pred)] = r.level
    fits = scored.agg(*(F.sum(F.col("fit")[k]).alias(f"fit{k}") for k in range(len(SHARPNESS)))).first()
    if fits[0] is not None:
        model.sharpness = SHARPNESS[int(np.argmax(fits))]
    return model


def _scored(fold: DataFrame, model: Model) -> DataFrame:
    """(lang, lang_pred, cross_entropy, fit) of texts with letters: ``fit`` has the true language's log-share for each sharpness."""
    shared = fold.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, model = Folder(), pickle.loads(shared.value)
        place = {n: i for i, n in enumerate(model.languages)}
        for batch in tb.slices(batches, "text", PART):
            entropy, counts = model.cross_entropy(*folder.fold(batch.column("text").to_pylist()))
            of = np.array([place.get(n, -1) for n in batch.column("lang").to_pylist()], np.int64)
            use = np.flatnonzero((counts > 0) & (of >= 0))
            entropy, of = entropy[use], of[use]
            best = entropy.argmin(1)
            fit = np.stack([-s * entropy[np.arange(len(of)), of] - np.logaddexp.reduce(-s * entropy, axis=1) for s in SHARPNESS], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * len(SHARPNESS), pa.int32()), pa.array(fit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(use)), pa.array(np.array(model.languages, object)[best], pa.string()), pa.array(entropy[np.arange(len(of)), best]), lists], names=["lang", "lang_pred", "cross_entropy", "fit"])

    return fold.mapInArrow(tb.tidy(run), "lang string, lang_pred string, cross_entropy double, fit array<double>")


def estimate(counts: DataFrame) -> Model:
    """Interpolated Kneser-Ney probabilities from counts of the longest n-grams."""
    tables, discounts = _tables(cut(counts))
    languages = sorted({n for t in tables for n in t})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a model holds at most {MAX_LANGUAGES}")
    model = Model(languages, [], [], np.full(len(languages), np.inf))
    lower: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for order in range(1, ORDER + 1):
        found, weights = [], []
        for name in languages:
            t, d = tables[order - 1][name], discounts[order - 1].get(name, 0.5)
            sort = np.argsort(t["gram"], kind="stable")
            gram, n, total, kinds = (t[c][sort] for c in ("gram", "n", "total", "kinds"))
            share = np.full(len(gram), 1 / CLASSES)
            if order > 1:  # whatever ends a seen n-gram is a seen one
                grams_, shares = lower[name]
                share = shares[np.searchsorted(grams_, gram & ((1 << (BITS * (order - 1))) - 1))]
            lower[name] = gram, (n - d) / total + d * kinds / total * share
            found.append((gram, np.log(lower[name][1])))
            history, one = np.unique(shifted(gram), return_index=True)
            weights.append((history, np.log(d * kinds[one] / total[one])))
        model.keys.append(Sparse.of(found))
        model.histories.append(Sparse.of(weights))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score``, ``cross_entropy`` and ``accepted``."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    carried = Carried(docs, RESULTS, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, model = Folder(), pickle.loads(shared.value)
        labels = np.array([*model.languages, "und"], object)
        for batch in tb.slices(batches, "text", PART):
            entropy, counts = model.cross_entropy(*folder.fold(batch.column("text").to_pylist()))
            none = (counts == 0) | (not model.languages)
            if model.languages:
                best = entropy.argmin(1)
                least = entropy[np.arange(len(best)), best]
                score = 1 / np.exp(model.sharpness * (least[:, None] - entropy)).sum(1)
                accepted = ~none & (least <= model.limits[best])
            else:
                best, least, score, accepted = (np.zeros(len(counts), t) for t in (np.int64, float, float, bool))
            columns = [pa.array(labels[np.where(none, len(model.languages), best)], pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(least, mask=none), pa.array(accepted)]
            yield carried.batch(batch, columns)

    return carried.unpack(carried.map(carried.pack(docs), run))
