"""Positive-unlabelled quality classifier.

A logistic model over character frequencies and layout ratios of whole texts that
minimises the non-negative unbiased risk

    prior * R(P, +) + max(0, R(U, -) - prior * R(P, -))

of all trusted positives P and all texts U, labelled or not.  With the logistic loss and
a linear model it is the greater of two convex functions; damped Newton steps minimise
it, each of them an aggregation over the table of features.  Labels other than positive are
never used.

The class prior is estimated from positives and unlabelled texts alone, unless it is
given: a first model is fitted without a quarter of the rows, and on those the share of
texts above a threshold is divided by the share of positives above it.  The ratio is the
prior plus what negatives are left above the threshold, so the least one over the
thresholds that ``TOP`` to ``NEARLY_ALL`` of the positives pass is taken.

Null and empty texts have all features zero and get the score of that.  Rows with
null ids are scored, never learned from; an id is a positive if all its labels are.
Repeated rows count, and give a row, each.  ``score`` and ``predicted`` replace columns
of those names; others are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import quality_rules
from tessera.llm import textbytes as tb
from tessera.llm.shared import Carried, cut, quoted

THRESHOLD = 0.7
#: Square roots of the frequencies of the ASCII bytes and all others, six ratios, and the trust in the frequencies.
N_FREQUENCIES = 129
N_FEATURES = N_FREQUENCIES + 6 + 1
#: Bytes of text at which frequencies are trusted by half.
HALF_TRUST = 8
DECAY = 1e-2
#: Partial sums that a task, or the driver, adds up.
FAN = 64
#: Shares of the positives between which thresholds are looked at for the prior, and bins of raw scores.
TOP, NEARLY_ALL, BINS, FARTHEST = 0.4, 0.99, 4096, 32.0


def features(text: pa.Array, hasher: tb.Hasher) -> np.ndarray:
    """A row of ``N_FEATURES`` numbers for each text."""
    data, offsets = tb.text_bytes(text)
    n, size = len(offsets) - 1, np.maximum(1, np.diff(offsets))
    m = quality_rules.measured(text, hasher)
    out = np.zeros((n, N_FEATURES), np.float32)
    counts = np.bincount(tb.owners(offsets) * N_FREQUENCIES + np.minimum(data, 128), minlength=n * N_FREQUENCIES).reshape(n, N_FREQUENCIES)
    out[:, :N_FREQUENCIES] = np.sqrt(counts / size[:, None])
    words, lines, chars = (np.maximum(1, m[k]) for k in ("n_words", "n_lines", "word_chars"))
    ratios = (m["n_symbols"] / words, m["n_dup_lines"] / lines, m["n_repeat_words"] / words, m["n_upper"] / chars, m["word_chars"] / words, m["n_lines"] / words)
    for k, x in enumerate(ratios):
        out[:, N_FREQUENCIES + k] = x
    out[:, -1] = size / (size + HALF_TRUST)
    return out


def standardised(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Centred and scaled features; frequencies of short texts are drawn towards the centre."""
    z = np.clip((x - centre) / scale, -8, 8)
    z[:, :N_FREQUENCIES] *= x[:, -1:]
    return z


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    #: Of the features, and the bias.
    weights: np.ndarray
    prior: float
    risk: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return standardised(x.astype(np.float64), self.centre, self.scale) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def table_of(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(x, positive, aside) of each row to learn from; a quarter of the ids is ``aside``."""
    seed = tb.draw()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tb.Hasher(seed)
        for batch in tb.slices(batches, "text"):
            x = features(batch.column("text"), hasher)
            cells = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 4 * N_FEATURES).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), cells], names=["id", "x"])

    learned = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    kind = learned.schema["id"].dataType.simpleString()
    x = learned.mapInArrow(tb.tidy(run), f"id {kind}, x binary")
    trusted = labels.where("quality is not null").groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").alias("least")).where("least = 1").select("of")
    joined = x.join(trusted, F.col("id") == F.col("of"), "left")
    return cut(joined.select("x", F.col("of").isNotNull().alias("positive"), (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("aside")))


def summed(table: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over a table's rows of the vectors that ``of(x, positive)`` gives for blocks of them.

    A task gives one partial sum.  Tasks add up ``FAN`` of them each, and ``FAN`` of those, until the driver is left with as many at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, N_FEATURES)
            if len(x):
                part = of(x.astype(np.float64), np.asarray(batch.column("positive")))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total = np.frombuffer(v) if total is None else total + np.frombuffer(v)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts, n = table.select("x", "positive").mapInArrow(tb.tidy(run), "v binary"), table.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(tb.tidy(add), "v binary")
    parts = parts.collect()
    return sum(np.frombuffer(r.v) for r in parts) if parts else None


def risk_terms(x: np.ndarray, positive: np.ndarray, centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows: losses of positives as such and as negatives, of all as negatives, and their derivatives by ``w``."""
    z = np.column_stack([standardised(x, centre, scale), np.ones(len(x))])
    g, p = z @ w, z[positive]
    s, sp = sigmoid(g), sigmoid(-g[positive])
    losses = [np.logaddexp(0, -g[positive]).sum(), np.logaddexp(0, g[positive]).sum(), np.logaddexp(0, g).sum()]
    slopes = [p.sum(0), p.T @ sp, z.T @ s]
    bends = [(p.T * (sp * (1 - sp))) @ p, (z.T * (s * (1 - s))) @ z]
    return np.concatenate([losses, *slopes, *(b.ravel() for b in bends)])


def minimise(table: DataFrame, counts: tuple[int, int], centre: np.ndarray, scale: np.ndarray, prior: float, w: np.ndarray, decay: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of the least non-negative risk, and that risk, from (positives, rows) in number.

    The risk is the greatest of A + mu * B for mu from 0 to 1, where B is the bracket
    and A the rest.  A pass over the table gives values and derivatives of both; the step
    is that to the least of their quadratic models for the mu at which the bracket's
    model is zero, or for 0 or 1 if there is none.
    """
    (n_p, n_u), k = counts, len(w)
    ridge = np.append(np.full(k - 1, decay), 0.0)

    def step_from(w: np.ndarray) -> tuple[float, np.ndarray]:
        sums = summed(table, lambda x, positive: risk_terms(x, positive, centre, scale, w))
        total, pulled, pushed = (sums[3 + i * k : 3 + (i + 1) * k] for i in range(3))
        bend_p, bend_u = (sums[3 + 3 * k + i * k * k :][: k * k].reshape(k, k) for i in range(2))
        bracket = sums[2] / n_u - prior * sums[1] / n_p
        slope_a, bend_a = -prior * pulled / n_p + ridge * w, prior * bend_p / n_p + np.diag(ridge + 1e-6)
        slope_b, bend_b = pushed / n_u - prior * (total - pulled) / n_p, bend_u / n_u - prior * bend_p / n_p

        def towards(mu: float) -> tuple[np.ndarray, float]:
            d = -np.linalg.solve(bend_a + mu * bend_b, slope_a + mu * slope_b)
            return d, bracket + slope_b @ d + 0.5 * d @ bend_b @ d

        lo, hi = 0.0, 1.0
        d, left = towards(hi)
        if left < 0:
            d, left = towards(lo)
            for _ in range(40 if left > 0 else 0):
                d, left = towards((lo + hi) / 2)
                lo, hi = ((lo + hi) / 2, hi) if left > 0 else (lo, (lo + hi) / 2)
        return prior * sums[0] / n_p + max(0.0, bracket) + 0.5 * (ridge * w * w).sum(), d

    risk, step = step_from(w)
    for _ in range(steps):
        new, after = step_from(w + step)
        if new < risk:
            gain, risk, w, step = risk - new, new, w + step, after
            if gain < 1e-8:
                break
        else:
            step = step / 4
            if np.abs(step).max() < 1e-6:
                break
    return w, float(risk)


def estimated_prior(table: DataFrame, model: Model) -> float:
    """The least ratio of the shares of all rows and of positives above a threshold."""

    def run(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) + FARTHEST) * (BINS / (2 * FARTHEST))).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at[positive], minlength=BINS), np.bincount(at, minlength=BINS)]).astype(float)

    above = summed(table, run)
    if above is None or not above[:BINS].sum():
        return 0.5
    p, u = (np.cumsum(h[::-1]) / h.sum() for h in (above[:BINS], above[BINS:]))
    use = (p >= TOP) & (p <= NEARLY_ALL)
    return float(np.clip((u[use] / p[use]).min() if use.any() else u[p >= TOP][0], 0.05, 0.95))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: float | None = None, decay: float = DECAY, steps: int = 16) -> Model:
    """Fit to the rows outside the held-out fold; ``labels`` has ``doc_id`` and ``quality``, of which 1 marks a trusted positive.

    Nothing is sampled.  ``steps`` bounds the passes over the table of features, two
    optimisations of as many when the prior is to be estimated.
    """
    table = table_of(docs, labels, doc_id, text)

    def moments(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        return np.concatenate([[positive.sum(), len(x)], x.sum(0), (x * x).sum(0)])

    sums = summed(table, moments)
    if sums is None or not sums[0]:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5, 0.0)
    n_p, n_u = int(sums[0]), int(sums[1])
    centre = sums[2 : 2 + N_FEATURES] / n_u
    scale = np.sqrt(np.maximum(0, sums[2 + N_FEATURES :] / n_u - centre**2)) + 1e-3
    w = np.zeros(N_FEATURES + 1)
    if prior is None:
        first, aside = table.where("not aside"), table.where("aside")
        some = summed(first, lambda x, positive: np.array([positive.sum(), len(x)], float))
        prior = 0.5
        if some is not None and some[0]:
            w, risk = minimise(first, (int(some[0]), int(some[1])), centre, scale, prior, w, decay, steps)
            prior = estimated_prior(aside, Model(centre, scale, w, prior, risk))
    w, risk = minimise(table, (n_p, n_u), centre, scale, prior, w, decay, steps)
    return Model(centre, scale, w, prior, risk)


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row."""
    carried, seed = Carried(docs, "score double, predicted int", text), tb.draw()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tb.Hasher(seed)
        for batch in tb.slices(batches, "text"):
            score = model.score(features(batch.column("text"), hasher))
            yield carried.batch(batch, [pa.array(score), pa.array(score >= threshold).cast(pa.int32())])

    return carried.unpack(carried.map(carried.pack(docs), run))
