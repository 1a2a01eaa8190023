"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

They run inside ``mapInArrow`` tasks.  A task looks at half a megabyte of text at
a time (``slices``), so its memory does not depend on the size of a partition; a
single text needs about 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: An odd number that spreads bits.
BASE = U64(0x9E3779B97F4A7C15)
#: The field of the hashes of byte spans.
PRIME = U64((1 << 61) - 1)
LOW29, LOW30, LOW31, LOW32 = (U64((1 << n) - 1) for n in (29, 30, 31, 32))
#: Items that are worked on at a time, so that they stay in the processor's cache.
BLOCK = 1 << 15
SLICE_BYTES, SLICE_ROWS = 1 << 19, 1 << 15


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives freed memory back to the system when its task ends.

    Workers outlive tasks, and many of them share an executor's memory.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and each text's offset (one more than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    size = int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8, size) if size else np.zeros(0, np.uint8)
    return data[offsets[0] :], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text, or one row, and SLICE_ROWS rows at most."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            used = ends[at - 1] if at else 0
            to = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, used + limit, "right"))))
            yield batch.slice(at, to - at)
            at = to


def spans_of(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes within each text: starts, ends, and where each text's runs begin."""
    before, after = np.zeros_like(member), np.zeros_like(member)
    before[1:], after[:-1] = member[:-1], member[1:]
    edge = offsets[(offsets > 0) & (offsets < len(member))]
    before[edge] = False
    after[edge - 1] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    a1, b1 = a >> U64(31), b >> U64(31)
    a0, b0 = a & LOW31, b & LOW31
    middle = a1 * b0
    middle += a0 * b1
    a1 = a1 * b1
    a1 <<= U64(1)  # 2**62 is 2 modulo PRIME
    a1 += middle >> U64(30)
    middle &= LOW30
    middle <<= U64(31)
    a1 += middle
    a1 = reduced(a1, once=True)
    a0 = a0 * b0
    a1 += a0
    return reduced(a1)


def reduced(x: np.ndarray, once: bool = False) -> np.ndarray:
    """64-bit numbers modulo PRIME; only below ``2**61 + 8`` with ``once``."""
    high = x >> U64(61)
    x = x & PRIME
    x += high
    if not once:
        x -= PRIME * (x >= PRIME)
    return x


def draw() -> int:
    """The random choice of a job's hash functions, made on the driver and sent to its tasks."""
    return secrets.randbits(62)


class Hasher:
    """Hashes of byte spans: polynomials over the field of PRIME, by prefix sums.

    ``seed`` chooses the base and the value of each byte, so that two different spans
    of n bytes collide with a probability of n / 2**61 at most, whatever the spans are.
    """

    def __init__(self, seed: int) -> None:
        self.seed = seed
        random = np.random.default_rng(seed)
        self.base, *self.values = (int(x) for x in random.integers(1 << 40, int(PRIME), 257))
        self.values = np.array(self.values, U64)
        self.powers = self.inverse = self.quick_powers = self.quick_inverse = np.ones(1, U64)

    @staticmethod
    def _grown(powers: np.ndarray, base: int, n: int) -> np.ndarray:
        out = np.empty(n, U64)
        out[: len(powers)] = powers
        size = len(powers)
        while size < n:
            more = min(size, n - size)
            out[size : size + more] = times(out[:more], np.full(1, pow(base, size, int(PRIME)), U64))
            size += more
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers) <= n:
            size = max(n + 1, SLICE_BYTES + 1)
            self.powers = self._grown(self.powers, self.base, size)
            self.inverse = self._grown(self.inverse, pow(self.base, -1, int(PRIME)), size)
        sums = np.zeros(n + 1, U64)
        for at in range(0, n, BLOCK):
            terms = times(self.values[data[at : at + BLOCK]], self.powers[at : at + min(BLOCK, n - at)])
            high, low = np.cumsum(terms >> U64(32)), np.cumsum(terms & LOW32)
            sums[at + 1 : at + 1 + len(terms)] = reduced((high >> U64(29)) + ((high & LOW29) << U64(32)) + low + sums[at])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), U64)
        for at in range(0, len(starts), BLOCK):
            lo, hi = starts[at : at + BLOCK], ends[at : at + BLOCK]
            out[at : at + BLOCK] = mix(times(reduced(sums[hi] + (PRIME - sums[lo])), self.inverse[lo]))
        return out


    def quick(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes modulo 2**64, for uses that compare the bytes: structured texts can collide whatever the base is."""
        n = len(data)
        if len(self.quick_powers) <= n:
            size, base = max(n + 1, SLICE_BYTES + 1), self.base | 1
            self.quick_powers, self.quick_inverse = (np.full(size, b, U64) for b in (base, pow(base, -1, 1 << 64)))
            for powers in (self.quick_powers, self.quick_inverse):
                powers[0] = 1
                np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(n + 1, U64)
        for at in range(0, n, BLOCK):
            terms = self.values[data[at : at + BLOCK]]
            terms *= self.quick_powers[at : at + len(terms)]
            terms[:1] += sums[at : at + 1]
            np.cumsum(terms, out=sums[at + 1 : at + 1 + len(terms)])
        return mix((sums[ends] - sums[starts]) * self.quick_inverse[starts] + (ends - starts).astype(U64))


def same_bytes(data: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """True where the ``sizes`` bytes from ``starts`` on are those from ``others`` on."""
    out = np.ones(len(starts), bool)
    for i in np.flatnonzero(sizes > BLOCK):
        out[i] = np.array_equal(data[starts[i] : starts[i] + sizes[i]], data[others[i] : others[i] + sizes[i]])
    short = np.flatnonzero(sizes <= BLOCK)
    ends, at = np.cumsum(sizes[short]), 0
    while at < len(short):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * BLOCK, "right")))
        some = short[at:to]
        row = np.repeat(some, sizes[some])
        step = np.arange(len(row)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        out[row[data[starts[row] + step] != data[others[row] + step]]] = False
        at = to
    return out


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher) -> np.ndarray:
    """A number for each byte span, from 0 on: the same for spans of equal bytes and for no others.

    Spans of equal hashes are compared byte by byte; should two differ, another hash is tried.
    """
    sizes, hashes = ends - starts, hasher.quick(data, starts, ends)
    while True:
        order = np.argsort(hashes, kind="stable")
        a, b = order[:-1], order[1:]
        same = hashes[a] == hashes[b]
        a, b = a[same], b[same]
        if (sizes[a] == sizes[b]).all() and same_bytes(data, starts[a], starts[b], sizes[a]).all():
            numbers = np.zeros(len(starts), np.int64)
            numbers[order[1:]] = np.cumsum(~same)
            return numbers
        hashes = hasher.spans(hasher.sums(data), starts, ends)
        hasher = Hasher(hasher.seed + 1)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive hashes (one for each start; shorter by n - 1)."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, U64)
    for i in range(n):
        out = mix(out * BASE + hashes[i : i + size])
    return out


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text that each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's items."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def windows(word_offsets: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of ``n`` items that lie within one text."""
    ends = np.repeat(word_offsets[1:], np.diff(word_offsets))
    return np.flatnonzero(np.arange(len(ends)) + n <= ends)


def numbered_rows(rows: np.ndarray) -> np.ndarray:
    """A number for each row of integers, from 0 on: the same for equal rows and for no others."""
    keys = np.zeros(len(rows), U64)
    for column in rows.T:
        keys = mix(keys * BASE + column.astype(U64))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not (rows[order[1:][same]] == rows[order[:-1][same]]).all():
        return np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    numbers = np.zeros(len(rows), np.int64)
    numbers[order[1:]] = np.cumsum(~same)
    return numbers


def repeated(numbers: np.ndarray) -> np.ndarray:
    """True where the same number occurs at another place."""
    return np.bincount(numbers)[numbers] > 1 if len(numbers) else np.zeros(0, bool)


def later(numbers: np.ndarray) -> np.ndarray:
    """True where the same number occurs at an earlier place."""
    place = np.arange(len(numbers))
    first = np.zeros(int(numbers.max(initial=0)) + 1, np.int64)
    first[numbers[::-1]] = place[::-1]
    return first[numbers] != place


def covered(starts: np.ndarray, width: int | np.ndarray, size: int) -> np.ndarray:
    """True for items inside one of the runs that begin at ``starts``."""
    depth = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(np.minimum(starts + width, size), minlength=size + 1)[: size + 1]
    return np.cumsum(depth)[:size] > 0


ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
