"""Fill-in-the-middle transformation of texts.

A text is cut into units by the classes of neighbouring characters: a unit ends where
``ENDS`` has true for the classes on both sides.  ``line`` units keep their newline, ``word`` units
the white space behind the word, and ``char`` units are code points.  Two ranks among the
n + 1 edges of the units, drawn by a digest of the document's id, part prefix, middle and
suffix, which are put in another order behind sentinels:

* ``psm``: prefix, suffix, middle; * ``spm``: suffix, prefix, middle;
* ``plain``: the text as it is, where it is empty, has a sentinel in it, or isn't drawn.

The draws are the first four 32-bit words of sha256 of ``seed:doc_id``; a null id counts as
an empty string, so that all rows of null ids and of one length are cut alike.  A null text counts as
empty.  Repeated rows give a row each.  Texts are decoded to UTF-32 half a megabyte at a
time, or one text.  Columns named like a result are replaced; others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.shared import Carried, quoted

#: Classes of code points: newline, other ASCII white space, any other; by unit, whether an edge lies between two classes.
NEWLINE, SPACE, OTHER = 0, 1, 2
ENDS = {
    "line": np.array([[True, True, True], [False, False, False], [False, False, False]]),
    "word": np.array([[False, False, True], [False, False, True], [False, False, False]]),
    "char": np.ones((3, 3), bool),
}
RESULTS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Recipe:
    """Per cent of texts that are transformed, per cent of these that become ``spm``, and the sentinels."""

    unit: str = "line"
    rate: int = 100
    spm_rate: int = 50
    seed: int = 7
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        if self.unit not in ENDS:
            raise ValueError(f"unit must be one of {', '.join(ENDS)}")
        for (i, a), (j, b) in product(enumerate(self.sentinels), repeat=2):
            # else a sentinel could be read across the edge of a piece, and the text not be rebuilt
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + 1) if i == j else len(b) + 1)):
                raise ValueError("sentinels must not be empty, hold or overlap one another")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def classes_of(points: np.ndarray) -> np.ndarray:
    kind = np.full(len(points), OTHER, np.int8)
    kind[(points == 0x20) | ((points >= 0x09) & (points <= 0x0D))] = SPACE
    kind[points == 0x0A] = NEWLINE
    return kind


def unit_edges(points: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit ends among the code points of all texts, and where each text's units begin in that list."""
    ends = np.zeros(len(points) + 1, bool)
    kind = classes_of(points)
    ends[1:-1] = ENDS[unit][kind[:-1], kind[1:]]
    ends[offsets] = True
    ends[0] = False
    places = np.flatnonzero(ends)
    return places, np.searchsorted(places, offsets, "right")


def transform(text: pa.Array, draws: np.ndarray, recipe: Recipe) -> list[pa.Array]:
    """Of each text its units, form, code points of prefix and middle, and the output."""
    data, offsets = tb.text_bytes(text)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begin = heads[offsets]
    places, first = unit_edges(points, begin, recipe.unit)
    n = np.diff(first)
    h1, h2, h3, h4 = draws.T.astype(np.int64)
    ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    # the edge of rank 0 is the text's start, that of rank k the end of its k-th unit
    cuts = np.where(ranks == 0, begin[:-1], np.append(places, 0)[first[:-1] + ranks - 1])
    marks = [m.encode() for m in recipe.sentinels]
    spans = [raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    clear = np.array([not any(m in s for m in marks) for s in spans], bool)
    moved = clear & (n > 0) & (h3 % 100 < recipe.rate)
    spm = h4 % 100 < recipe.spm_rate
    p, s, m = recipe.sentinels

    def piece(a: int, b: int) -> str:
        return points[a:b].tobytes().decode("utf-32-le")

    output = []
    for i, (a, x, y, b) in enumerate(zip(begin.tolist(), *cuts.tolist(), begin[1:].tolist(), strict=False)):
        if not moved[i]:
            output.append(spans[i].decode("utf-8"))
        elif spm[i]:
            output.append(f"{s}{piece(y, b)}{p}{piece(a, x)}{m}{piece(x, y)}")
        else:
            output.append(f"{p}{piece(a, x)}{s}{piece(y, b)}{m}{piece(x, y)}")
    form = np.where(moved, np.where(spm, "spm", "psm"), "plain")
    chars = (pa.array(c, pa.int64(), mask=~moved) for c in (cuts[0] - begin[:-1], cuts[1] - cuts[0]))
    return [pa.array(n), pa.array(form.tolist(), pa.string()), *chars, pa.array(output, pa.string())]


def fill_middle(docs: DataFrame, recipe: Recipe | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``output``."""
    recipe = recipe or Recipe()
    named = F.concat(F.lit(f"{recipe.seed}:"), F.coalesce(quoted(doc_id).cast("string"), F.lit("")))
    carried = Carried(docs, RESULTS, text)
    packed = carried.pack(docs, digest=F.unhex(F.substring(F.sha2(named, 256), 1, 32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text"):
            draws = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u4").reshape(-1, 4)
            yield carried.batch(batch, transform(batch.column("text"), draws, recipe))

    return carried.unpack(carried.map(packed, run))


def restored(output: Column, form: Column, recipe: Recipe | None = None) -> Column:
    """The text that an output of a form was made from."""
    recipe = recipe or Recipe()

    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, len(first) + 1, 2**31 - 1)
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, third, 1)
        return one, two, F.substr(rest, F.length(two) + len(third) + 1)

    p, s, m = recipe.sentinels
    prefix, suffix, middle = parts(p, s, m)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p, m)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
