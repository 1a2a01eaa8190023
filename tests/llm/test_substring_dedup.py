import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substring_dedup as sd

SCHEMA = "doc_id bigint, text string, KEPT string, k1 int, row string, marks int"


def brute(texts):
    """(n_words, n_removed, kept) of each text by all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    windows = Counter(tuple(w[i : i + sd.WINDOW]) for w in words for i in range(len(w) - sd.WINDOW + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - sd.WINDOW + 1):
            if windows[tuple(w[i : i + sd.WINDOW])] > 1:
                gone[i : i + sd.WINDOW] = [True] * sd.WINDOW
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def some_words(n, vocabulary):
    return " ".join(random.choice(vocabulary) for _ in range(n))


def texts():
    random.seed(8)
    words = [f"w{i}é" for i in range(50)]
    passage, other = some_words(90, words), some_words(35, words)
    out = [None, "", " \n\t", "one", passage, passage, "x " + passage + " y", other, other + " z", "a " + other.replace(" ", "\n\t ", 7), other.rsplit(" ", 1)[0]]
    out += ["a " * 34, "a " * 35, "b " * 36, "b " * 400, "c d " * 60, "c d e " * 60 + "f " + "c d e " * 30, some_words(4000, words), some_words(3000, ["p", "q"]), "\x00   " * 50]
    long = out[-3].split()
    out += [" ".join(long[700:2400]) + " tail", " ".join(long[:40] + long[2000:2034])]
    out += [some_words(random.randint(0, 60), words) + " " + " ".join(passage.split()[random.randint(0, 30) : random.randint(40, 90)]) + " " + some_words(random.randint(0, 60), words) for _ in range(60)]
    return out


@pytest.mark.parametrize("held", [200_000, 50])
def test_equals_all_windows(spark, monkeypatch, held):
    monkeypatch.setattr(sd, "HELD", held)
    data = texts()
    df = spark.createDataFrame([(i, t, "old", 4, "r", 9) for i, t in enumerate(data)], SCHEMA).repartition(5)
    out = sd.dedup(df)
    assert out.columns == ["doc_id", "text", "k1", "row", "marks", "n_words", "n_removed", "kept"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out.collect()}
    assert got == dict(enumerate(brute(data)))


def test_repeated_rows_null_ids_and_text_ids(spark):
    random.seed(2)
    a, b = some_words(50, list("abcdefgh")), some_words(80, list("abcdefgh"))
    rows = [("i", a), ("i", a), (None, b), (None, b + " z"), (None, None), ("k", some_words(40, list("stuv")))]
    got = sorted((str(r.doc_id), str(r.text), r.n_words, r.n_removed, r.kept) for r in sd.dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == sorted((str(i), str(t), *x) for (i, t), x in zip(rows, brute([t for _, t in rows]), strict=True))


def test_empty_table(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("size", [2, 3, 40])
def test_equal_windows_have_equal_anchors(size):
    random.seed(size)
    window = some_words(sd.WINDOW, [str(i) for i in range(size)])
    texts = [some_words(random.randint(0, 30), list("0123")) + " " + window + " " + some_words(random.randint(0, 30), list("0123")) for _ in range(40)]
    symbols, offsets = sd.Words(5).read(pa.array(texts))
    starts = np.array([offsets[i] + len(t.split(" " + window)[0].split()) for i, t in enumerate(texts)])
    level, at, end = sd.interior(symbols, offsets, starts, sd.WINDOW)
    assert len({(x, y - s, z - s) for x, y, z, s in zip(level, at, end, starts, strict=True)}) == 1
    assert (at - level >= starts).all() and (end + level <= starts + sd.WINDOW).all() or (level == 0).all()
