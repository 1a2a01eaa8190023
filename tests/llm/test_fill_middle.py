import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import fill_middle as fm

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x09-\x0D\x20]+(?=[^\x09-\x0D\x20])|[\x09-\x0D\x20]+$|[^\x09-\x0D\x20]+[\x09-\x0D\x20]*", "char": r"(?s)."}
TEXTS = [None, "", "\n", "\n\n", "one", "one\n", "a\nb\nc", "é\n\n日本\n😀x\n", "has <P> in it\nx", "<S", "<M>", "P>\n<\n", "long line " * 9000 + "\n" + "z\n" * 5000]


def brute(doc_id, text, recipe):
    """(n, form, prefix, middle, output) by a regular expression."""
    text = text or ""
    units = re.findall(UNITS[recipe.unit], text)
    digest = hashlib.sha256(f"{recipe.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in recipe.sentinels) or h[2] % 100 >= recipe.rate:
        return n, "plain", None, None, text
    a, b, c = recipe.sentinels
    if h[3] % 100 < recipe.spm_rate:
        return n, "spm", len(p), len(m), b + s + a + p + c + m
    return n, "psm", len(p), len(m), a + p + b + s + c + m


@pytest.mark.parametrize("recipe", [fm.Recipe(), fm.Recipe("word", 70, 20, 3, "[[a", "[[b", "[[c"), fm.Recipe("char", 100, 0)])
def test_equals_brute_force_and_is_restored(spark, recipe):
    rows = [(i, t, "x", 1, "k") for i, t in enumerate(TEXTS * 4)] + [(None, "a\nb", None, 2, None), (3, "one\n", "y", 3, "k"), (3, "one\n", "y", 3, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, FORM string, row int, digest string").repartition(3)
    out = fm.fill_middle(df, recipe).withColumn("back", fm.restored(F.col("output"), F.col("form"), recipe))
    assert out.columns == ["doc_id", "text", "row", "digest", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = sorted((str(r.doc_id), str(r.text), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect())
    assert [x[:2] + brute(r[0], r[1], recipe) + (r[1] or "",) for x, r in zip(got, sorted(rows, key=lambda r: (str(r[0]), str(r[1]))), strict=True)] == got


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab \n\t\rxé😀<PSM>", max_size=40), st.sampled_from(list(UNITS)))
def test_units(text, unit):
    import numpy as np

    points = np.array([ord(c) for c in text], np.uint32)
    places, first = fm.unit_edges(points, np.array([0, len(text)]), unit)
    assert [text[a:b] for a, b in zip([0, *places], places, strict=False)] == re.findall(UNITS[unit], text)
    assert first.tolist() == [0, len(places)]


def test_bad_recipes_and_empty_table(spark):
    for bad in ({"unit": "page"}, {"prefix": ""}, {"prefix": "<S>x"}, {"prefix": "abca"}, {"prefix": "M>z"}):
        with pytest.raises(ValueError):
            fm.Recipe(**bad)
    assert fm.fill_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
