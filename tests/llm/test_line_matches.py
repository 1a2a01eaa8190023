"""Matches of fingerprints: extended both ways, and what a fingerprint's first position does not settle."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_pipeline import brute_lines
from tessera.llm import line_dedup


def removed(spark, docs, parts=3):
    return {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)).collect()}


def line(tag, n=7):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_one_line_in_three_surroundings(spark):
    """A common line whose first position stands elsewhere: the second and third share a run that the first lacks."""
    common = line("common")
    docs = [
        (1, "\n".join([line("a"), line("b"), common, line("c"), line("d")])),
        (2, "\n".join([line("e"), line("f"), common, line("g"), line("h")])),
        (3, "\n".join([line("x"), line("f"), common, line("g"), line("y")])),
        (4, "\n".join([line("b"), common, line("c"), line("z"), line("f"), common, line("g")])),
    ]
    got = removed(spark, docs)
    assert got == brute_lines(docs, line_dedup.MIN_WORDS)
    assert got[3] == "\n".join([line("x"), line("y")])
    assert got[4] == line("z")


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("sizes", "blank"), [([1, 2, 5, 9, 21], []), ([1, 2, 5, 9, 19], ["", "  "])])
def test_random_documents_of_few_lines(spark, seed, sizes, blank):
    rng = random.Random(seed)
    lines = [line(f"l{k}_", rng.choice(sizes)) for k in range(12)] + blank
    docs = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25)))) for d in range(60)]
    assert removed(spark, docs) == brute_lines(docs, line_dedup.MIN_WORDS)


def test_a_blank_line_between_two_runs_stays(spark):
    long = [line("a", 21), line("b", 21)]
    docs = [(k, "\n  \n".join(long)) for k in (1, 2)]
    assert removed(spark, docs) == {1: docs[0][1], 2: "  "}


def test_extension_stops_at_the_first_difference_and_at_the_ends():
    kind = pa.list_(line_dedup.LINE)

    def around(hashes):
        return pa.array([[{"hash": h, "more": -h, "words": 1, "number": i} for i, h in enumerate(row)] for row in hashes], kind)

    own = line_dedup.Surroundings(around([[1, 2, 3, 4, 5], [7, 8, 9], [4]]), pa.array([2, 0, 0]))
    other = line_dedup.Surroundings(around([[9, 2, 3, 4, 6, 7], [7, 8], [4]]), pa.array([2, 0, 0]))
    assert own.extended(other, -1).tolist() == [1, 0, 0]
    assert own.extended(other, 1).tolist() == [1, 1, 0]
    assert np.array_equal(own.equal(own.at, other, other.at), [True, True, True])


def test_a_common_line_in_most_rows(spark):
    rows = [(k, "\n".join([line(f"p{k % 40}_"), line("common", 8), line(f"q{k % 25}_", 8)])) for k in range(400)]
    assert removed(spark, rows) == brute_lines(rows, line_dedup.MIN_WORDS)
