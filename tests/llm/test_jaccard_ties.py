import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard_join as jj
from tessera.llm import textbytes as tb


def pair(k, tag):
    """Texts of 4k and 5k shingles, of which the first's are all shared: a similarity of exactly 0.8."""
    words = [f"{tag}{i}" for i in range(5 * k + 4)]
    return " ".join(words[: 4 * k + 4]), " ".join(words)


def test_every_pair_at_exactly_the_threshold_is_linked():
    hasher = tb.Hasher(3)
    for k in range(1, 201):
        shared, size = jj.overlaps(pa.array(pair(k, "w")), hasher, 0)
        assert size.tolist() == [4 * k, 5 * k]
        assert jj.at_threshold(shared, size, size, 0.8)[0, 1]
        assert not jj.at_threshold(shared - 1, size, size, 0.8)[0, 1]


def test_counts_beyond_the_precision_of_floats():
    left = np.array([4 * 10**9])
    assert jj.at_threshold(np.array([[4 * 10**9]]), left, np.array([5 * 10**9]), 0.8)[0, 0]
    assert not jj.at_threshold(np.array([[4 * 10**9 - 1]]), left, np.array([5 * 10**9]), 0.8)[0, 0]


@pytest.mark.parametrize("ks", [range(1, 60)])
def test_ties_through_the_operator(spark, ks):
    rows = [(2 * k + side, text) for k in ks for side, text in enumerate(pair(k, f"p{k}x"))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {2 * k + side: (2 * k, 1) for k in ks for side in (0, 1)}
    assert jj.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == len(ks)
