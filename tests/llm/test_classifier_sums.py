"""Sums over a table of features are added up in rounds, whatever the number of its partitions."""

import numpy as np
import pytest

from tessera.llm import quality_classifier as qc


@pytest.mark.parametrize("partitions", [1, 3, 4, 17])
def test_sums_in_rounds(spark, monkeypatch, partitions):
    monkeypatch.setattr(qc, "FAN", 3)
    values = np.random.default_rng(1).normal(size=(50, qc.N_FEATURES)).astype(np.float32)
    rows = [(bytearray(x.tobytes()), i % 3 == 0) for i, x in enumerate(values)]
    table = spark.createDataFrame(rows, "x binary, positive boolean").repartition(partitions)
    got = qc.summed(table, lambda x, positive: np.append(x.sum(0), positive.sum()))
    assert np.allclose(got, np.append(values.astype(float).sum(0), 17))
    assert qc.summed(table.where("x is null"), lambda x, positive: x.sum(0)) is None
