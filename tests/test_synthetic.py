"""Synthetic collections are deterministic whatever the partitions; corruption 0 flags nothing."""

import numpy as np
import pytest

from weft.operators import analysis
from weft.sources import synthetic


def test_blobs_and_tags(spark):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(synthetic.blobs(spark, 20, dims=6)) == rows(synthetic.blobs(spark, 20, dims=6).repartition(3))
    tags = synthetic.tagged(spark, 80).collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in tags) and any(r["missing"] for r in tags)
    clean = synthetic.tagged(spark, 40, corruption=0.0).collect()
    assert not any(r[f] for r in clean for f in ("missing", "wrong", "general", "extra"))
    assert all(np.allclose(r["tag"], r["observed"]) for r in clean)


@pytest.mark.parametrize("name", sorted(synthetic.CASES))
def test_adversarial(spark, name):
    n, dims, *_ = synthetic.CASES[name]
    rows = synthetic.adversarial(spark, name).collect()
    x = np.array([r["x"] for r in rows])
    assert x.shape == (n, dims) and np.isfinite(x).all() and np.allclose(np.linalg.norm(x, axis=1), 1)
    if name == "duplicate_ties":
        assert len(np.unique(x.round(12), axis=0)) == n // 3


def test_names_and_colours(spark):
    df = spark.createDataFrame([("  a ", "f"), (None, "f"), (" ", "f")], "b string, f string")
    assert [r[0] for r in df.select(analysis.batch_name(df.b, df.f)).collect()] == ["a", "auto:f", None]
    table = analysis.colours(3, 2)
    assert len({c for _, _, c in table}) == 6 and all(len(c) == 7 for _, _, c in table)
