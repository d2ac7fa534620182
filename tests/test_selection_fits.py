"""Restarts until enough are valid, fast selection, consensus and other geometries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import fcm, training


def blobs(spark, n=240, k=3, spread=0.05, width=6, seed=1, raw=False):
    rng = np.random.default_rng(seed)
    x = np.eye(width)[np.arange(n) % k] + rng.normal(0, spread, (n, width))
    x = x * rng.uniform(0.5, 3, (n, 1)) if raw else fcm.unit_rows(x)
    return x, spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "id long, node long, x array<double>")


def test_attempts_go_on_until_enough_are_valid(spark, monkeypatch):
    _, docs = blobs(spark)
    made = []

    def fit(docs, lanes, *rest):
        for lane in lanes:
            made.append(lane.seed)
            ok = len(made) not in (1, 2, 4)  # the first, second and fourth attempt collapse
            lane.centers, lane.sizes = np.eye(2, 6) if ok else np.ones((2, 6)), np.array([120.0, 120.0])
        return lanes

    monkeypatch.setattr(training, "fit_lanes", fit)
    group = training.Attempts(0, 2, 1.2, 42)
    training.extend(docs, [group], 3, 2)
    assert made == [42 + 1009 * i for i in range(6)] and len(group.valid(2)) == 3
    never = training.Attempts(0, 2, 1.2, 7)
    monkeypatch.setattr(training, "fit_lanes", lambda docs, lanes, *rest: [setattr(x, "centers", np.ones((2, 6))) or x for x in lanes])
    training.extend(docs, [never], 2, 2)
    assert len(never.lanes) == 6 and not never.valid(2)
    with pytest.raises(ValueError):
        training.extend(docs, [never], 3, 2, 2)


def test_fewer_rows_than_centers(spark):
    _, docs = blobs(spark, 3)
    frame, _ = training.candidates(docs, [2, 5], n_init=2)
    rows = {r["k"]: r for r in frame.collect()}
    assert 5 not in rows or not rows[5]["valid"]
    assert training.select_k(docs.where("id < 0"), [2])[0] == {}


def test_fast_selection_finds_the_blobs(spark):
    x, docs = blobs(spark, 600)
    best, frame = training.fast_k(docs, [2, 3, 4, 5], training.FastPlan(sample=150))
    assert best.k == 3 and best.rows == 600
    assert {r["attempts"] >= 3 for r in frame.where("valid").collect()} == {True}
    labels = (x @ best.centers.T).argmax(1)
    assert training.adjusted_rand(labels, np.arange(600) % 3) == 1.0
    with pytest.raises(ValueError):
        training.FastPlan(ms=())


def test_consensus_fits_all_rows(spark):
    _, docs = blobs(spark, 300)
    best, votes, how = training.consensus_fit(docs, [2, 3, 4], n_init=2, max_iter=30)
    assert (best.k, best.rows, how) == (3, 300, "consensus") and votes[3] >= 3
    best, votes, how = training.consensus_fit(docs, [2, 3, 4], ratio=1.0, n_init=2, max_iter=30)
    assert (best.k, votes, how) == (3, {}, "direct")
    with pytest.raises(ValueError):
        training.consensus_k(docs, [2], scouts=4, needed=2)


def test_consensus_falls_back(spark, monkeypatch):
    _, docs = blobs(spark, 300)
    monkeypatch.setattr(training, "consensus_k", lambda *a, **b: (None, {2: 2, 3: 2}))
    best, votes, how = training.consensus_fit(docs, [2, 3, 4], n_init=2, max_iter=30)
    assert (best.k, how) == (3, "fallback") and votes == {2: 2, 3: 2}


@pytest.mark.parametrize("name", ["euclidean", "cosine_raw", "cosine_normalized"])
def test_geometries_select_k(spark, name):
    x, docs = blobs(spark, 240, raw=name != "euclidean")
    held, _ = training.select_k(docs, [2, 3, 4], n_init=2, geometry=name)
    assert held[0].k == 3
    space = fcm.GEOMETRIES[name]
    labels = space.distances(space.prepare(x), held[0].centers).argmin(1)
    assert training.adjusted_rand(labels, np.arange(240) % 3) == 1.0


def test_geometry_modes_agree(spark):
    _, docs = blobs(spark, 120, raw=True)
    small, wide = ([training.Lane(0, 3, 5, 1.4, geometry=g) for g in fcm.GEOMETRIES] for _ in range(2))
    training.fit_lanes(docs, small, 6)
    training.fit_lanes(docs, wide, 6, local_cells=0)
    for a, b in zip(small, wide, strict=True):
        assert np.allclose(a.centers, b.centers) and np.isclose(a.objective, b.objective)
