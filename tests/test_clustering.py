"""Operators against literal values and numpy kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import vectors as V
from weft.operators import classify, density, fcm, incremental as inc, metrics, neighbors, pca, selection, soft, training


def blobs(spark, seed=9, n=40, dims=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.15, (2 * n, dims))
    x[:n, 0] += 3
    x[n:, 0] -= 3
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")


def test_document_types(spark):
    rows = [(0, [0.35, 0.33, 0.32], 1.7), (1, [0.35, 0.33, 0.32], 0.6), (2, [0.38, 0.32, 0.30], 1.7), (3, [0.48, 0.46, 0.06], 1.7), (4, [0.81, 0.12, 0.07], 0.2), (5, [0.25], 3.0)]
    df = spark.createDataFrame(rows, "id long, u array<double>, d double")
    got = [r[0] for r in df.orderBy("id").select(classify.document_type(F.col("d"), F.lit(1.0))).collect()]
    assert got == ["noise", "boundary", "core", "core", "core", "core"]


def test_exact_matches_and_ties_share(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, x array<double>")
    eye = fcm.e_step(df, np.eye(2), 2.0).orderBy("id").collect()
    assert [r["u"] for r in eye] == [[1.0, 0.0], [0.0, 1.0]]
    twin = fcm.e_step(df.where("id = 0"), np.array([[1.0, 0.0], [1.0, 0.0]]), 2.0).first()
    assert twin["u"] == [0.5, 0.5]
    sql = df.select(V.memberships(F.array(V.squared_chord("x", V.literal([1.0, 0.0])), V.squared_chord("x", V.literal([1.0, 0.0]))), 2.0).alias("u")).collect()
    assert sql[0]["u"] == [0.5, 0.5]


def test_expression_and_kernel_agree(spark):
    x, df = blobs(spark)
    centers = fcm.unit_rows(x[[0, 50, 7]])
    d2 = F.array(*[V.squared_chord(V.unit("x"), V.literal(c)) for c in centers])
    got = fcm.e_step(df, centers, 1.4).withColumn("e", V.memberships(d2, 1.4)).select("u", "e").collect()
    assert np.allclose([r["u"] for r in got], [r["e"] for r in got])


def test_zero_vector_raises(spark):
    with pytest.raises(Exception, match="length zero"):
        spark.createDataFrame([([0.0, 0.0],)], "x array<double>").select(V.unit("x")).collect()


def test_euclidean_centers_are_weighted_means():
    x = np.array([[0, 0], [2, 0], [0, 3.0]])
    u = np.array([[0.8, 0.2], [0.5, 0.5], [0.1, 0.9]])
    w = u**2
    assert np.allclose(fcm.Euclidean().centers(w.T @ x, w.sum(0)), (w.T @ x) / w.sum(0)[:, None])


def test_partition_metrics(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],)], "u array<double>")
    pc, mpc, pe = df.agg(metrics.partition_coefficient(), metrics.modified_partition_coefficient(2), metrics.partition_entropy()).first()
    assert (pc, mpc) == (0.75, 0.5) and abs(pe - np.log(2) / 2) < 1e-9


def test_external_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "t long, p long")
    got = metrics.external_metrics(metrics.contingency(df, "t", "p")).first()
    assert abs(got["ari"] - training.adjusted_rand(a, b)) < 1e-9
    same = metrics.external_metrics(metrics.contingency(df, "t", "t")).first()
    assert abs(same["nmi"] - 1) < 1e-9 and abs(same["ari"] - 1) < 1e-9


def test_silhouette_matches_numpy(spark):
    x, df = blobs(spark, n=15)
    labels = np.arange(30) // 15
    got = {r["id"]: r["s"] for r in metrics.silhouette(df.withColumn("cluster", (F.col("id") / 15).cast("long")), block=7).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(30):
        own = d[i, (labels == labels[i]) & (np.arange(30) != i)].mean()
        other = d[i, labels != labels[i]].mean()
        assert abs(got[i] - (other - own) / max(own, other)) < 1e-9


def test_forced_noise_ties(spark):
    df = spark.createDataFrame([(f"doc-{i:03d}", 0.0) for i in range(199, -1, -1)], "id string, noise_score double")
    assert sorted(r["id"] for r in classify.forced_noise(df, 0.01).where("is_forced_noise").collect()) == ["doc-000", "doc-001"]
    ranked = spark.createDataFrame([(f"doc-{i:03d}", i / 199) for i in range(200)], "id string, noise_score double")
    assert sorted(r["id"] for r in classify.forced_noise(ranked, 0.01).where("is_forced_noise").collect()) == ["doc-198", "doc-199"]


def test_assignments(spark):
    df = spark.createDataFrame([(0, 0, 1, False, False), (1, 1, -1, True, False), (2, 0, -1, False, True)], "id long, a long, b long, is_natural_noise boolean, is_forced_noise boolean")
    got = classify.assignments(df, ["a", "b"]).orderBy("id").collect()
    assert [r["cluster"] for r in got] == [1, -1, -1]
    assert [r["cluster_path"] for r in got] == ["0/1", "1/noise", "0/noise"]
    assert [r["leaf_level"] for r in got] == [2, 1, 1]


def test_knees(spark):
    curve = spark.createDataFrame([(8, 0.50), (16, 0.54), (24, 0.70), (32, 0.78)], "dim long, preservation double")
    assert selection.plateau(curve, 0.05).first()["dim"] == 8
    assert selection.global_knee(curve).first()["dim"] == 24
    votes = spark.createDataFrame([(1, 4), (2, 4), (3, 5)], "scout long, k long")
    assert selection.consensus(votes).count() == 0


def test_drift_fixtures(spark):
    def run(rows, **policy):
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "batch long, noise double, n double")
        return inc.drift(df, inc.DriftPolicy(**policy)).collect()

    held = run([(4, 5), (4, 5), (0, 10), (0, 10)], enter=0.5, release=0.2, alpha=0.5, min_samples=10)
    assert [r["evaluated"] for r in held] == [False, True, True, True]
    assert [r["alarm"] for r in held] == [False, True, True, False]
    smooth = run([(2, 20), (6, 20), (12, 20), (16, 20)], enter=0.5, release=0.2, alpha=0.5, min_samples=10)
    assert np.allclose([r["ewma"] for r in smooth], [0.1, 0.2, 0.4, 0.6])
    assert [r["alarm"] for r in smooth] == [False, False, False, True]
    cool = run([(10, 10)] * 4, enter=0.5, min_samples=10, cooldown=2)
    assert [r["recluster"] for r in cool] == [True, False, False, True]


def test_planted_clusters_and_hierarchy(spark):
    x, df = blobs(spark)
    df = df.withColumn("node", F.lit(0).cast("long"))
    held, frame = training.select_k(df, [2, 3], n_init=2, max_iter=30)
    assert held[0].k == 2
    labels = fcm.e_step(df, held[0].centers, 1.2).orderBy("id").select("cluster").toPandas()["cluster"].to_numpy()
    assert training.adjusted_rand(labels, np.arange(80) // 40) == 1.0
    nodes, state = training.fit_hierarchy(df, [2], 2, min_node=60, n_init=2, max_iter=30)
    assert set(nodes) == {""} and state.where("level_1 >= 0").count() == 80
    assert training.assign_hierarchy(df, nodes).where("level_1 >= 0").count() == 80


def test_projection_matches_numpy(spark):
    x, df = blobs(spark)
    p = pca.fit(df, 2)
    u = fcm.unit_rows(x)
    values = np.linalg.svd(u - u.mean(0), compute_uv=False) ** 2
    assert np.allclose(p.ratios, (values / values.sum())[:2])
    assert pca.project(df, p).agg(F.max("support")).first()[0] <= 1


def test_linkage_cut_and_match():
    centers = fcm.unit_rows(np.array([[1, 0], [0.99, 0.01], [0, 1], [0.01, 0.99]]))
    steps = density.linkage(centers, np.ones(4))
    assert {steps[0].left, steps[0].right} == {0, 1} and density.cut(steps, 4, 2) == [0, 0, 1, 1]
    assert density.lift(np.array([0, 1, -1]), [1, 0]).tolist() == [1, 0, -1]
    cost = np.array([[4, 1, 3], [2, 0, 5], [3, 2, 2.0]])
    assert sum(cost[r, c] for r, c in density.match(cost)) == 5


def test_stability_counts_all_rows(spark):
    x = fcm.unit_rows(np.random.default_rng(2).normal(0, 1, (training.SEED_ROWS + 2000, 4)))
    docs = spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "id long, node long, x array<double>").repartition(3)
    frame, _ = training.candidates(docs, [3], n_init=3, max_iter=3)
    lanes = training.fit_lanes(docs, [training.Lane(0, 3, 42 + 1009 * 3 + 1009 * i, 1.2) for i in range(3)], 3)
    labels = [(x @ v.centers.T).argmax(1) for v in lanes]
    pairs = [training.adjusted_rand(labels[i], labels[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    assert max(pairs) < 0.99 and abs(frame.first()["stability"] - np.mean(pairs)) < 1e-9
    assert training.stability(docs, [lanes[:1], []]) == [0.0, 0.0]


def test_auto_pca_width_asks_all_rows(spark, tmp_path):
    from weft.plans import models

    x = np.random.default_rng(4).normal(0, 1, (500, 40)).astype(np.float32)
    spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["dim"]: r["preservation"] for r in models.auto_pca_width(spark, str(tmp_path)).collect()}
    unit = fcm.unit_rows(x.astype(float))
    y = (unit - unit.mean(0)) @ np.linalg.svd(unit - unit.mean(0))[2][:32].T

    def near(z):
        d = -fcm.unit_rows(z) @ fcm.unit_rows(z).T
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, 1)[:, :15]

    assert abs(got[32] - np.mean([np.isin(a, b).mean() for a, b in zip(near(unit), near(y), strict=True)])) < 1e-3


def test_neighbors_of_equal_rows(spark):
    x = np.repeat(np.eye(4), 50, 0)
    df = spark.createDataFrame([(i * 7 % 200, [float(v) for v in x[i * 7 % 200]]) for i in range(200)], "id long, x array<double>").repartition(3)
    got = {(r["id"], r["rank"]): r["neighbor"] for r in neighbors.knn(df, df, 3, block=64, stripe=5).collect()}
    assert got == {(i, r + 1): [j for j in range(i // 50 * 50, i // 50 * 50 + 4) if j != i][r] for i in range(200) for r in range(3)}


def test_spanning_tree_in_tasks(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.2, (400, 3)) for c in (0, 2, 5)] + [np.ones((60, 3)), rng.uniform(-2, 7, (140, 3))])
    near, far = density.spanning_tree(spark, x, 5), density.mutual_reachability_tree(x, 5)
    assert len(near) == len(x) - 1 and np.allclose(near[:, 2], far[:, 2], atol=1e-6)
    assert (density.hdbscan(x, 10, 5, spark=spark) == density.hdbscan(x, 10, 5)).mean() > 0.99
    assert density.spanning_tree(spark, x[:2], 5).shape == (1, 3)


def test_hdbscan_fit_labels_all_rows(spark, tmp_path):
    from weft.plans import models

    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.05, (3100, 12)) + np.eye(12)[b] for b in range(2)])
    spark.createDataFrame([(i, i // 3100, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r["cluster"] for r in models.hdbscan_fit(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(6200))
    sides = [{got[i] for i in range(a, a + 3100)} - {-1} for a in (0, 3100)]
    assert all(sides) and not sides[0] & sides[1]


def test_hdbscan_blobs():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.05, (30, 2)), rng.normal(3, 0.05, (30, 2)), [[12, -9]]])
    labels = density.hdbscan(x, 8, 4)
    assert training.adjusted_rand(labels[:60], np.arange(60) // 30) == 1.0 and labels[60] == -1


def test_tag_concat(spark):
    content = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0])], "k string, x array<double>")
    tags = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "k string, x array<double>")
    got = {r["k"]: r["x"] for r in soft.concat_tags(content, tags, "k", 2.0).collect()}
    assert np.allclose(got["a"], [0.6, 0.8, 2, 0]) and np.allclose(got["b"], [0, 1, 2**0.5, 2**0.5])
    with pytest.raises(ValueError):
        soft.concat_tags(content, tags, "k", 0)


def test_both_training_modes_agree(spark):
    _, df = blobs(spark)
    df = df.withColumn("node", F.lit(0).cast("long"))
    one = training.fit_lanes(df, [training.Lane(0, 2, 7, 1.2), training.Lane(0, 3, 8, 1.4)], 8)
    all_ = training.fit_lanes(df, [training.Lane(0, 2, 7, 1.2), training.Lane(0, 3, 8, 1.4)], 8, local_cells=0)
    for a, b in zip(one, all_, strict=True):
        assert np.allclose(a.centers, b.centers) and np.allclose([a.objective, a.pc, a.proxy], [b.objective, b.pc, b.proxy]) and a.iterations == b.iterations
