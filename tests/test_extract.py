"""Metrics without a fit, feature files and whole fits."""

import numpy as np
import pytest

from weft.operators import extract, fcm, flows


def docs(spark, n=90, k=3, seed=5):
    rng = np.random.default_rng(seed)
    x = fcm.unit_rows(np.eye(8)[np.arange(n) % k] + rng.normal(0, 0.05, (n, 8)))
    return x, spark.createDataFrame([(i, f"c{i % k}", [f"t{i % k // 2}", f"c{i % k}"], [float(v) for v in r], i % k if i else -1) for i, r in enumerate(x)], "id long, class string, class_hierarchy array<string>, x array<double>, cluster long")


def test_metrics_without_memberships(spark):
    x, df = docs(spark)
    got = extract.extract_metrics(df, "here").first()
    assert (got["samples"], got["clusters"], got["source"], got["memberships_available"]) == (90, 3, "here", False)
    assert np.isclose(got["noise_ratio"], 1 / 90) and got["tag_fragmentation"] == 1 and got["nmi_leaf"] == got["nmi"] > 0.95
    assert got["nmi_top"] < got["nmi_subtopic"] and got["partition_coefficient"] is None
    u = np.eye(3)[np.arange(90) % 3]
    u[0] = 0
    v = fcm.unit_rows(u.T @ x)
    d2 = 2 - 2 * x @ v.T
    sep = min(((v[a] - v[b]) ** 2).sum() for a, b in ((0, 1), (0, 2), (1, 2)))
    assert np.isclose(got["xie_beni"], (u * d2).sum() / 90 / sep) and got["silhouette"] > 0.8
    bare = extract.extract_metrics(df.select("id", "cluster")).first()
    assert bare["nmi"] is None and bare["xie_beni"] is None and bare["samples"] == 90
    assert extract.extract_metrics(df.where("id < 0")).first()["samples"] == 0
    with pytest.raises(ValueError):
        extract.extract_metrics(df.drop("cluster"))


def test_memberships_from_columns(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 2.0), (2, 1, 0.0, 3.0)], "id long, cluster long, membership_0 double, membership_1 double")
    got = extract.extract_metrics(df).first()
    assert np.isclose(got["partition_coefficient"], 0.75) and np.isclose(got["modified_partition_coefficient"], 0.5) and got["membership_clusters"] == 2
    with pytest.raises(Exception, match="memberships"):
        extract.extract_metrics(spark.createDataFrame([(1, 0, -1.0, 2.0)], df.schema)).collect()


def test_feature_files(spark, tmp_path):
    x = np.arange(1, 31, dtype=float).reshape(10, 3)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", features=x)
    np.savez(tmp_path / "bad.npz", other=x)
    (tmp_path / "c.csv").write_text("a,b.b,c\n" + "\n".join(",".join(map(str, r)) for r in x))
    for name in ("a.npy", "b.npz", "c.csv"):
        got = extract.load_features(spark, f"file://{tmp_path}/{name}").orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(10)) and np.allclose([r["x"] for r in got], x)
    np.save(tmp_path / "zero.npy", np.zeros((2, 2)))
    for name in ("bad.npz", "zero.npy", "d.txt"):
        with pytest.raises(ValueError):
            extract.load_features(spark, f"file://{tmp_path}/{name}")


def test_positions_over_partitions(spark):
    got = extract.positions(spark.range(100, numPartitions=7)).collect()
    assert all(r["id"] == r["pos"] for r in got)


def test_flat_fit(spark):
    _, df = docs(spark)
    fit = flows.flat_fit(df, [2, 3, 4], width=4, n_init=2)
    found = extract.extract_metrics(fit.assign(df.drop("cluster"))).first()
    assert (fit.lane.k, fit.how, fit.width) == (3, "exhaustive", 4) and found["ari"] == 1.0
    one = flows.flat_fit(df.limit(3), [2], width=2, m=1.2, min_size=3)
    assert one.lane.k == 1 and one.how.startswith("single cluster")


def test_pipelines(spark):
    _, df = docs(spark)
    found, best = flows.run_pipelines(df.drop("cluster"), 3, n_init=2, widths=(4,))
    rows = {r["pipeline"]: r for r in found.collect()}
    assert set(rows) == set(flows.PIPELINES) and best in rows and rows["2_auto_pca_fcm"]["pca_components"] == 4
    assert all(r["nmi"] > 0.99 for r in rows.values())
    with pytest.raises(ValueError):
        flows.run_pipeline("other", df, 3)
