"""Sources, caches, incremental state and streams."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import sources
from weft.operators import fcm, incremental as inc
from weft.streaming import State, daily_noise


def records(spark, tmp_path, wrap, zipped):
    rows = [{"class_hierarchy": [f"tag-{i}", "x"], "embedding": [i, i + 0.25, i + 0.5]} for i in range(6)]
    rows[1]["id"] = "own"
    path = tmp_path / ("r.json.gz" if zipped else "r.json")
    text = json.dumps({"records": rows} if wrap else rows)
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    return f"file://{path}"


@pytest.mark.parametrize(("wrap", "zipped"), [(False, False), (True, True)])
def test_json_records(spark, tmp_path, wrap, zipped):
    got = sources.read_json(spark, records(spark, tmp_path, wrap, zipped), start=1, limit=3).orderBy("pos").collect()
    assert [r["id"] for r in got] == ["own", "2", "3"] and got[0]["tag"] == "tag-1" and got[1]["embedding"] == [2.0, 2.25, 2.5]


def test_cache_round_trip(spark, tmp_path):
    df = sources.read_json(spark, records(spark, tmp_path, False, False))
    path = f"file://{tmp_path}/cache"
    assert sources.build_cache(df, path)["count"] == 6
    assert [r["pos"] for r in sources.read_cache(spark, path, 2, 2, verify=True).orderBy("pos").collect()] == [2, 3]
    with pytest.raises(Exception):
        sources.build_cache(df, path)
    with pytest.raises(ValueError):
        sources.validate(df.withColumn("id", F.lit("same")))


def test_samples_are_nested(spark):
    df = spark.range(200)
    big = {r["id"] for r in sources.exact_sample(df, 50, 1).collect()}
    small = {r["id"] for r in sources.exact_sample(df, 20, 1).collect()}
    assert len(big) == 50 and small < big


def test_text_and_hierarchy(spark):
    df = spark.createDataFrame([("['a', 'b']",), ('["a", "b"]',)], "h string")
    assert all(r[0] == ["a", "b"] for r in df.select(sources.parse_hierarchy(F.col("h"))).collect())
    cut = spark.range(1).select(sources.embedding_text(F.lit("A"), F.lit("word " * 10), 12)).first()[0]
    assert cut == "A. word word"[:12].rsplit(" ", 1)[0]


def test_delta_equals_recomputation(spark):
    rng = np.random.default_rng(3)
    x = fcm.unit_rows(rng.normal(size=(40, 3)))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    contrib = inc.contributions(fcm.e_step(df, x[:2], 2.0), 2.0)
    held = contrib.where("id < 30")
    delta = inc.apply_delta(inc.statistics(held), held.where("id < 10"), contrib.where("id >= 30"))
    whole = inc.statistics(contrib.where("id >= 10"))
    a, b = ({(r["k"], r["dim"]): (r["value"], r["weight"]) for r in s.collect()} for s in (delta, whole))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_update_replay_and_conflict(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 0.15, (40, 4))
    x[:20, 0] += 3
    x[20:, 0] -= 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(fcm.unit_rows(x))], "id long, x array<double>")
    state = State(spark, f"file://{tmp_path}/state", policy=inc.DriftPolicy(min_samples=2))
    with pytest.raises(ValueError):
        state.update(df)
    state.fit(df.where("id < 30").withColumn("pos", F.col("id")), fcm.unit_rows(x[[0, 25]]))
    batch = df.where("id >= 25")
    first, again = state.update(batch, "b"), state.update(batch, "b")
    assert (first.generation, first.rows, first.replay, again.generation, again.replay) == (1, 15, False, 1, True)
    rows = state.rows()
    assert rows.count() == 40 and rows.select("pos").distinct().count() == 40
    assert rows.where("id = 27").first()["pos"] == 27
    with pytest.raises(ValueError, match="different content"):
        state.update(batch.where("id > 30"), "b")


def test_stream_maintains_the_state(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = fcm.unit_rows(rng.normal(size=(30, 4)))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    state = State(spark, f"file://{tmp_path}/state", policy=inc.DriftPolicy(enter=1.0))
    state.fit(df.where("id < 10").select("id", F.col("embedding").alias("x"), F.col("id").alias("pos")), x[:2])
    df.where("id >= 5").write.parquet(f"{tmp_path}/in")
    query = state.start(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/offsets")
    query.awaitTermination()
    assert state.rows().count() == 30 and state.manifest()["generation"] == 1


def test_daily_noise_stream(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, d, 12), t) for d in (1, 1, 2, 5) for t in ("error", "ok")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(f"{tmp_path}/events")
    stream = daily_noise(spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/events"))
    stream.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["noise"], r["n"]) for r in spark.table("days").collect()) == [(1.0, 2), (1.0, 2), (2.0, 4)]


def sides(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.1, (n, 4))
    x[: n // 2, 0] += 3
    x[n // 2 :, 1] += 3
    x = fcm.unit_rows(x)
    return x, spark.createDataFrame([(i, i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, pos long, x array<double>")


def test_stored_sums_are_those_of_all_rows(spark, tmp_path):
    x, df = sides(spark)
    state = State(spark, f"file://{tmp_path}/state", refresh_every=2, policy=inc.DriftPolicy(enter=1.0))
    state.fit(df.where("id < 50 and id >= 5"), fcm.unit_rows(x[[6, 40]]))
    moved = spark.createDataFrame([(i, [float(v) for v in x[59 - i]]) for i in range(10)], "id long, x array<double>")
    for k, batch in enumerate((df.where("id >= 45").select("id", "x"), moved, df.where("id < 5").select("id", "x"))):
        done = state.update(batch, f"b{k}")
        assert done.replaced + done.appended == done.rows and done.clusters == 2
        held = state.manifest()
        again = inc.statistics(inc.contributions(state.rows(), state.m))
        a, b = ({(r["k"], r["dim"]): (r["value"], r["weight"]) for r in s.collect()} for s in (again, state._open(held["sums"])))
        assert a.keys() == b.keys() and all(np.allclose(a[key], b[key], atol=1e-9) for key in a)
        assert np.allclose(state._centers(again, np.array(held["centers"])), held["centers"])
    assert state.rows().count() == 60 and state._generations() == [2, 3]
    assert state._read(2)["thresholds"] != [1.3, 1.3]


def test_worse_index_asks_for_new_centers(spark, tmp_path):
    x, df = sides(spark)
    state = State(spark, f"file://{tmp_path}/state", refresh_every=1, policy=inc.DriftPolicy(enter=1.0, cooldown=2), ks=[2, 3])
    state.fit(df)
    assert len(state.manifest()["centers"]) == 2
    third = spark.createDataFrame([(100 + i, [0.0, 0.0, 1.0, 0.02 * (i % 5)]) for i in range(30)], "id long, x array<double>")
    first = state.update(third, "third")
    assert first.xb_degraded and first.recluster and first.clusters == 3 and state.manifest()["cool"] == 2
    blur = spark.createDataFrame([(200 + i, [1.0, 1.0, 1.0, 0.0]) for i in range(60)], "id long, x array<double>")
    second = state.update(blur, "blur")
    assert second.xb_degraded and second.suppressed and not second.recluster


def test_manifest_is_checked(spark, tmp_path):
    x, df = sides(spark)
    state = State(spark, f"file://{tmp_path}/state")
    state.fit(df, fcm.unit_rows(x[[0, 40]]))
    with pytest.raises(RuntimeError, match="another process"):
        state.fit(df, fcm.unit_rows(x[[0, 40]]))
    file = next((tmp_path / "state/manifests/gen=0").glob("part-*"))
    file.write_text(file.read_text().replace('"updates": 0', '"updates": 5'))
    for crc in (tmp_path / "state/manifests/gen=0").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="checksum"):
        state.manifest()
