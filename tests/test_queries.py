"""Every registered query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def catalog():
    from weft.plans import catalog

    return catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog().ORACLES))
def test_against_oracle(spark, duck, name):
    df = catalog().QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    out = duck.execute(catalog().ORACLES[name])
    names = [d[0] for d in out.description]
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in out.fetchall()), key=str)
    assert sorted(names) == columns and len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(abs(x - y) < 2e-6 if isinstance(x, float) and isinstance(y, float) and x != y else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())


def many_embeddings(folder, rows=3000, labels=3):
    """A table of embeddings with about 900 live rows in each cluster, some of them copies of others; its own DuckDB session."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(7).normal(size=(rows, 8)).astype(np.float32)
    x[1::50] = x[2::50]
    table = pa.table({"vec_id": pa.array(np.arange(rows)), "embedding": pa.array([v.tolist() for v in x], pa.list_(pa.float32())), "label": pa.array((np.arange(rows) // 7 % labels).astype(np.int32))})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    return con


def test_medoids_of_clusters_beyond_any_sample(spark, tmp_path):
    con = many_embeddings(tmp_path)
    mine = sorted(tuple(r) for r in catalog().QUERIES["medoids_radii"](spark, str(tmp_path)).select("cluster", "medoid", "radius").collect())
    theirs = sorted(con.execute(f"select cluster, medoid, radius from ({catalog().ORACLES['medoids_radii']})").fetchall())
    assert len(mine) == 3 and [r[:2] for r in mine] == [r[:2] for r in theirs]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(mine, theirs, strict=True))


def test_memberships_over_medoids_of_clusters_beyond_any_sample(spark, tmp_path):
    con = many_embeddings(tmp_path)
    mine = sorted(tuple(r) for r in catalog().QUERIES["hdbscan_soft_members"](spark, str(tmp_path)).select("id", "cluster", "probability").collect())
    theirs = sorted(con.execute(f"select id, cluster, probability from ({catalog().ORACLES['hdbscan_soft_members']})").fetchall())
    assert len(mine) == 300 and [r[:2] for r in mine] == [r[:2] for r in theirs]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(mine, theirs, strict=True))


def test_memberships_just_below_half_of_the_sixth_digit(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    members = [(9, 1, 0), (7, 0, 5), (9, 4, 1), (5, -6, 1), (9, 0, 3), (1, 9, 0), (0, 8, 7), (1, 9, 4), (-6, 7, 1), (0, 9, 3), (1, 0, 9), (5, 1, 7), (1, -6, 9), (2, 4, 9), (0, 3, 8)]
    noise = [(-113, 29, -33), (-108, 80, -42), (-105, -36, -113), (-75, 32, 82), (-54, 40, -21), (47, -113, -112), (60, 77, 92)]
    ids = [i * 10 + 1 for i in range(15)] + [i * 10 for i in range(7)]  # multiples of 10 are noise
    x = [[float(a) for a in v] for v in members + noise]
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(x, pa.list_(pa.float32())), "label": pa.array([i // 5 for i in range(15)] + [0] * 7, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    mine = sorted(tuple(r) for r in catalog().QUERIES["hdbscan_soft_members"](spark, str(tmp_path)).select("id", "probability", "cluster").collect())
    theirs = sorted(con.execute(f"select id, probability, cluster from ({catalog().ORACLES['hdbscan_soft_members']})").fetchall())
    assert mine == theirs and mine[0][1] == 0.936356  # 0.9363564999998686; rounded to 12 digits first, 0.936357
