"""Queries that fit models: their rows follow from iterations, so they have no SQL form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators import density, fcm, flows, pca, training
from ..session import materialize, scratch_dir
from . import tables as T

QUERIES: dict = {}
KS = [2, 3, 4, 5]


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark, sf_dir) -> DataFrame:
    return T.embeddings(spark, sf_dir).withColumn("node", F.lit(0).cast("long"))


def _lane(spark, lane) -> DataFrame:
    return spark.createDataFrame([(lane.k, lane.m, lane.iterations, float(lane.objective), float(lane.separation), int(lane.rows))], "k long, m double, iterations long, objective double, separation double, rows long")


@_query
def sfcm_fit(spark, sf_dir):
    """Best of three fits with ten centers."""
    lanes = training.fit_lanes(_docs(spark, sf_dir), [training.Lane(0, 10, 42 + 1009 * i, 1.2) for i in range(3)])
    return _lane(spark, training.best_of(lanes, 2))


@_query
def select_k_exhaustive(spark, sf_dir):
    held, frame = training.select_k(_docs(spark, sf_dir), KS, n_init=2)
    chosen = held[0].k if 0 in held else -1
    return frame.withColumn("selected", F.col("k") == chosen)


@_query
def select_k_fast(spark, sf_dir):
    """K by scouts on a sample, refined on all rows."""
    best, frame = training.fast_k(_docs(spark, sf_dir), KS)
    k, m = (best.k, best.m) if best else (-1, 0.0)
    return frame.select("k", "xb", "stability", "objective", "valid_restarts", "attempts").withColumn("selected", F.col("k") == k).withColumn("m", F.lit(m))


@_query
def select_k_consensus(spark, sf_dir):
    """The votes of the scouts, and the K of the fit on all rows."""
    best, votes, how = training.consensus_fit(_docs(spark, sf_dir), KS, n_init=2, max_iter=30)
    k = best.k if best else -1
    return spark.createDataFrame([(a, votes.get(a, 0), a == k, how) for a in sorted({*votes, k})], "k long, votes long, selected boolean, how string")


@_query
def select_k_geometry(spark, sf_dir):
    """K in two other geometries."""
    parts = []
    for name in ("euclidean", "cosine_raw"):
        held, frame = training.select_k(_docs(spark, sf_dir), KS, n_init=2, max_iter=30, geometry=name)
        chosen = held[0].k if 0 in held else -1
        parts.append(frame.withColumn("geometry", F.lit(name)).withColumn("selected", F.col("k") == chosen))
    return parts[0].unionByName(parts[1])


@_query
def stable_fuzzifier(spark, sf_dir):
    return spark.createDataFrame([(training.stable_fuzzifier(_docs(spark, sf_dir)),)], "m double")


@_query
def hierarchical_fit(spark, sf_dir):
    _, state = training.fit_hierarchy(_docs(spark, sf_dir), [2, 3], 2, n_init=2, max_iter=30)
    return state.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("is_natural_noise").cast("long")).alias("noise"))


@_query
def pca_project(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    return pca.project(docs, pca.fit(docs, 16)).select("id", F.round("support", 6).alias("support"), F.size("projected").alias("dims"))


@_query
def auto_pca_width(spark, sf_dir):
    width, curve = pca.choose_width(T.embeddings(spark, sf_dir), [32, 64])
    return curve.withColumn("selected", F.col("dim") == width)


def _updated(spark, sf_dir):
    """A state fitted without a tenth of the rows and updated with them and with rows that changed, twice."""
    import uuid

    from ..operators import incremental as inc
    from ..streaming import State

    docs = T.embeddings(spark, sf_dir)
    split = materialize(inc.held_out_split(docs, 0.2))
    initial, batch = split.where("operation = 'initial'"), split.where("operation <> 'initial'").select("id", "x")
    _, centers = fcm.label_centers(initial)
    state = State(spark, f"{scratch_dir(spark)}/weft-state-{uuid.uuid4().hex}")
    state.fit(initial.select("id", "x", F.col("id").alias("pos")), centers)
    return state, [state.update(batch, "b1"), state.update(batch, "b1")]


@_query
def incremental_update(spark, sf_dir):
    """What an update did, and its replay."""
    _, done = _updated(spark, sf_dir)
    return spark.createDataFrame([(u.batch_id, u.generation, u.replay, u.rows, u.replaced, u.appended, u.movement) for u in done], "batch string, generation long, replay boolean, rows long, replaced long, appended long, movement double")


@_query
def flat_fit(spark, sf_dir):
    """Projection, fuzzifier and K in one call: the size of each cluster."""
    docs = T.embeddings(spark, sf_dir)
    fit = flows.flat_fit(docs, KS, width=16, n_init=2, max_iter=30)
    return fit.assign(docs).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit(fit.lane.m)).withColumn("how", F.lit(fit.how))


@_query
def flat_pipelines(spark, sf_dir):
    """Metrics of the flat pipelines, and which is best."""
    docs = T.embeddings(spark, sf_dir).withColumn("class", F.col("label").cast("string"))
    found, best = flows.run_pipelines(docs, 5, n_init=3, widths=(32,))
    return found.select("pipeline", "pca_components", "nmi", "ari", "silhouette", "xie_beni").withColumn("best", F.col("pipeline") == best)


@_query
def online_refine(spark, sf_dir):
    """Centers of a sample, refined by one pass of batches over the other rows."""
    docs = T.embeddings(spark, sf_dir)
    _, centers = fcm.label_centers(docs.where("id % 5 = 0"))
    weight = np.full(len(centers), 10.0)
    for b in range(4):
        mine = docs.where((F.col("id") % 5 != 0) & (F.pmod(F.xxhash64("id"), F.lit(4)) == b))
        moved, gained, _, _ = fcm.m_step(mine, centers, 1.2)
        centers = fcm.unit_rows(centers * weight[:, None] + moved * gained[:, None])
        weight = weight + gained
    objective = fcm.m_step(docs, centers, 1.2)[2]
    return spark.createDataFrame([(len(centers), float(objective))], "k long, objective double")


@_query
def hdbscan_fit(spark, sf_dir):
    """Density clusters of all rows, projected."""
    docs = T.embeddings(spark, sf_dir)
    held = pca.project(docs, pca.fit(docs, 8)).orderBy(F.xxhash64("id"), "id").select("id", "projected").toArrow()
    labels = density.hdbscan(fcm.matrix(held.column(1)), 10, 5, spark=spark)
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(held.column(0).to_pylist(), labels, strict=True)], "id long, cluster long")


@_query
def bottom_up_tree(spark, sf_dir):
    """Merge steps of the label centers, with the group of each leaf at three groups."""
    keys, centers = fcm.label_centers(T.embeddings(spark, sf_dir))
    steps = density.linkage(centers, np.ones(len(keys)))
    return spark.createDataFrame([(s.node, s.left, s.right, round(s.distance, 9), s.mass, s.leaves) for s in steps], "node long, left long, right long, distance double, mass double, leaves array<long>")


@_query
def fusion_cluster(spark, sf_dir):
    """Clusters of content fused with tags, matched with the labels."""
    from ..operators import soft

    docs = T.embeddings(spark, sf_dir)
    keys, centers = fcm.label_centers(docs)
    tags = spark.createDataFrame([(int(k), [float(x) for x in c]) for k, c in zip(keys, centers, strict=True)], "label long, x array<double>")
    fused = soft.concat_tags(docs, tags, "label", 2.0).withColumn("node", F.lit(0).cast("long"))
    best = training.best_of(training.fit_lanes(fused, [training.Lane(0, len(keys), 42 + 1009 * i, 1.2) for i in range(3)]), 2)
    table = {(r["label"], r["cluster"]): r["n"] for r in fcm.e_step(fused, best.centers, 1.2).groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    cost = np.array([[-table.get((k, c), 0) for c in range(best.k)] for k in keys], float)
    return spark.createDataFrame([(int(keys[r]), int(c), int(-cost[r, c])) for r, c in density.match(cost)], "label long, cluster long, rows long")
