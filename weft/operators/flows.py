"""Whole fits: projection, choice of the fuzzifier and of K, assignments and metrics in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from . import extract, fcm, pca, selection, training

#: Names of the flat pipelines and the width of their projection (None: chosen by kept neighbours).
PIPELINES = {"2_auto_pca_fcm": None, "2_pca256_fcm": 256}
#: Fixed value: widths that are compared.
WIDTHS = (32, 64, 128, 256, 512)
#: Rows from which scouts vote on K.
CONSENSUS_ROWS = 500


@dataclass
class FlatFit:
    """A projection, the fit in it, and how its K was found."""

    projection: pca.Projection
    width: int
    lane: training.Lane
    how: str

    def projected(self, docs: DataFrame) -> DataFrame:
        return pca.project(docs, self.projection, self.width).withColumn("x", F.col("projected")).drop("projected", "support")

    def assign(self, docs: DataFrame) -> DataFrame:
        """``docs`` with projected x, d2, u and cluster."""
        return fcm.e_step(self.projected(docs), self.lane.centers, self.lane.m)


def projection(docs: DataFrame, width: int | None = None, widths: tuple = WIDTHS) -> tuple[pca.Projection, int]:
    """The projection and its width, which is chosen by kept neighbours if it is not given.

    That choice compares all rows with all rows; give a width where there are too many of them.
    """
    full = docs.select(F.max(F.size("x"))).first()[0] or 1
    if width is None:
        asked = [w for w in widths if w < full] or [full]
        width = pca.choose_width(docs, asked)[0] if len(asked) > 1 else asked[0]
    held = pca.fit(docs, min(width, full))
    return held, min(width, len(held.components))


def flat_fit(docs: DataFrame, ks: list[int] | None = None, width: int | None = None, m: float | None = None, fast: bool = False, consensus: bool = True, consensus_rows: int = CONSENSUS_ROWS, min_size: int = 2, **fit) -> FlatFit:
    """Project, choose m (unless given) and K, and fit; one cluster where the rows do not split."""
    ks = ks or list(range(2, 9))
    p, width = projection(docs, width)
    flat = FlatFit(p, width, training.Lane(0, 1, 42, m or 1.2), "")
    near = flat.projected(docs.select("id", "x")).withColumn("node", F.lit(0).cast("long")).persist()
    if fast:
        best, flat.how = training.fast_k(near, ks, m=m, min_size=min_size)[0], "fast"
    else:
        used = m or training.stable_fuzzifier(near, min_size=min_size)
        if consensus and near.count() >= consensus_rows:
            best, _, flat.how = training.consensus_fit(near, ks, min_size=min_size, m=used, **fit)
        else:
            best, flat.how = training.select_k(near, ks, min_size=min_size, m=used, **fit)[0].get(0), "exhaustive"
        flat.lane.m = used
    if best is None:
        best, flat.how = training.fit_lanes(near, [flat.lane])[0], f"single cluster, {flat.how}"
    flat.lane = best
    near.unpersist()
    return flat


def run_pipeline(name: str, docs: DataFrame, k: int, m: float = 2.0, n_init: int = 10, widths: tuple = WIDTHS) -> tuple[DataFrame, DataFrame]:
    """Metrics (with pipeline, pca_components, iterations) and assignments of a flat pipeline with k clusters."""
    if name not in PIPELINES:
        raise ValueError(f"unknown pipeline: {name}")
    p, width = projection(docs, PIPELINES[name], widths)
    flat = FlatFit(p, width, training.Lane(0, k, 42, m), name)
    near = flat.projected(docs).withColumn("node", F.lit(0).cast("long")).persist()
    group = training.Attempts(0, k, m, 42)
    training.extend(near, [group], n_init, 1)
    flat.lane = training.best_of(group.lanes, 1)
    if flat.lane is None:
        raise ValueError("fewer rows than clusters")
    scored = fcm.e_step(near.drop("node"), flat.lane.centers, m).drop("d2")
    found = extract.extract_metrics(scored, name, flat.lane.centers)
    near.unpersist()
    return found.withColumns({"pipeline": F.lit(name), "pca_components": F.lit(width).cast("long"), "iterations": F.lit(flat.lane.iterations).cast("long")}), scored


def run_pipelines(docs: DataFrame, k: int, names: tuple = tuple(PIPELINES), **fit) -> tuple[DataFrame, str]:
    """The metrics of several pipelines, one row each, and the name of the best one."""
    rows = [run_pipeline(n, docs, k, **fit)[0] for n in names]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every, selection.best_pipeline(every.withColumnRenamed("tag_fragmentation", "fragmentation")).first()["pipeline"]
