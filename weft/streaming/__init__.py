"""Incremental maintenance of a clustering: versioned state in Parquet, idempotent micro-batches, Structured Streaming."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..operators import classify, fcm, incremental as inc, metrics, training
from ..sources import fingerprint

HISTORY = 256
#: Generations whose files are kept.
KEPT = 2


@dataclass
class Update:
    """What one micro-batch did."""

    batch_id: str
    generation: int
    replay: bool
    rows: int
    noise_ratio: float | None
    alarm: bool
    recluster: bool
    refreshed: int
    movement: float
    replaced: int = 0
    appended: int = 0
    noise: int = 0
    ewma: float | None = None
    xie_beni: float | None = None
    xb_degraded: bool = False
    suppressed: bool = False
    clusters: int = 0


def _checksum(manifest: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in manifest.items() if k != "checksum"}, sort_keys=True).encode()).hexdigest()


class State:
    """A flat spherical clustering under a folder: the rows and center sums of each generation, and a manifest named last.

    A generation is complete before its manifest is written, and a manifest is never changed, so a reader or a restarted
    driver sees the last complete generation whatever was lost on the way. Of two writers of the same generation, the
    second one fails. A manifest holds a checksum of itself and is refused if it does not match.

    The sums behind the centers are stored, so that a batch reads the contributions of the rows that it replaces and no
    others. Every ``refresh_every`` updates, rows that moved centers weigh on are scored anew, thresholds follow the
    distances, and the Xie-Beni index is compared with that of the last clustering. A drift alarm or a worse index asks for
    new centers, unless that happened a few updates ago; they are fitted with the K of ``ks`` that scores best (the old K
    where ``ks`` is None or nothing valid is found).
    """

    def __init__(self, spark: SparkSession, path: str, m: float = 1.2, policy: inc.DriftPolicy = inc.DriftPolicy(), refresh_every: int = 10, threshold: float = 1.3, max_xb_growth: float = 0.05, distance_z: float = 3.5, ks: list[int] | None = None):
        self.spark, self.path, self.m, self.policy, self.refresh_every, self.threshold = spark, path.rstrip("/"), m, policy, refresh_every, threshold
        self.max_xb_growth, self.distance_z, self.ks = max_xb_growth, distance_z, ks

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _generations(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        file = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if "=" in f.getPath().getName() and fs.exists(file(f.getPath(), "_SUCCESS")))

    def _read(self, generation: int) -> dict:
        held = json.loads(self.spark.read.text(f"{self.path}/manifests/gen={generation}").first()[0])
        if held.get("checksum") != _checksum(held):
            raise ValueError(f"the manifest of generation {generation} does not match its checksum")
        return held

    def manifest(self) -> dict | None:
        found = self._generations()
        return self._read(found[-1]) if found else None

    def _delete(self, name: str) -> None:
        fs, _ = self._fs()
        fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def _save(self, manifest: dict) -> None:
        """Write a manifest last; files of generations beyond ``KEPT`` go."""
        gen, found = manifest["generation"], self._generations()
        if gen in found:
            raise RuntimeError(f"generation {gen} was written by another process")
        self._delete(f"manifests/gen={gen}")  # what a lost writer left incomplete
        manifest["checksum"] = _checksum(manifest)
        self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/manifests/gen={gen}")
        for old in found[: max(0, len(found) + 1 - KEPT)]:
            gone = self._read(old)
            self._delete(f"manifests/gen={old}")
            self._delete(gone["rows"])
            self._delete(gone["sums"])

    def _store(self, df: DataFrame, kind: str, generation: int) -> str:
        name = f"{kind}/{generation}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return name

    def _open(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def rows(self) -> DataFrame:
        return self._open(self.manifest()["rows"])

    def _score(self, docs: DataFrame, centers: np.ndarray, thresholds: list[float]) -> DataFrame:
        scored = fcm.e_step(docs.select("id", "x", "pos"), centers, self.m).withColumn("distance", F.sqrt(F.array_min("d2")))
        limit = F.get(V.literal(thresholds), F.col("cluster").cast("int"))
        return scored.withColumn("is_noise", classify.document_type(F.col("distance"), limit) == "noise")

    def _xie_beni(self, rows: DataFrame, centers: np.ndarray) -> float:
        return float(rows.agg(metrics.xie_beni(self.m, metrics.min_separation(centers)).alias("xb")).first()[0] or 0.0)

    def _thresholds(self, rows: DataFrame, old: list[float]) -> list[float]:
        frame = self.spark.createDataFrame([("", k, float(t)) for k, t in enumerate(old)], "path string, k long, threshold double")
        scored = rows.select(F.lit("").alias("path"), F.col("cluster").alias("k"), "distance")
        return [r["threshold"] for r in inc.refreshed_thresholds(scored, frame, self.distance_z).orderBy("k").collect()]  # one row for each center

    def _sums(self, rows: DataFrame) -> DataFrame:
        return inc.statistics(inc.contributions(rows, self.m))

    def _frame(self, centers: np.ndarray) -> DataFrame:
        return fcm.centers_frame(self.spark, centers).withColumn("path", F.lit(""))

    def _centers(self, sums: DataFrame, old: np.ndarray) -> np.ndarray:
        return np.array([r["center"] for r in inc.centers_from_statistics(sums, self._frame(old)).orderBy("k").collect()])  # the model

    def _start(self, docs: DataFrame, centers: np.ndarray, generation: int) -> dict:
        """Rows, sums, thresholds and index of a fresh clustering."""
        open_ = [self.threshold] * len(centers)
        name = self._store(self._score(docs, centers, open_), "scored", generation)
        limits = self._thresholds(self._open(name), open_)
        rows = self._store(self._score(self._open(name), centers, limits), "rows", generation)
        self._delete(name)
        held = self._open(rows)
        return {"rows": rows, "sums": self._store(self._sums(held).coalesce(1), "sums", generation), "centers": np.asarray(centers).tolist(), "reference": np.asarray(centers).tolist(), "thresholds": limits, "base_xb": self._xie_beni(held, np.asarray(centers))}

    def fit(self, docs: DataFrame, centers: np.ndarray | None = None, ks: list[int] | None = None) -> None:
        """Start from documents (id, x, pos) and fitted centers, or from the K of ``ks`` that scores best."""
        if centers is None:
            centers = self._refit(docs, None, ks or self.ks or [2, 3, 4, 5, 6, 7, 8])
        self._save({"generation": 0, "batches": {}, "noise": 0.0, "n": 0.0, "ewma": None, "alarm": False, "cool": 0, "updates": 0, **self._start(docs, centers, 0)})

    def _refit(self, docs: DataFrame, centers: np.ndarray | None, ks: list[int] | None) -> np.ndarray:
        one = docs.select("id", "x").withColumn("node", F.lit(0).cast("long"))
        held, _ = training.select_k(one, ks or [len(centers)], m=self.m)
        if 0 in held:
            return held[0].centers
        if centers is None:  # nothing splits: one center
            return training.fit_lanes(one, [training.Lane(0, 1, 42, self.m)])[0].centers
        for _ in range(10):
            centers = fcm.m_step(docs, centers, self.m)[0]
        return centers

    def update(self, batch: DataFrame, batch_id: str | None = None) -> Update:
        """Merge a batch (id, x): replace and append rows, move the centers by the difference, watch for drift.

        A batch that was processed already is answered from the history; other content under its name is an error.
        """
        old = self.manifest()
        if old is None:
            raise ValueError("fit the state before it is updated")
        batch = batch.select("id", "x").persist()
        print_ = fingerprint(batch)
        name = (batch_id or f"auto:{print_}").strip()
        if not 0 < len(name) <= 512:
            raise ValueError("a batch id has 1 to 512 characters")
        if name in old["batches"]:
            seen = old["batches"][name]
            if seen["fingerprint"] != print_:
                raise ValueError(f"batch {name!r} was processed with different content")
            return Update(**{**seen["summary"], "replay": True})
        gen, updates, limits = old["generation"] + 1, old["updates"] + 1, old["thresholds"]
        centers, held, sums = np.array(old["centers"]), self._open(old["rows"]), self._open(old["sums"])
        start = held.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
        sent = batch.select("id", "x", (F.monotonically_increasing_id() + start).alias("pos"))
        scored = self._score(sent, centers, limits).persist()
        stats = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_noise").cast("long")).alias("noise")).first()

        replaced = held.join(scored.select("id"), "id", "left_semi").persist()
        keep = held.join(scored.select("id"), "id", "left_anti")
        swapped = replaced.count()
        sums = inc.apply_delta(sums, inc.contributions(replaced, self.m), inc.contributions(scored, self.m))
        new = self._centers(sums, centers)
        incoming = scored.join(replaced.select("id", F.col("pos").alias("old_pos")), "id", "left").withColumn("pos", F.coalesce("old_pos", "pos")).drop("old_pos")
        merged, reference, refreshed, xb, degraded = keep.unionByName(incoming), old["reference"], 0, None, False
        gone = []
        if updates % self.refresh_every == 0:
            movement = inc.center_movement(self._frame(np.array(reference)), self._frame(new))
            ids = inc.affected_ids(inc.contributions(merged, self.m), movement).select("id").persist()
            stale = merged.join(ids, "id", "left_semi")
            fresh = self._score(stale, new, limits)
            refreshed = ids.count()
            sums = inc.apply_delta(sums, inc.contributions(stale, self.m), inc.contributions(fresh, self.m))
            gone.append(self._store(merged.join(ids, "id", "left_anti").unionByName(fresh), "rows", gen))
            merged = self._open(gone[-1])
            new = self._centers(sums, new)
            limits, reference = self._thresholds(merged, limits), new.tolist()
            xb = self._xie_beni(merged, new)
            degraded = bool((xb - old["base_xb"]) / max(abs(old["base_xb"]), 1e-12) >= self.max_xb_growth)

        p = self.policy
        noise, n, ewma, alarm = old["noise"] + (stats["noise"] or 0), old["n"] + stats["n"], old["ewma"], old["alarm"]
        ratio, evaluated = None, n >= p.min_samples
        if evaluated:
            ratio = noise / n
            ewma = ratio if ewma is None else p.alpha * ratio + (1 - p.alpha) * ewma
            alarm = not ewma <= p.leave if alarm else ewma > p.enter
            noise = n = 0.0
        asked = (evaluated and alarm) or degraded
        recluster = bool(asked and old["cool"] == 0)
        if recluster:
            docs = merged.select("id", "x", "pos").persist()
            part = self._start(docs, self._refit(docs, new, self.ks), gen)
            docs.unpersist()
            xb = part["base_xb"]
        else:
            rows = gone.pop() if gone else self._store(merged, "rows", gen)
            part = {"rows": rows, "sums": self._store(sums.coalesce(1), "sums", gen), "centers": new.tolist(), "reference": reference, "thresholds": limits, "base_xb": old["base_xb"]}
        both = min(len(centers), len(part["centers"]))
        largest = float(np.sqrt(((centers[:both] - np.array(part["centers"])[:both]) ** 2).sum(1)).max())
        summary = Update(name, gen, False, int(stats["n"]), ratio, bool(alarm), recluster, refreshed, largest, swapped, int(stats["n"]) - swapped, int(stats["noise"] or 0), ewma, xb, degraded, bool(asked and not recluster), len(part["centers"]))
        history = dict(sorted({**old["batches"], name: {"fingerprint": print_, "at": time.time(), "summary": asdict(summary)}}.items(), key=lambda e: e[1]["summary"]["generation"])[-HISTORY:])
        self._save({"generation": gen, "batches": history, "noise": noise, "n": n, "ewma": ewma, "alarm": bool(alarm), "cool": p.cooldown if recluster else max(0, old["cool"] - 1), "updates": updates, **part})
        for name in gone:
            self._delete(name)
        for df in (batch, scored, replaced):
            df.unpersist()
        return summary

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        """Maintain the state from a stream of (id, embedding); a batch that Spark repeats changes nothing."""

        def each(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                self.update(batch.select("id", V.doubles("embedding").alias("x")), f"stream:{number}")

        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def daily_noise(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Noise and rows for each day of an event stream, with a watermark for late rows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("day")).agg(F.sum(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("noise"), F.count(F.lit(1)).alias("n"))
