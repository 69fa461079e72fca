"""Evaluation suites: anomaly detection by area under the curve, detection recall, and identity of pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import learning
from tidewave.operators import vectors as V


def anomaly_scores(windows: DataFrame) -> DataFrame:
    """(machine, clip, abnormal, score) of clips scored against a profile of their machine.

    ``windows`` has (machine, clip, abnormal, accepted, t, vector).  A machine's profile is learned from the accepted windows of the first
    half of its normal clips, by clip; the other clips are scored whole.  One machine's windows are in one task, as clusters need all their pairs:
    they are the clips of one device.
    """
    clips = windows.select("machine", "clip", "abnormal").distinct()
    normal = clips.where("abnormal = 0").withColumn("i", F.row_number().over(Window.partitionBy("machine").orderBy("clip")) - 1)
    half = normal.withColumn("n", F.count("*").over(Window.partitionBy("machine"))).select("machine", "clip", (F.col("i") < F.floor(F.col("n") / 2)).alias("learned"))
    marked = windows.join(half, ["machine", "clip"], "left").withColumn("learned", F.coalesce("learned", F.lit(False)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("clip", "ascending"), ("t", "ascending")])
        x = V._matrix(table["vector"])
        learned, accepted = table["learned"].to_numpy(), table["accepted"].to_numpy()
        profile = learning.learn_profile(x[learned & accepted].astype(np.float32))
        score, _, _ = learning.score_windows(profile, x)
        clip, abnormal = table["clip"].to_numpy(), table["abnormal"].to_numpy()
        # rows lie in order of clip
        ids, starts = np.unique(clip[~learned], return_index=True)
        parts = np.split(score[~learned], starts[1:]) if len(ids) else []
        out = [(int(c), int(abnormal[i]), float(np.percentile(s, 90))) for c, i, s in zip(ids, np.searchsorted(clip, ids), parts, strict=True)]
        return pa.table({"machine": pa.array([table["machine"][0].as_py()] * len(out), table.schema.field("machine").type), "clip": pa.array([o[0] for o in out], pa.int64()), "abnormal": pa.array([o[1] for o in out], pa.int32()), "score": pa.array([o[2] for o in out], pa.float64())})

    kind = windows.schema["machine"].dataType.simpleString()
    rows = marked.select("machine", F.col("clip").cast("long"), F.col("abnormal").cast("int"), "accepted", "t", "vector", "learned")
    return rows.groupBy("machine").applyInArrow(run, f"machine {kind}, clip long, abnormal int, score double")


def anomaly_auc(scores: DataFrame) -> DataFrame:
    """(machine, auc, clips) by rank sums, equal scores ranked by clip; 0 if a class is absent."""
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy("machine").orderBy("score", "clip")))
    sums = ranked.groupBy("machine").agg(F.sum(F.when(F.col("abnormal") == 1, F.col("r"))).alias("s"), F.sum(F.col("abnormal").cast("long")).alias("p"), F.count("*").alias("clips"))
    q = F.col("clips") - F.col("p")
    return sums.select("machine", F.when((F.col("p") == 0) | (q == 0), F.lit(0.0)).otherwise((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * q)).alias("auc"), "clips")


def detection_recall(clips: DataFrame, events: DataFrame) -> DataFrame:
    """One row: recall, the share of ``clips`` (stream_id) with at least one of the ``events`` (stream_id, ...), and clips."""
    found = clips.select("stream_id").distinct().join(events.select("stream_id", F.lit(1).alias("hit")).distinct(), "stream_id", "left")
    return found.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), F.lit(0.0)).alias("recall"), F.count("*").alias("clips"))


def loudest(windows: DataFrame) -> DataFrame:
    """(label, clip, embedding): the loudest window of each clip, the first of equals, if it has an embedding."""
    best = windows.groupBy("label", "clip").agg(F.max_by("embedding", F.struct("rms_dbfs", -F.col("t"))).alias("embedding"))
    return best.where(F.size("embedding") > 0)


def pair_identity(examples: DataFrame, least: int = 10, most: int = 20, folds: int = 5, k: int = 5) -> DataFrame:
    """(first, second, accuracy) of every pair of labels with at least ``least`` examples: a cross-validation of the first ``most`` rows of the two, by vec_id.

    All pairs are one job: an example is copied to each pair it belongs to, folds are dealt in each pair, and neighbours are sought within a pair.
    Pairs grow with the square of the labels, which are the animals of a household; a pair holds at most ``most`` rows.
    """
    many = examples.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("label")
    pairs = many.select(F.col("label").alias("first")).join(many.select(F.col("label").alias("second")), F.col("first") < F.col("second"))
    rows = pairs.join(examples.select("vec_id", "label", "embedding"), (F.col("label") == F.col("first")) | (F.col("label") == F.col("second")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("first", "second").orderBy("vec_id"))).where(F.col("r") <= most).drop("r")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        x, label = V.unit(V._matrix(table["embedding"])), np.array([str(v) for v in table["label"].to_pylist()])
        names = list(dict.fromkeys(label))
        hits = np.nan
        if len(names) == 2:
            n = max(2, min(folds, min((label == v).sum() for v in names)))
            fold, at = np.zeros(len(x), int), 0
            for v in names:
                own = np.flatnonzero(label == v)
                fold[V.shuffled(own, 1, at)] = np.arange(len(own)) % n
                at += len(own) - 1
            far = 1 - x @ x.T
            far[fold[:, None] == fold[None, :]] = np.inf
            hits = 0
            for i in range(len(x)):
                near = [j for j in np.argsort(far[i], kind="stable")[:k] if far[i, j] < np.inf]
                votes: dict[str, float] = {}
                for j in near:
                    votes[label[j]] = votes.get(label[j], 0.0) + 1 / (far[i, j] + 1e-6)
                hits += bool(votes) and max(votes, key=lambda v: votes[v]) == label[i]
        return pa.table({"first": table["first"].slice(0, 1), "second": table["second"].slice(0, 1), "accuracy": pa.array([hits / len(x) if len(names) == 2 else 0.0], pa.float64())})

    kind = examples.schema["label"].dataType.simpleString()
    return rows.groupBy("first", "second").applyInArrow(run, f"first {kind}, second {kind}, accuracy double")
