"""What tasks hold, and exact results on groups larger than those of the smallest tables."""

import time
import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewave.functions import learning
from tidewave.functions.labels import HUMAN_VOICE_CLASSES
from tidewave.functions.machines import EventDetector
from tidewave.operators import suites
from tidewave.operators import vectors as V
from tidewave.operators import windows as W
from tidewave.plans import queries as Q
from tidewave.sources import synthetic


def test_audio_is_made_a_few_windows_at_a_time(spark, monkeypatch):
    """The batches that a task hands on hold a few windows each, however many ids its batch has."""
    made = {}
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: made.setdefault("f", f))
    Q.audio(spark, "/root/testdata/sf0.001")
    parts = list(made["f"](iter([pa.record_batch([pa.array(range(500), pa.int64())], ["user_id"])])))
    assert sum(b.num_rows for b in parts) == 500 and max(b.nbytes for b in parts) < 8e6
    x = synthetic.mix(synthetic.concat(synthetic.silence(0.25), synthetic.harmonic_call(0.475, 200 + 499), synthetic.silence(0.25)), synthetic.white_noise(0.975, 0.003, 500))
    assert parts[-1].column(1)[-1].as_py() == x.tolist()


def _streams(n=40):
    call = lambda i: synthetic.mix(synthetic.concat(synthetic.silence(0.25), synthetic.harmonic_call(0.475, 300 + 10 * i), synthetic.silence(0.25)), synthetic.white_noise(0.975, 0.003, i + 1)).tolist()
    return [(["a", "b"][i % 2], [0.4875, 0.3, 5.0][i % 3] * i, call(i) if i % 7 else [0.0] * 15600, "Cat" if i % 5 else "Hum", 0.2 + 0.015 * (i * 7 % 40)) for i in range(n)]


def test_events_of_a_stream_equal_the_machine_without_gathering_samples(spark):
    kind = "stream_id string, t double, samples array<float>, label string, score double"
    rows = _streams()
    want = []
    for s in ("a", "b"):
        d = EventDetector(["Cat"], HUMAN_VOICE_CLASSES)
        for _, t, x, label, score in sorted(r for r in rows if r[0] == s):
            want += [(s, e["start"], e["end"], e["type"], e["confidence"], e["syllables"]) for e in d.push(t, np.asarray(x, np.float32), [(label, score)])]
        want += [(s, e["start"], e["end"], e["type"], e["confidence"], e["syllables"]) for e in d.flush()]
    found = W.detect_events(spark.createDataFrame(rows, kind).repartition(5), ["Cat"])
    got = sorted(map(tuple, found.collect()))
    assert len(want) > 10 and len(got) == len(want) and all(g[0] == w[0] and g[3:] == w[3:] and g[1:3] == pytest.approx(w[1:3]) for g, w in zip(got, sorted(want), strict=True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "samples" not in plan[: plan.index("Exchange")] and "FlatMapGroups" not in plan


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """2000 vectors of two labels, some of them copies: more than 512 of each."""
    d, rng = str(tmp_path_factory.mktemp("many")), np.random.default_rng(5)
    x = (rng.normal(size=(2000, 64)) + np.arange(2000)[:, None] % 4).astype(np.float32)
    x[1500:1540] = x[:40]
    spark.createDataFrame([(i, x[i].tolist(), [0, 2, 1][i % 3]) for i in range(2000)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{d}/parts")
    (next(Path(d, "parts").glob("*.parquet"))).rename(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["state_scores", "state_check"])
def test_states_keep_all_their_distances(spark, many, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{many}/embeddings.parquet'")
    got, want = Q.QUERIES[name](spark, many).toPandas(), con.sql(Q.SQL[name]).df()
    columns = sorted(want.columns)
    rows = lambda t: sorted(map(tuple, t[columns].astype(str).values.tolist()))
    assert len(got) == len(want) and rows(got) == rows(want)


def test_clusters_and_thresholds_equal_plain_forms():
    """Products of matrices against differences, also far from zero and with copies; n rows of pairs are never held."""
    rng = np.random.default_rng(6)
    for x in (np.cumsum(rng.normal(size=(600, 5)), 0) + 1e4, np.repeat(rng.normal(size=(3, 6)), 40, 0), rng.standard_t(2, size=(500, 4)) * [1e-3, 1, 1e3, 1]):
        x = x.astype(np.float32)
        for k in (2, 3):
            label, centres, _ = learning.kmeans(x, k)
            assert (learning.nearest(x, centres) == learning.squared_distances(x, centres).argmin(1)).all()
            far = np.sqrt(learning.squared_distances(x, x))
            n, want = np.bincount(label, minlength=k), []
            for i, own in enumerate(label):
                others = [far[i, label == c].mean() for c in range(k) if c != own and n[c]]
                if n[own] >= 2 and others:
                    a, b = far[i, label == own].sum() / (n[own] - 1), min(others)
                    want.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
            assert abs(learning.silhouette(x, label, k) - np.mean(want)) < 1e-7
            blocks, scores = len(x) // 12, []
            for b in range(blocks):
                a, z = b * (len(x) // blocks), len(x) if b == blocks - 1 else (b + 1) * (len(x) // blocks)
                out, best = np.r_[:a, z : len(x)], np.ones(z - a)
                for c in range(k):
                    own = x[out][label[out] == c]
                    if len(own) >= 2:
                        m, v, _ = learning.fit_gaussian(own)
                        best = np.minimum(best, learning.distance_score(learning.mahalanobis(x[a:z], m, v), learning.distribution(learning.mahalanobis(own, m, v))))
                scores.append(np.percentile(best, 90))
            spread = max(max(scores) - np.percentile(scores, 75), 0.05)
            watch = float(np.clip(max(0.55, max(scores) + 0.5 * spread), 0.55, 0.9))
            assert learning.derive_thresholds(x, label, k)[0] == pytest.approx(watch, abs=1e-6)


def test_profile_of_a_large_label_is_learned_in_time():
    """Ten thousand windows: pairs and blocks by matrix products, about ten seconds of CPU where it took more than a minute."""
    x, began = np.random.default_rng(7).normal(size=(10_000, 64)).astype(np.float32), time.process_time()
    learning.learn_profile(x)
    assert time.process_time() - began < 60


def test_clips_of_large_labels_stay_apart(spark, tmp_path):
    """More than 12000 windows of a label: its clips are not those of another label."""
    rows = spark.range(26_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 13_000, 0).otherwise(2).alias("label"), F.array((F.col("id") % 7).cast("float"), (F.col("id") % 5).cast("float")).alias("embedding"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suites, "anomaly_scores", lambda windows: got.setdefault("w", windows))
        m.setattr(suites, "anomaly_auc", lambda scores: scores)
        Q.QUERIES["anomaly_suite"](spark, str(tmp_path))
    clips = got["w"].groupBy("clip").count()
    assert clips.agg(F.max("count")).head()[0] == 6 and clips.count() == 2 * 2167


def _block(x, name, fold):
    n = len(x)
    return pa.table({name: pa.array(np.arange(n)[::-1].copy()), "label": pa.array([str(i % 3) for i in range(n)]), "fold": pa.array(fold.astype(np.int32)), "e": pa.array(list(x), pa.list_(pa.float32()))}).combine_chunks()


@pytest.mark.parametrize("by_fold", [False, True])
def test_neighbours_of_a_block_are_exact_few_and_held_in_parts(by_fold):
    """The k nearest by distance and vec_id also among copies, k rows a query, in tens of MB."""
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(size=(5700, 16)), np.repeat(rng.normal(size=(1, 16)), 300, 0), np.zeros((2, 16)))).astype(np.float32)
    fold = rng.integers(0, 4, len(x))
    examples = _block(x, "other", fold).append_column("unused", pa.array([0] * len(x)))
    queries = _block(x, "id", fold).slice(5500)
    tracemalloc.start()
    got = V._nearest(5, 2.0, by_fold)(queries, examples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u = V.unit(x.astype(float))
    ids, want = np.arange(len(x))[::-1], set()
    for q in range(5500, len(x)):
        d = 1 - np.einsum("id,id->i", np.repeat(u[q : q + 1], len(u), 0), u)
        left = np.flatnonzero(fold != fold[q] if by_fold else ids != ids[q])
        want |= {(ids[q], ids[j]) for j in left[np.lexsort((ids[left], d[left]))[:5]]}
    assert got.num_rows == 5 * queries.num_rows and set(zip(got["id"].to_pylist(), got["other"].to_pylist(), strict=True)) == want
    assert peak < 60e6


