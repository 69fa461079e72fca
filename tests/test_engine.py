import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import learning, signal
from tidewave.functions.machines import EventDetector
from tidewave.functions.labels import HUMAN_VOICE_CLASSES
from tidewave.functions.models import Classifier, Embedder, TextAudioEmbedder, merge_classifications
from tidewave.operators import engine, store, suites
from tidewave.operators import vectors as V
from tidewave.sources import synthetic
from tidewave.streaming.processors import event_stream


# lambdas are sent to workers by value
_load_classes = lambda: lambda x: [[("Cat", 0.9 if abs(x).max() > 0.05 else 0.01), ("Speech", 0.5 if abs(x).max() > 0.35 else 0.0)], [("Cat", 0.3), ("", 1.0)]]
_load_vector = lambda: lambda x: [3.0, 4.0]


def _call(seed):
    return synthetic.mix(synthetic.concat(synthetic.silence(0.25), synthetic.harmonic_call(0.475, 300 + 50 * seed) * 0.5, synthetic.silence(0.25)), synthetic.white_noise(0.975, 0.003, seed + 1))


def _windows(spark, n=4):
    return spark.createDataFrame([("a", 5.0 * i, _call(i).astype(float).tolist()) for i in range(n)] + [("b", 0.0, [0.0] * 15600)], "stream_id string, t double, samples array<float>")


def test_embedder_runs_on_accepted_windows_only(spark):
    rows = {(r.stream_id, r.t): r for r in engine.analyse(_windows(spark), Classifier(_load_classes), Embedder(_load_vector)).collect()}
    assert all(np.allclose(rows["a", 5.0 * i].embedding, [0.6, 0.8]) for i in range(4) if rows["a", 5.0 * i].guard.accepted)
    silent = rows["b", 0.0]
    assert not silent.guard.accepted and silent.guard.reasons == ["silence"] and silent.embedding == []
    again = engine.analyse(_windows(spark), Classifier(_load_classes), Embedder(_load_vector), embed_rejected=True).where("stream_id = 'b'").head()
    assert len(again.embedding) == 2
    bare = engine.analyse(_windows(spark), guards=None).where("stream_id = 'b'").head()
    assert bare.guard is None and bare.classes == [] and bare.embedding == []


def test_engine_on_a_stream_equals_the_batch(spark, tmp_path):
    rows = _windows(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "w"))
    q = engine.analyse(stream, Classifier(_load_classes)).writeStream.format("memory").queryName("analysed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.stream_id, r.t, round(r.rms_dbfs, 6), [tuple(c) for c in r.classes]) for r in df.collect())
    assert key(spark.table("analysed")) == key(engine.analyse(rows, Classifier(_load_classes)))


def test_vectors_and_feature_map_equal_the_kernels(spark):
    rows = engine.analyse(_windows(spark, 1))
    f = signal.extract(_call(0).astype(np.float32))
    got = engine.vectors_of(rows, False).where("stream_id = 'a'").head().vector
    assert len(got) == len(signal.feature_names()) == 77 and np.allclose(got, signal.feature_vector(f), atol=1e-3)
    named = {r.feature: r.value for r in engine.feature_map(rows.where("stream_id = 'a'"), "stream_id").collect()}
    want = signal.describable_values(f)
    assert set(named) == set(want) and all(abs(named[k] - want[k]) < 1e-3 * (1 + abs(want[k])) for k in want) and "band63Hz" in named
    assert not engine.has_embeddings(rows)


def test_models_load_once_and_need_a_loader():
    calls = []

    def load():
        calls.append(1)
        return lambda x: [2.0, 0.0]

    e = Embedder(load)
    assert e.embed(np.zeros(3)).tolist() == [1.0, 0.0] and e.embed(np.zeros(3)).tolist() == [1.0, 0.0] and len(calls) == 1
    both = TextAudioEmbedder(load, load, l2_normalize=False)
    assert both.embed_text("x").tolist() == [2.0, 0.0] and len(calls) == 2
    with pytest.raises(ValueError):
        Classifier(None)
    assert merge_classifications([[("a", 0.2), ("b", 0.5)], [("a", 0.6), ("", 0.9)]], 2) == [("a", 0.6), ("b", 0.5)]


def test_events_of_a_stream_equal_the_machine(spark, tmp_path):
    kind = "stream_id string, t double, samples array<float>, classes array<struct<label:string,score:double>>"
    rows = [("a", 5.0 * i, _call(i).astype(float).tolist(), [("Cat", 0.5 + 0.1 * i), ("Speech", 0.4)]) for i in range(3)] + [("a", 20.0, [0.0] * 15600, [("Engine", 0.9)])]
    for r in rows:
        spark.createDataFrame([r], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    q = event_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "e")), ["Cat"]).writeStream.format("memory").queryName("events_found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    d, want = EventDetector(["Cat"], HUMAN_VOICE_CLASSES), []
    for _, t, x, c in rows:
        want += d.push(t, np.asarray(x, np.float32), c)
    got = spark.table("events_found").orderBy("start").collect()
    assert len(got) == 3 and [(round(r.start, 6), r.type, r.human) for r in got] == [(round(e["start"], 6), e["type"], e["human"]) for e in want]


def test_store_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(i, ["x", "y", "z"][i % 3], [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2) + 0.01 * i]) for i in range(12)], "n long, label string, embedding array<double>")
    s = store.KnnStore.empty(spark, k=3).add(e, "n").add(e.where("n = 0").withColumn("id", F.lit("own")), "n")
    assert s.examples.count() == 13 and {r.id for r in s.examples.collect()} == {f"e{i}" for i in range(12)} | {"own"} and s.next_id == 12
    s.save(str(tmp_path / "s"))
    back = store.KnnStore.load(spark, str(tmp_path / "s"))
    assert back.k == 3 and back.next_id == 13 and [r.label for r in back.labels().collect()] == ["x", "y", "z"]
    assert back.remove("e0", "own").remove_label("z").examples.count() == 7
    q = e.where("n < 3").select(F.col("n").alias("vec_id"), "embedding")
    assert {r.id: r.label for r in back.predict(q).collect()} == {0: "x", 1: "y", 2: "z"}
    assert [(r.label, r.confidence) for r in store.KnnStore.empty(spark).predict(q).collect()] == [(None, 0.0)] * 3
    spark.read.parquet(str(tmp_path / "s")).withColumn("schema_version", F.lit(9)).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        store.KnnStore.load(spark, str(tmp_path / "t"))


def test_profiles_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("m", 0.6, 0.8)], "profile string, watch double, anomalous double")
    store.save_profiles(p, str(tmp_path / "p"), compact=True)
    assert store.load_profiles(spark, str(tmp_path / "p")).collect() == p.collect()


def test_neighbours_in_blocks_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    e = spark.createDataFrame([(i, str(i % 4), rng.normal(size=8).tolist()) for i in range(120)], "vec_id long, label string, embedding array<double>")
    key = lambda df: sorted((r.id, r.label, round(r.confidence, 9)) for r in df.collect())
    whole, protos = key(V.predict(e, e)), sorted(map(tuple, V.predict_by_prototype(e, V.prototypes(e)).select("vec_id", "label").collect()))
    for name, n in (("EXAMPLES", 17), ("QUERIES", 23), ("BLOCK", 1)):
        monkeypatch.setattr(V, name, n)
    assert key(V.predict(e, e)) == whole and sorted(map(tuple, V.predict_by_prototype(e, V.prototypes(e)).select("vec_id", "label").collect())) == protos


def test_cross_validation_of_one_label_is_empty(spark):
    e = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [1.0])], "vec_id long, label string, embedding array<double>")
    r = V.validation_report(e).collect()
    assert len(r) == 1 and r[0].accuracy == 0 and r[0].folds == 0 and r[0].total == 0


def test_shuffle_is_the_classic_one():
    draws = signal.random_numbers(1, 9).tolist()
    want, got = list(range(10)), V.shuffled(np.arange(10), 1)
    for i, d in zip(range(9, 0, -1), draws, strict=True):
        j = int(d * (i + 1))
        want[i], want[j] = want[j], want[i]
    assert got.tolist() == want and V.shuffled(np.arange(4), 1, 2).tolist() != V.shuffled(np.arange(4), 1).tolist()


def test_anomaly_suite_finds_faults(spark):
    rng = np.random.default_rng(2)
    rows = [("m", c, int(c >= 12), True, float(t), (rng.normal(size=6) + (4 if c >= 12 else 0)).tolist()) for c in range(18) for t in range(5)]
    w = spark.createDataFrame(rows, "machine string, clip long, abnormal int, accepted boolean, t double, vector array<double>")
    auc = suites.anomaly_auc(suites.anomaly_scores(w)).head()
    assert auc.auc > 0.95 and auc.clips == 12


def test_pairs_of_separate_labels_are_told_apart(spark):
    rng = np.random.default_rng(4)
    e = spark.createDataFrame([(i, "abc"[i % 3], (3 * np.eye(3)[i % 3] + 0.1 * rng.normal(size=3)).tolist()) for i in range(36)] + [(99, "d", [1.0, 1.0, 1.0])], "vec_id long, label string, embedding array<double>")
    assert {(r.first, r.second): r.accuracy for r in suites.pair_identity(e).collect()} == {("a", "b"): 1.0, ("a", "c"): 1.0, ("b", "c"): 1.0}


def test_silhouette_blocks_equal_one(monkeypatch):
    x = np.random.default_rng(1).normal(size=(60, 5)).astype(np.float32)
    label = np.arange(60) % 3
    whole = learning.silhouette(x, label, 3)
    monkeypatch.setattr(learning, "BLOCK_ROWS", 7)
    assert abs(whole - learning.silhouette(x, label, 3)) < 1e-12


def test_pitch_summary():
    got = signal.summarize_pitch([(0.0, 200.0, 1.0, -10.0), (0.1, 0.0, 0.0, -10.0), (0.2, 400.0, 1.0, -10.0)])
    assert got["median_f0"] == 300 and abs(got["slope"] - 60) < 1e-9 and abs(got["voiced_fraction"] - 2 / 3) < 1e-12
    assert signal.summarize_pitch([])["slope"] == 0
