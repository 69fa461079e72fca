import numpy as np
import pytest

from tidewave.functions import learning, signal
from tidewave.functions.machines import EventDetector, Framer, StreamScorer
from tidewave.sources import synthetic, wav


def test_levels():
    assert signal.rms_level(synthetic.tone(1, 440, 1.0)) == pytest.approx(-3.01, abs=0.02)
    assert signal.rms_level(np.zeros(100)) == -120 and signal.rms_level(np.zeros(0)) == -120


def test_fft_against_a_plain_transform():
    x = np.random.default_rng(1).normal(size=64)
    k = np.arange(33)[:, None] * np.arange(64)[None, :]
    plain = np.abs((x * signal.hann(64) * np.exp(-2j * np.pi * k / 64)).sum(1)) * 2 / 32
    assert np.allclose(signal.spectrogram(x, 64, 64, 64)[0], plain, atol=1e-9)
    with pytest.raises(ValueError):
        signal.spectrogram(x, 64, 64, 60)


def test_window_features():
    assert signal.hann(8)[0] == 0 and signal.hann(8)[4] == 1
    sums = signal.mel_bank().sum(1)
    assert np.allclose(sums[sums > 0], 1)
    tone = signal.extract(synthetic.tone(0.975, 300))
    assert tone["bands"].argmax() == 2 and abs(tone["peaks"][0][0] - 300) < 10
    assert signal.extract(synthetic.white_noise(0.975))["flatness"] > 0.9
    knocks = signal.extract(synthetic.knocks(2.4, 0.4))
    assert abs(knocks["onset_period_s"] - 0.4) < 0.02 and knocks["onset_periodicity"] > 0.9
    am = signal.extract(synthetic.modulated(synthetic.tone(2, 600), 7, 0.9))
    assert 6 < am["am_hz"] < 8
    assert len(signal.feature_vector(tone)) == 77


@pytest.mark.parametrize("hz", [100, 220, 440, 800, 1100])
def test_pitch(hz):
    f0, confidence = signal.yin(synthetic.tone(0.05, hz)[:402])
    assert abs(f0 / hz - 1) < 0.01 and confidence > 0.8


def test_pitch_out_of_range_is_unvoiced():
    for hz in (60, 2000):
        voiced = [p for p in signal.track_pitch(synthetic.tone(0.3, hz)) if p[1] > 0]
        assert not voiced


def test_resample():
    x = synthetic.tone(0.1, 440, rate=8000)
    assert len(signal.resample(x, 8000)) == 1600
    assert np.abs(signal.resample(synthetic.tone(0.1, 7900, 0.5, 48000), 48000)[50:-50]).max() < 0.3
    with pytest.raises(ValueError):
        signal.resample(x, 0)


def test_framer_equals_one_shot_framing():
    x = synthetic.pink_noise(4)
    f = Framer()
    got = [g for a in range(0, len(x), 1000) for g in f.push(x[a : a + 1000])]
    whole = signal.windows(x, 15600, 7800)
    assert len(got) == len(whole) == (len(x) - 15600) // 7800 + 1
    assert all(np.array_equal(a[1], b) for a, b in zip(got, whole, strict=True)) and got[1][0] == 0.4875
    with pytest.raises(ValueError):
        Framer(10, 20)


def test_segments_and_syllables():
    env = np.array([-60.0] * 50 + [-20.0] * 20 + [-60.0] * 3 + [-20.0] * 20 + [-60.0] * 50)
    spans = signal.segment(env, 0.01)
    assert len(spans) == 1 and spans[0][0] == pytest.approx(0.5) and spans[0][3] == 2
    assert signal.count_syllables([]) == 0 and signal.count_syllables([-10]) == 1


def test_clustering_and_profile():
    rng = np.random.default_rng(3)
    blobs = np.concatenate([rng.uniform(-0.2, 0.2, (20, 2)) + c for c in ((0, 0), (5, 5), (0, 6))]).astype(np.float32)
    assert learning.select_clustering(blobs)[0] == 3
    assert learning.select_clustering(blobs[:20])[0] == 1
    with pytest.raises(ValueError):
        learning.kmeans(blobs, 0)
    p = learning.learn_profile(blobs)
    score, state, _ = learning.score_windows(p, blobs)
    assert score.max() <= 0.5 and len(set(state)) == 3
    far, _, _ = learning.score_windows(p, np.full((1, 2), 40, np.float32))
    assert far[0] > 0.95
    again, _, _ = learning.score_windows(learning.expand(learning.compact(p)), blobs)
    assert np.abs(np.clip(again, 0, 0.55) - score).max() < 0.1
    with pytest.raises(ValueError):
        learning.learn_profile(blobs[:3])
    with pytest.raises(ValueError):
        learning.expand({"states": []})


def test_distance_score_is_half_at_the_largest_distance():
    d = np.arange(100) / 100
    dist = learning.distribution(d)
    assert learning.distance_score(np.array([0.99]), dist)[0] == 0.5
    assert len(learning.distribution(np.arange(5000.0))["samples"]) == 512


def test_calibration_stays_ordered():
    w, a = 0.75, 0.9
    for i in range(30):
        w, a = learning.calibrate(w, a, "normal" if i % 2 else "anomalous", 0.5 + 0.015 * i)
        assert 0.4 <= w < a <= 0.999


def test_scorer_holds_status_and_sees_drift():
    s = StreamScorer(0.5, 0.9, smoothing=1.0, hold=3, recent=5, reference=10)
    out = [s.push(v) for v in [0.1] * 10 + [0.6] * 5]
    assert [o[1] for o in out[9:13]] == ["normal", "normal", "normal", "watch"] and out[12][2]
    assert out[-1][3] and out[-1][4] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        StreamScorer(0.5, 0.9, smoothing=0)


def test_detector_gives_one_call_once():
    x = synthetic.concat(synthetic.silence(0.5), synthetic.harmonic_call(0.5, 600), synthetic.silence(1.0))
    d, out = EventDetector(["Cat"], ["Speech"]), []
    for t, w in Framer().push(x):
        out += d.push(t, w, [("Cat", 0.8)])
    out += d.flush()
    assert len(out) == 1 and abs(out[0]["start"] - 0.5) < 0.05
    with pytest.raises(ValueError):
        EventDetector([], [])


def test_half_floats():
    x = np.array([0, -0.0, 1, -2.5, 65504, 1e6, 1e-7, 6e-8, 0.1, np.inf], np.float32)
    assert np.allclose(signal.from_half(signal.to_half(x))[:5], x[:5])
    assert signal.to_half(np.array([1 + 2**-11], np.float32))[0] == 0x3C01
    assert np.isinf(signal.from_half(signal.to_half(x))[5]) and np.isnan(signal.from_half(signal.to_half(np.array([np.nan], np.float32))))[0]


def test_mlp_learns():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (40, 4)) for c in (0, 3)])
    head = learning.MlpHead(["a", "b"])
    head.train(x, ["a"] * 40 + ["b"] * 40, epochs=20)
    assert (head.predict(x).argmax(1) == np.repeat([0, 1], 40)).mean() > 0.95
    with pytest.raises(ValueError):
        learning.MlpHead(["a"])


def test_wav_round_trip(spark, tmp_path):
    x = synthetic.tone(0.1, 440)
    got, rate, channels = wav.decode(wav.encode(x))
    assert rate == 16000 and channels == 1 and np.abs(got - x).max() < 1e-4
    (tmp_path / "1_cat_x.wav").write_bytes(wav.encode(x))
    row = wav.read_wav(spark, str(tmp_path)).head()
    assert row.label == "cat" and len(row.samples) == 1600
    with pytest.raises(ValueError):
        wav.decode(b"nothing")
