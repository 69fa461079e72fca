"""Signal kernels on NumPy arrays.  Batch operators and streaming state processors share them."""

from __future__ import annotations

from functools import cache

import numpy as np

from tidewave.constants import (
    DBFS_FLOOR, FFT_SIZE, MEL_BANDS, MEL_MAX_HZ, MEL_MIN_HZ, OCTAVE_BAND_EDGES_HZ, PITCH_FRAME_MS, PITCH_HOP_MS, PITCH_MAX_HZ,
    PITCH_MIN_HZ, SAMPLE_RATE_HZ, SILENCE_EPSILON, STFT_HOP_SAMPLES, STFT_WINDOW_SAMPLES,
)


def level(x: float) -> float:
    return DBFS_FLOOR if x < SILENCE_EPSILON else max(DBFS_FLOOR, 20 * float(np.log10(x)))


def power_db(p):
    p = np.asarray(p, float)
    return np.where(p <= 0, DBFS_FLOOR, np.maximum(DBFS_FLOOR, 10 * np.log10(np.where(p > 0, p, 1))))


def rms_level(x: np.ndarray) -> float:
    return level(float(np.sqrt(np.mean(np.square(x, dtype=float))))) if len(x) else DBFS_FLOOR


def half_up(x: float) -> int:
    """The nearest whole number, halves rounded up."""
    return int(np.floor(x + 0.5))


def levels(frames: np.ndarray) -> np.ndarray:
    """RMS level of every row."""
    if not frames.shape[1]:
        return np.full(len(frames), DBFS_FLOOR)
    rms = np.sqrt(np.einsum("ij,ij->i", frames, frames) / frames.shape[1])
    return np.where(rms < SILENCE_EPSILON, DBFS_FLOOR, np.maximum(DBFS_FLOOR, 20 * np.log10(np.maximum(rms, SILENCE_EPSILON))))


def _around(x: np.ndarray, at: np.ndarray, radius: int) -> np.ndarray:
    """Rows of the values around each place, NaN beyond the ends."""
    padded = np.concatenate((np.full(radius, np.nan), x, np.full(radius, np.nan)))
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * radius + 1)[at]


def windows(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        return np.zeros((0, size), x.dtype)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def hann(n: int) -> np.ndarray:
    """Periodic."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def low_pass(x: np.ndarray, cutoff: float, taps: int = 63) -> np.ndarray:
    """Blackman-windowed sinc of unit gain at 0; ``cutoff`` in cycles a sample; zeros beyond the edges."""
    k = np.arange(taps) - taps // 2
    i = np.arange(taps) / (taps - 1)
    h = 2 * cutoff * np.sinc(2 * cutoff * k) * (0.42 - 0.5 * np.cos(2 * np.pi * i) + 0.08 * np.cos(4 * np.pi * i))
    return np.convolve(x, h / h.sum(), "full")[taps // 2 : taps // 2 + len(x)].astype(np.float32)


def resample(x: np.ndarray, source_hz: float, target_hz: float = SAMPLE_RATE_HZ, smooth: bool = True) -> np.ndarray:
    """Linear interpolation, after a low-pass when the rate falls; the last sample is held."""
    if source_hz <= 0 or target_hz <= 0:
        raise ValueError("rates must be positive")
    x = np.asarray(x, np.float32)
    if source_hz == target_hz or not len(x):
        return x.copy()
    ratio = source_hz / target_hz
    y = low_pass(x, 0.45 * target_hz / source_hz) if ratio > 1 and smooth else x
    n = max(1, int(len(x) // ratio))
    return np.interp(np.arange(n) * ratio, np.arange(len(y)), y).astype(np.float32)


@cache
def _taper(size: int) -> np.ndarray:
    return hann(size)


def spectrogram(x: np.ndarray, size: int = STFT_WINDOW_SAMPLES, hop: int = STFT_HOP_SAMPLES, fft: int = FFT_SIZE) -> np.ndarray:
    """Magnitudes (frames x bins), scaled so that a sine's peak is its amplitude."""
    if fft < 4 or fft & (fft - 1):
        raise ValueError("the FFT's size must be a power of two, 4 at least")
    w = _taper(size)
    return np.abs(np.fft.rfft(windows(np.asarray(x, float), size, hop) * w, fft)) * (2 / w.sum())


def average_spectrum(spec: np.ndarray) -> np.ndarray:
    """Mean magnitude of each bin over the frames, zeros without frames."""
    return spec.mean(0) if len(spec) else np.zeros(spec.shape[1])


def hz_to_mel(hz):
    return 2595 * np.log10(1 + np.asarray(hz, float) / 700)


def mel_to_hz(mel):
    return 700 * (10 ** (np.asarray(mel, float) / 2595) - 1)


@cache
def mel_bank(bands: int = MEL_BANDS, fft: int = FFT_SIZE, rate: int = SAMPLE_RATE_HZ, low: float = MEL_MIN_HZ, high: float = MEL_MAX_HZ) -> np.ndarray:
    """Triangles, each row summing to 1 unless it holds no bin."""
    edges = mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high), bands + 2)).astype(np.float32).astype(float)
    hz = np.arange(fft // 2 + 1) * rate / fft
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rise, fall = (hz - left) / (mid - left), (right - hz) / (right - mid)
    bank = np.where((hz > left) & (hz <= mid), rise, np.where((hz > mid) & (hz < right), fall, 0))
    sums = bank.sum(1, keepdims=True)
    return np.divide(bank, sums, out=np.zeros_like(bank), where=sums > 0)


def log_mel(spectrum: np.ndarray, bank: np.ndarray) -> np.ndarray:
    return power_db(bank @ np.square(spectrum))


def flatness(spectrum: np.ndarray) -> float:
    p = np.square(spectrum[1:]) + 1e-20
    return float(min(1, np.exp(np.mean(np.log(p))) / np.mean(p))) if len(p) else 0.0


def centroid(spectrum: np.ndarray, rate: float = SAMPLE_RATE_HZ, fft: int = FFT_SIZE) -> float:
    m = spectrum[1:]
    return float((m * np.arange(1, len(spectrum)) * rate / fft).sum() / m.sum()) if m.sum() > 0 else 0.0


@cache
def _band_edges(edges: tuple[float, ...], bins: int, rate: float, fft: int) -> np.ndarray:
    """First bin (0 excluded) at or above each edge."""
    return np.maximum(1, np.searchsorted(np.arange(bins) * rate / fft, edges, "left"))


def band_levels(spectrum: np.ndarray, edges=tuple(OCTAVE_BAND_EDGES_HZ), rate: float = SAMPLE_RATE_HZ, fft: int = FFT_SIZE) -> np.ndarray:
    at = _band_edges(tuple(edges), len(spectrum), rate, fft)
    power = np.square(spectrum)
    return power_db(np.array([power[a:b].sum() for a, b in zip(at, at[1:], strict=False)]))


def find_peaks(spectrum: np.ndarray, rate: float = SAMPLE_RATE_HZ, fft: int = FFT_SIZE, most: int = 5, prominence_db: float = 6, radius_hz: float = 300) -> list[tuple[float, float, float]]:
    """(frequency, level, prominence) of local maxima that stand out of the upper median around them."""
    db = 20 * np.log10(np.maximum(spectrum, 10 ** (DBFS_FLOOR / 20)))
    radius = max(2, half_up(radius_hz * fft / rate))
    at = 1 + np.flatnonzero((db[1:-1] > db[:-2]) & (db[1:-1] >= db[2:]))
    if not len(at):
        return []
    # bins 1 .. n - 2 of those from radius below to radius - 1 above, without the peak and the two beside it
    inner = db.copy()
    inner[[0, -1]] = np.nan
    near = _around(inner, at, radius)[:, :-1]
    near[:, radius - 1 : radius + 2] = np.nan
    near.sort(1)
    count = (~np.isnan(near)).sum(1)
    floor = np.where(count > 0, near[np.arange(len(at)), count // 2 * (count > 0)], DBFS_FLOOR)
    gap = db[at] - floor
    best = np.flatnonzero(gap >= prominence_db)
    best = best[np.argsort(-gap[best], kind="stable")][:most]
    return [(interpolate_peak(db, at[i]) * rate / fft, float(db[at[i]]), float(gap[i])) for i in best]


def interpolate_peak(db: np.ndarray, b: int) -> float:
    x, y, z = db[b - 1], db[b], db[b + 1]
    d = x - 2 * y + z
    return b + (float(np.clip(0.5 * (x - z) / d, -0.5, 0.5)) if d else 0.0)


def spectral_flux(spec: np.ndarray) -> np.ndarray:
    """Rise of the log spectrum from frame to frame, bin 0 excluded, 0 at the first."""
    if not len(spec):
        return np.zeros(0)
    rise = np.maximum(np.diff(np.log10(spec[:, 1:] + 1e-6), axis=0), 0).sum(1) / (spec.shape[1] - 1)
    return np.concatenate(([0.0], rise))


def onsets(strength: np.ndarray, hop_s: float, factor: float = 1.5, radius: int = 8, interval: float = 0.05, least: float = 0.05) -> list[float]:
    """Times of local maxima above the median and mean deviation around them, the interval apart at least."""
    v = np.asarray(strength, float)
    if len(v) < 3:
        return []
    at = 1 + np.flatnonzero((v[1:-1] >= least) & (v[1:-1] > v[:-2]) & (v[1:-1] >= v[2:]))
    if not len(at):
        return []
    near = _around(v, at, radius)
    n = (~np.isnan(near)).sum(1)
    rows, ordered = np.arange(len(at)), np.sort(near, 1)
    middle = (ordered[rows, (n - 1) // 2] + ordered[rows, n // 2]) / 2
    spread = np.nansum(np.abs(near - middle[:, None]), 1) / n
    out: list[float] = []
    for i in at[v[at] >= middle + factor * spread].tolist():
        t = i * hop_s
        if not out or t - out[-1] >= interval:
            out.append(t)
    return out


def onset_periodicity(times: list[float]) -> tuple[float, float]:
    """(strength, period): of periods within 40 % of the median interval, the one whose phases agree most."""
    if len(times) < 3:
        return 0.0, 0.0
    seed = float(np.median(np.diff(times)))
    if seed <= 0:
        return 0.0, 0.0
    periods = seed * (1 + np.arange(-40, 41) / 100)
    phase = 2 * np.pi * np.asarray(times)[None, :] / periods[:, None]
    strength = np.hypot(np.cos(phase).mean(1), np.sin(phase).mean(1))
    best = int(strength.argmax())
    return float(strength[best]), float(periods[best])


def modulation(env: np.ndarray, hop_s: float, low: float = 2, high: float = 20) -> tuple[float, float]:
    """(rate, depth) of the strongest modulation of an envelope of levels."""
    n = len(env)
    if n < 8:
        return 0.0, 0.0
    x = np.asarray(env, float) - np.mean(env)
    if np.square(x).sum() <= 0:
        return 0.0, 0.0
    size = max(8, 1 << (n - 1).bit_length())
    m = np.abs(np.fft.rfft(x * hann(n), size))
    hz = np.arange(len(m)) / (size * hop_s)
    inside = np.flatnonzero((hz >= low) & (hz <= high))
    if not len(inside) or m[inside].sum() <= 0:
        return 0.0, 0.0
    best = inside[m[inside].argmax()]
    return float(hz[best]), float(m[best] / m[inside].sum())


def extract(x: np.ndarray, rate: int = SAMPLE_RATE_HZ) -> dict:
    """All features of a window from one spectrogram."""
    x = np.asarray(x, float)
    spec = spectrogram(x)
    mean = average_spectrum(spec)
    flux = spectral_flux(spec)
    times = onsets(flux, STFT_HOP_SAMPLES / rate)
    strength, period = onset_periodicity(times)
    hop = max(1, half_up(rate / 100))
    env = levels(x[: len(x) // hop * hop].reshape(-1, hop)).astype(np.float32)
    am_hz, am_depth = modulation(env, hop / rate)
    return {
        "rms_dbfs": rms_level(x), "log_mel": log_mel(mean, mel_bank()), "bands": band_levels(mean), "peaks": find_peaks(mean), "flatness": flatness(mean), "centroid_hz": centroid(mean),
        "flux": float(flux.mean()) if len(flux) else 0.0, "onsets": times, "onset_periodicity": strength, "onset_period_s": period, "am_hz": am_hz, "am_depth": am_depth,
    }


def feature_vector(f: dict) -> np.ndarray:
    """77 numbers: shapes of mel and bands, then six scalars."""
    mel, bands = np.asarray(f["log_mel"]), np.asarray(f["bands"])
    return np.concatenate((mel - mel.mean(), bands - bands.mean(), [f[k] for k in ("rms_dbfs", "flatness", "centroid_hz", "flux", "am_hz", "am_depth")])).astype(np.float32)


def feature_names(edges=tuple(OCTAVE_BAND_EDGES_HZ), mels: int = MEL_BANDS) -> list[str]:
    """Names of the numbers of feature_vector, in order."""
    bands = [f"band balance {a:g}-{b:g} Hz" for a, b in zip(edges, edges[1:], strict=False)]
    return [*(f"mel shape[{i}]" for i in range(mels)), *bands, "level", "spectral flatness", "spectral centroid", "spectral flux", "AM rate", "AM depth"]


def describable_values(f: dict, edges=tuple(OCTAVE_BAND_EDGES_HZ)) -> dict[str, float]:
    """The scalars that an explanation can name: nine features, then each band's level above the window's."""
    hz, _, prominence = f["peaks"][0] if f["peaks"] else (0.0, 0.0, 0.0)
    out = {
        "level": f["rms_dbfs"], "spectralFlatness": f["flatness"], "spectralCentroidHz": f["centroid_hz"], "spectralFlux": f["flux"], "onsetPeriodicity": f["onset_periodicity"],
        "amplitudeModulationHz": f["am_hz"], "amplitudeModulationDepth": f["am_depth"], "peakFrequencyHz": hz, "peakProminenceDb": prominence,
    }
    return out | {f"band{half_up(a)}Hz": float(b - f["rms_dbfs"]) for a, b in zip(edges, f["bands"], strict=False)}


def yin(frame: np.ndarray, low: float = PITCH_MIN_HZ, high: float = PITCH_MAX_HZ, threshold: float = 0.15, rate: float = SAMPLE_RATE_HZ) -> tuple[float, float]:
    """(frequency, confidence), zeros if unvoiced."""
    f0, confidence = yin_frames(np.asarray(frame, float)[None, :], low, high, threshold, rate)
    return float(f0[0]), float(confidence[0])


def yin_frames(x: np.ndarray, low: float = PITCH_MIN_HZ, high: float = PITCH_MAX_HZ, threshold: float = 0.15, rate: float = SAMPLE_RATE_HZ) -> tuple[np.ndarray, np.ndarray]:
    """Frequency and confidence of every row, zeros where unvoiced; squared differences at all lags come from one FFT."""
    n, size = x.shape
    f0, confidence = np.zeros(n), np.zeros(n)
    max_lag, min_lag = min(int(rate // low), size // 2 - 1), max(2, int(rate // high))
    if max_lag <= min_lag or not n:
        return f0, confidence
    half, lags = size - max_lag, np.arange(max_lag + 1)
    fft = 1 << (size - 1).bit_length()
    # a circular product wraps lags beyond size - half only, which are not read
    cross = np.fft.irfft(np.fft.rfft(x, fft) * np.conj(np.fft.rfft(x[:, :half], fft)), fft)[:, : max_lag + 1]
    energy = np.zeros((n, size + 1))
    np.cumsum(np.square(x), axis=1, out=energy[:, 1:])
    shifted = energy[:, half : half + max_lag + 1] - energy[:, : max_lag + 1]
    diff = np.maximum(shifted + shifted[:, :1] - 2 * cross, 0)
    # differences lost in rounding are zero
    diff[diff < 1e-13 * energy[:, -1:]] = 0
    sums = np.cumsum(diff[:, 1:], axis=1)
    norm = np.ones((n, max_lag + 1), np.float32)
    norm[:, 1:] = np.where(sums > 0, diff[:, 1:] * lags[1:] / np.where(sums > 0, sums, 1), 1)
    inside = norm[:, min_lag:]
    below = inside < threshold
    any_below = below.any(1)
    # from the first lag below the threshold on, down to the next local minimum
    stop = np.ones((n, max_lag + 1), bool)
    stop[:, :-1] = norm[:, 1:] >= norm[:, :-1]
    stop[lags[None, :] < (min_lag + below.argmax(1))[:, None]] = False
    lag = np.where(any_below, stop.argmax(1), min_lag + inside.argmin(1))
    rows = np.arange(n)
    here = norm[rows, lag]
    voiced = any_below | (here <= 0.6)
    if min_lag > 2:
        # a shorter period explains the frame as well, up to rounding
        shorter = norm[:, 2:min_lag].min(1)
        voiced &= ~((shorter <= here + 1e-6) & (shorter < threshold))
    a, c = norm[rows, np.maximum(lag - 1, 0)].astype(float), norm[rows, np.minimum(lag + 1, max_lag)].astype(float)
    d = a - 2 * here.astype(float) + c
    shift = np.where((lag < max_lag) & (d != 0), np.clip(0.5 * (a - c) / np.where(d == 0, 1, d), -1, 1), 0)
    hz = rate / (lag + shift)
    voiced &= (hz >= low) & (hz <= high)
    return np.where(voiced, hz, 0), np.where(voiced, np.clip(1 - here, 0, 1), 0)


def track_pitch(x: np.ndarray, rate: int = SAMPLE_RATE_HZ, low: float = PITCH_MIN_HZ, high: float = PITCH_MAX_HZ, threshold: float = 0.15, silence: float = -60.0) -> list[tuple[float, float, float, float]]:
    """(t, f0, confidence, level) per frame, t at its centre."""
    size = max(half_up(rate * PITCH_FRAME_MS / 1000), int(np.ceil(2 * rate / low)) + 2)
    hop = max(1, half_up(rate * PITCH_HOP_MS / 1000))
    found = windows(np.asarray(x, float), size, hop)
    db = levels(found)
    loud = np.flatnonzero(db >= silence)
    f0, confidence = np.zeros(len(found)), np.zeros(len(found))
    f0[loud], confidence[loud] = yin_frames(found[loud], low, high, threshold, rate)
    t = (np.arange(len(found)) * hop + size / 2) / rate
    return list(zip(t.tolist(), f0.tolist(), confidence.tolist(), db.tolist(), strict=True))


def summarize_pitch(frames: list[tuple]) -> dict[str, float]:
    """Median, least and greatest voiced frequency, share of voiced frames and slope of the contour; zeros without a voiced frame."""
    voiced = [f for f in frames if f[1] > 0]
    if not voiced:
        return dict.fromkeys(("median_f0", "voiced_fraction", "min_f0", "max_f0", "slope"), 0.0)
    f0 = np.array([f[1] for f in voiced])
    return {"median_f0": float(np.median(f0)), "voiced_fraction": len(voiced) / len(frames), "min_f0": float(f0.min()), "max_f0": float(f0.max()), "slope": contour_slope([f[0] for f in voiced], f0)}


def contour_slope(t, f0) -> float:
    """Semitones a second by least squares; 0 for fewer than two frames or equal times."""
    t, y = np.asarray(t, float), np.asarray(f0, float)
    if len(t) < 2 or y[0] <= 0:
        return 0.0
    y = 12 * np.log2(y / y[0])
    n = len(t)
    d = n * np.square(t).sum() - t.sum() ** 2
    return 0.0 if abs(d) < 1e-12 else float((n * (t * y).sum() - t.sum() * y.sum()) / d)


def segment(levels, hop_s: float, open_db=12.0, close_db=6.0, least=0.04, most=5.0, bridge=0.06, dip=6.0) -> list[tuple[float, float, float, int]]:
    """(start, end, peak, syllables) by hysteresis over the 20th percentile."""
    v = np.asarray(levels, float)
    if not len(v):
        return []
    floor = float(np.percentile(v, 20))
    runs, start = [], None
    for i, x in enumerate(v):
        if start is None and x >= floor + open_db:
            start = i
        elif start is not None and x < floor + close_db:
            runs.append([start, i])
            start = None
    if start is not None:
        runs.append([start, len(v)])
    merged: list[list[int]] = []
    gap = half_up(bridge / hop_s)
    for r in runs:
        if merged and r[0] - merged[-1][1] <= gap:
            merged[-1][1] = r[1]
        else:
            merged.append(r)
    out = []
    for a, b in merged:
        b = min(b, a + max(1, half_up(most / hop_s)))
        if (b - a) * hop_s + 1e-12 >= least:
            out.append((a * hop_s, b * hop_s, float(v[a:b].max()), count_syllables(v[a:b], dip)))
    return out


def count_syllables(levels, dip: float = 6.0) -> int:
    """Peaks parted by valleys of ``dip``; one at least unless empty."""
    if not len(levels):
        return 0
    n, rising, peak, valley = 1, True, levels[0], levels[0]
    for x in levels:
        if rising:
            peak = max(peak, x)
            if peak - x >= dip:
                rising, valley = False, x
        else:
            valley = min(valley, x)
            if x - valley >= dip:
                rising, peak, n = True, x, n + 1
    return n


def random_numbers(seed: int, n: int) -> np.ndarray:
    """The first n numbers of the seeded generator."""
    with np.errstate(over="ignore"):
        x = (np.uint32(seed & 0xFFFFFFFF) + np.arange(1, n + 1, dtype=np.uint32) * np.uint32(0x6D2B79F5)).astype(np.uint32)
        t = (x ^ (x >> np.uint32(15))) * (x | np.uint32(1))
        t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
        return (t ^ (t >> np.uint32(14))) / 4294967296.0


def to_half(x: np.ndarray) -> np.ndarray:
    """Bits of float16 numbers, halves of a unit rounded away from zero."""
    u = np.asarray(x, np.float32).view(np.uint32).astype(np.int64)
    sign, exp, man = (u >> 16) & 0x8000, ((u >> 23) & 0xFF) - 112, u & 0x7FFFFF
    normal = sign + ((exp << 10) | (man >> 13)) + ((man >> 12) & 1)
    shift = np.clip(14 - exp, 0, 31)
    full = man | 0x800000
    small = np.where(exp < -10, sign, sign + (full >> shift) + ((full >> np.maximum(shift - 1, 0)) & 1))
    out = np.where(exp <= 0, small, np.where(exp >= 31, sign | 0x7C00, normal))
    return np.where(np.isnan(x), sign | 0x7E00, out).astype(np.uint16)


def from_half(bits: np.ndarray) -> np.ndarray:
    return np.asarray(bits, np.uint16).view(np.float16).astype(np.float32)
