"""Seeded signals of known content."""

from __future__ import annotations

import numpy as np

from tidewave.constants import SAMPLE_RATE_HZ
from tidewave.functions.signal import random_numbers


def _times(seconds: float, rate: int) -> np.ndarray:
    return np.arange(round(seconds * rate)) / rate


def silence(seconds: float, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    return np.zeros(round(seconds * rate), np.float32)


def tone(seconds: float, hz: float, amplitude: float = 0.3, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    return (amplitude * np.sin(2 * np.pi * hz * _times(seconds, rate))).astype(np.float32)


def white_noise(seconds: float, amplitude: float = 0.1, seed: int = 1, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    return ((random_numbers(seed, round(seconds * rate)) * 2 - 1) * amplitude).astype(np.float32)


def pink_noise(seconds: float, amplitude: float = 0.1, seed: int = 1, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    """Sixteen rows of noise, row r drawn anew every 2^r samples, averaged."""
    n = round(seconds * rate)
    i = np.arange(n)
    rows = [(random_numbers(seed + 31 * r, (n >> r) + 1) * 2 - 1)[i >> r] for r in range(16)]
    return (3 * amplitude * np.mean(rows, 0)).astype(np.float32)


def whine(x: np.ndarray, hz: float, amplitude: float = 0.05, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    return x + tone(len(x) / rate, hz, amplitude, rate)[: len(x)]


def gain(x: np.ndarray, db: float) -> np.ndarray:
    return (x * 10 ** (db / 20)).astype(np.float32)


def knocks(seconds: float, every: float = 0.5, decay: float = 0.03, amplitude: float = 0.6, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    t = _times(seconds, rate) % every
    return (amplitude * np.exp(-t / decay) * sum(np.sin(2 * np.pi * f * t) for f in (180, 460, 1130)) / 3).astype(np.float32)


def modulated(x: np.ndarray, hz: float, depth: float = 0.5, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    return (x * (1 - depth * (0.5 - 0.5 * np.sin(2 * np.pi * hz * np.arange(len(x)) / rate)))).astype(np.float32)


def harmonic_call(seconds: float, hz: float, contour: str = "flat", harmonics: int = 5, amplitude: float = 0.4, fade: float = 0.03, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    u = np.linspace(0, 1, round(seconds * rate), endpoint=False)
    f = hz * {"flat": 1 + 0 * u, "rising": 0.8 + 0.4 * u, "falling": 1.2 - 0.4 * u, "arc": 0.85 + 0.3 * np.sin(np.pi * u)}[contour]
    phase = 2 * np.pi * np.cumsum(f) / rate
    x = sum(np.sin(h * phase) / h for h in range(1, harmonics + 1))
    edge = np.minimum(1, np.minimum(u, 1 - u) * seconds / fade)
    return (amplitude * edge * x / sum(1 / h for h in range(1, harmonics + 1))).astype(np.float32)


def human_imitation(seconds: float, hz: float, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    x = harmonic_call(seconds, 0.55 * hz, "arc", 12, 0.4, 0.03, rate)
    return x + white_noise(seconds, 0.02, 5, rate)[: len(x)]


def concat(*parts: np.ndarray, gap: int = 0) -> np.ndarray:
    out: list[np.ndarray] = []
    for i, p in enumerate(parts):
        out += ([np.zeros(gap, np.float32)] if i and gap else []) + [p]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return a[:n] + b[:n]
