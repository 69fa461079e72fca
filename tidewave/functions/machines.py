"""State machines over ordered windows; batch and streaming operators share them."""

from __future__ import annotations

from collections import deque

import numpy as np

from tidewave.constants import HOP_SAMPLES, HOP_SECONDS, SAMPLE_RATE_HZ, WINDOW_SAMPLES, WINDOW_SECONDS
from tidewave.functions.learning import status_for
from tidewave.functions.signal import extract, half_up, levels, segment, track_pitch, windows


class Framer:
    """Cuts a stream of chunks into overlapping frames; what is left waits for the next chunk."""

    def __init__(self, window: int = WINDOW_SAMPLES, hop: int = HOP_SAMPLES, rate: int = SAMPLE_RATE_HZ, tail=(), consumed: int = 0) -> None:
        if not 0 < hop <= window:
            raise ValueError("hop must be above 0 and no longer than the window")
        self.window, self.hop, self.rate = window, hop, rate
        self.tail, self.consumed = np.asarray(tail, np.float32), consumed

    def push(self, chunk) -> list[tuple[float, np.ndarray]]:
        self.tail = np.concatenate((self.tail, np.asarray(chunk, np.float32)))
        found = windows(self.tail, self.window, self.hop)
        out = [((self.consumed + i * self.hop) / self.rate, w.copy()) for i, w in enumerate(found)]
        self.tail = self.tail[len(found) * self.hop :].copy()
        self.consumed += len(found) * self.hop
        return out

    @property
    def pending(self) -> int:
        return len(self.tail)


class StreamScorer:
    """Smoothed score, status held against flicker, and drift of raw scores."""

    def __init__(self, watch: float, anomalous: float, smoothing: float = 0.2, hold: int = 3, recent: int = 60, reference: int = 240, delta: float = 0.15) -> None:
        if not 0 < smoothing <= 1:
            raise ValueError("smoothing must be in (0, 1]")
        self.watch, self.anomalous, self.smoothing, self.hold = watch, anomalous, smoothing, hold
        self.recent, self.reference, self.delta = recent, reference, delta
        self.smoothed, self.status, self.candidate, self.count = None, "normal", "normal", 0
        self.history: deque[float] = deque(maxlen=recent + reference)

    def push(self, score: float) -> tuple[float, str, bool, bool, float]:
        """(smoothed, status, whether it changed, drifting, drift)."""
        self.smoothed = score if self.smoothed is None else self.smoothed + self.smoothing * (score - self.smoothed)
        seen, changed = status_for(self.smoothed, self.watch, self.anomalous), False
        if seen == self.status:
            self.candidate, self.count = seen, 0
        else:
            self.count = self.count + 1 if seen == self.candidate else 1
            first = seen != self.candidate
            self.candidate = seen
            if self.count >= self.hold and not (first and self.hold > 1):
                self.status, self.count, changed = seen, 0, True
        self.history.append(score)
        gap = 0.0
        if len(self.history) == self.recent + self.reference:
            h = np.array(self.history)
            gap = float(h[self.reference :].mean() - h[: self.reference].mean())
        return self.smoothed, self.status, changed, bool(len(self.history) == self.recent + self.reference and gap >= self.delta), gap


class EventDetector:
    """Triggered windows to events: merged where the overlap shows one call twice, and debounced."""

    def __init__(self, triggers: list[str], human: list[str], score: float = 0.2, human_score: float = 0.3, debounce: float = 0.3, least: float = 0.05, most: float = 3.0, rate: int = SAMPLE_RATE_HZ) -> None:
        if not triggers:
            raise ValueError("one trigger class at least")
        self.triggers, self.human, self.score, self.human_score = triggers, human, score, human_score
        self.debounce, self.least, self.most, self.rate = debounce, least, most, rate
        self.last_end, self.pending = -np.inf, None

    def _emit(self) -> list[dict]:
        event, self.pending = self.pending, None
        if event is None or event["start"] - self.last_end < self.debounce:
            return []
        self.last_end = event["end"]
        return [event]

    def search(self, t: float, samples: np.ndarray, classes: list[tuple[str, float]], describe: bool = True) -> tuple[bool, dict | None]:
        """Whether a window has a trigger, and the event in it: of the window alone, whatever came before; without ``describe`` its features and pitch are left out."""
        hits = [c for c in classes if c[0] in self.triggers]
        best = max(hits, key=lambda c: c[1], default=None)
        if best is None or best[1] < self.score:
            return False, None
        hop = max(1, half_up(self.rate / 100))
        x = np.asarray(samples, float)
        env = levels(x[: len(x) // hop * hop].reshape(-1, hop))
        found = segment(env.astype(np.float32), hop / self.rate, most=self.most)
        if not found:
            return True, None
        s = max(found, key=lambda x: x[2])
        start, end = t + s[0], min(t + s[1], t + WINDOW_SECONDS)
        if end - start < self.least:
            return True, None
        human = max([c[1] for c in classes if c[0] in self.human], default=0.0) >= self.human_score
        event = {"start": start, "end": end, "type": best[0], "confidence": best[1], "syllables": s[3], "peak": s[2], "human": human}
        if describe:
            a = int(np.floor(s[0] * self.rate))
            audio = np.asarray(samples)[a : max(a + 1, int(np.ceil(s[1] * self.rate)))]
            event |= {"features": extract(audio, self.rate), "pitch": track_pitch(audio, self.rate)}
        return True, event

    def take(self, triggered: bool, event: dict | None) -> list[dict]:
        """What is over once a window's search is known; searches come in order of time."""
        if not triggered:
            return self._emit()
        if event is None:
            return []
        if self.pending is not None and event["start"] - self.pending["end"] < HOP_SECONDS:
            self.pending = merge_events(self.pending, event, self.most)
            return []
        out = self._emit()
        self.pending = event
        return out

    def push(self, t: float, samples: np.ndarray, classes: list[tuple[str, float]]) -> list[dict]:
        return self.take(*self.search(t, samples, classes))

    def flush(self) -> list[dict]:
        return self._emit()


def merge_events(a: dict, b: dict, most: float) -> dict:
    """The more confident of two events (the first of equals) over the span of both."""
    start = min(a["start"], b["start"])
    end = min(max(a["end"], b["end"]), start + most)
    both = {k: max(a[k], b[k]) for k in ("syllables", "peak", "confidence")}
    return (b if b["confidence"] > a["confidence"] else a) | {"start": start, "end": end, "human": a["human"] or b["human"]} | both
