"""Structured Streaming forms of the state machines, by applyInPandasWithState."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewave.constants import HOP_SAMPLES, SAMPLE_RATE_HZ, WINDOW_SAMPLES
from tidewave.functions.labels import HUMAN_VOICE_CLASSES
from tidewave.functions.machines import EventDetector, Framer, StreamScorer


def _ordered(parts: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(by, kind="stable")


def frame_stream(chunks: DataFrame, window: int = WINDOW_SAMPLES, hop: int = HOP_SAMPLES, rate: int = SAMPLE_RATE_HZ) -> DataFrame:
    """(stream_id, chunk_seq, samples) to (stream_id, t, samples): frames, chunks in order of chunk_seq within a batch."""
    Framer(window, hop, rate)

    def run(key, parts, state: GroupState) -> Iterator[pd.DataFrame]:
        tail, consumed = state.get if state.exists else ([], 0)
        framer = Framer(window, hop, rate, tail, consumed)
        found = [f for c in _ordered(parts, "chunk_seq")["samples"] for f in framer.push(c)]
        state.update((framer.tail.tolist(), framer.consumed))
        yield pd.DataFrame({"stream_id": [key[0]] * len(found), "t": [t for t, _ in found], "samples": [x for _, x in found]})

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, t double, samples array<float>", "tail array<float>, consumed long", "append", GroupStateTimeout.NoTimeout)


def watch_stream(scores: DataFrame, watch: float, anomalous: float, **options) -> DataFrame:
    """(stream_id, t, score) to (stream_id, t, smoothed, status, changed, drifting, drift)."""
    StreamScorer(watch, anomalous, **options)

    def run(key, parts, state: GroupState) -> Iterator[pd.DataFrame]:
        s = StreamScorer(watch, anomalous, **options)
        if state.exists:
            smoothed, s.status, s.candidate, s.count, history = state.get
            s.smoothed = smoothed
            s.history.extend(history)
        rows = _ordered(parts, "t")
        out = [s.push(float(x)) for x in rows["score"]]
        state.update((s.smoothed, s.status, s.candidate, s.count, list(s.history)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "t": rows["t"].to_numpy(float), "smoothed": columns[0], "status": columns[1], "changed": columns[2], "drifting": columns[3], "drift": np.array(columns[4], float)})

    state = "smoothed double, status string, candidate string, count int, history array<double>"
    return scores.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, t double, smoothed double, status string, changed boolean, drifting boolean, drift double", state, "append", GroupStateTimeout.NoTimeout)


def event_stream(windows: DataFrame, triggers: list[str], **options) -> DataFrame:
    """(stream_id, t, samples, classes) to (stream_id, start, stop, type, confidence, syllables, human).

    An event is given out once a later window shows that it is over: the last one of a stream waits for the next window.
    Windows of a batch are taken in order of t; the state is the event that may still be merged and the end of the last one given out.
    """
    EventDetector(triggers, HUMAN_VOICE_CLASSES, **options)

    def run(key, parts, state: GroupState) -> Iterator[pd.DataFrame]:
        d = EventDetector(triggers, HUMAN_VOICE_CLASSES, **options)
        if state.exists:
            last_end, pending = state.get
            d.last_end, d.pending = last_end, pickle.loads(pending) if pending else None
        out = []
        for r in _ordered(parts, "t").itertuples():
            out += d.push(r.t, np.asarray(r.samples), [(c["label"], c["score"]) for c in r.classes])
        state.update((float(d.last_end), pickle.dumps(d.pending) if d.pending else b""))
        yield pd.DataFrame([(key[0], e["start"], e["end"], e["type"], e["confidence"], e["syllables"], e["human"]) for e in out], columns=["stream_id", "start", "stop", "type", "confidence", "syllables", "human"])

    return windows.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, start double, stop double, type string, confidence double, syllables int, human boolean", "last_end double, pending binary", "append", GroupStateTimeout.NoTimeout)
