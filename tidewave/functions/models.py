"""Wrappers of models that the caller supplies as loader functions: each worker loads a model once, when it first needs it.

A loader takes no argument and returns a callable.  No pretrained model is bundled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


def unit(x) -> np.ndarray:
    x = np.asarray(x, float)
    n = np.linalg.norm(x)
    return x / n if n > 0 else x


def merge_classifications(patches: Iterable[Iterable[tuple[str, float]]], most: int = 8) -> list[tuple[str, float]]:
    """The greatest score of each label over a model's patches, strongest first (the first met of equals); empty labels are skipped."""
    best: dict[str, float] = {}
    for patch in patches:
        for label, score in patch:
            if label:
                best[label] = max(score, best.get(label, score))
    return sorted(best.items(), key=lambda c: -c[1])[:most]


class _Loaded:
    def __init__(self, load: Callable[[], Callable] | None) -> None:
        if load is None:
            raise ValueError(f"{type(self).__name__} needs a loader")
        self._load, self._model = load, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def model(self) -> Callable:
        if self._model is None:
            self._model = self._load()
        return self._model

    def close(self) -> None:
        self._model = None


class Classifier(_Loaded):
    """Class scores of samples; the model returns patches of (label, score)."""

    def __init__(self, load: Callable[[], Callable] | None, max_results: int = 8, score_threshold: float = 0.02) -> None:
        super().__init__(load)
        self.max_results, self.score_threshold = max_results, score_threshold

    def classify(self, samples: np.ndarray) -> list[tuple[str, float]]:
        patches = [[c for c in patch if c[1] >= self.score_threshold] for patch in self.model()(samples)]
        return merge_classifications(patches, self.max_results)


class Embedder(_Loaded):
    """A vector of samples, of length 1 unless told otherwise."""

    def __init__(self, load: Callable[[], Callable] | None, l2_normalize: bool = True) -> None:
        super().__init__(load)
        self.l2_normalize = l2_normalize

    def embed(self, samples: np.ndarray) -> np.ndarray:
        x = np.asarray(self.model()(samples), float)
        return (unit(x) if self.l2_normalize else x).astype(np.float32)


class TextAudioEmbedder:
    """Vectors of audio and of text in one space; each tower is loaded when it is first used."""

    def __init__(self, load_audio: Callable[[], Callable], load_text: Callable[[], Callable], l2_normalize: bool = True) -> None:
        self._audio, self._text = Embedder(load_audio, l2_normalize), Embedder(load_text, l2_normalize)

    def embed_audio(self, samples: np.ndarray) -> np.ndarray:
        return self._audio.embed(samples)

    def embed_text(self, text: str) -> np.ndarray:
        return self._text.embed(text)

    def close(self) -> None:
        self._audio.close()
        self._text.close()
