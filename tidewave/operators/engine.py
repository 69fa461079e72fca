"""Per-window analysis: features and classes, then guards, then an embedding of the windows that the guards accept."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.constants import OCTAVE_BAND_EDGES_HZ
from tidewave.functions import signal
from tidewave.functions.labels import INTERFERENCE_CLASSES
from tidewave.functions.models import Classifier, Embedder
from tidewave.operators.windows import arrays

FEATURES = (
    "struct<rms_dbfs:double,log_mel:array<double>,bands:array<struct<low_hz:double,high_hz:double,level_dbfs:double>>,peaks:array<struct<frequency_hz:double,level_dbfs:double,prominence_db:double>>,"
    "spectral_flatness:double,spectral_centroid_hz:double,spectral_flux:double,onsets:array<double>,onset_periodicity:double,onset_period_s:double,am_hz:double,am_depth:double>"
)
CLASSES = "array<struct<label:string,score:double>>"
GUARD = "struct<accepted:boolean,reasons:array<string>,interference:struct<label:string,score:double>>"
WINDOW = f"t double, rms_dbfs double, embedding array<float>, classes {CLASSES}, features {FEATURES}, guard {GUARD}"
#: Windows whose results are gathered at once.
ROWS = 256


@dataclass(frozen=True)
class Guards:
    """The resolved settings of the guards."""

    floor_dbfs: float = -65.0
    ceiling_dbfs: float = -3.0
    interference_score: float = 0.35
    labels: tuple[str, ...] = tuple(INTERFERENCE_CLASSES)

    def check(self, rms: float, classes: list[tuple[str, float]]) -> dict:
        hits = [c for c in classes if c[0] in self.labels and c[1] >= self.interference_score]
        reasons = [name for name, bad in (("silence", rms < self.floor_dbfs), ("too-loud", rms > self.ceiling_dbfs), ("interference", bool(hits))) if bad]
        best = max(hits, key=lambda c: c[1], default=None)
        return {"accepted": not reasons, "reasons": reasons, "interference": None if best is None else {"label": best[0], "score": best[1]}}


def _features(x: np.ndarray) -> dict:
    f = signal.extract(x)
    return {
        "rms_dbfs": f["rms_dbfs"], "log_mel": f["log_mel"].tolist(),
        "bands": [{"low_hz": a, "high_hz": b, "level_dbfs": float(v)} for a, b, v in zip(OCTAVE_BAND_EDGES_HZ, OCTAVE_BAND_EDGES_HZ[1:], f["bands"], strict=False)],
        "peaks": [dict(zip(("frequency_hz", "level_dbfs", "prominence_db"), p, strict=True)) for p in f["peaks"]],
        "spectral_flatness": f["flatness"], "spectral_centroid_hz": f["centroid_hz"], "spectral_flux": f["flux"], "onsets": f["onsets"],
        "onset_periodicity": f["onset_periodicity"], "onset_period_s": f["onset_period_s"], "am_hz": f["am_hz"], "am_depth": f["am_depth"],
    }


def window_result(t: float, x: np.ndarray, classifier: Classifier | None, embedder: Embedder | None, guards: Guards | None, embed_rejected: bool) -> dict:
    """One window's result; without guards every window is embedded, and without a model its part is empty."""
    features = _features(x)
    classes = classifier.classify(x) if classifier else []
    verdict = guards.check(features["rms_dbfs"], classes) if guards else None
    wanted = embedder is not None and (verdict is None or verdict["accepted"] or embed_rejected)
    return {
        "t": t, "rms_dbfs": features["rms_dbfs"], "embedding": embedder.embed(x).tolist() if wanted else [], "classes": [{"label": a, "score": b} for a, b in classes], "features": features, "guard": verdict,
    }


def analyse(windows: DataFrame, classifier: Classifier | None = None, embedder: Embedder | None = None, guards: Guards | None = Guards(), embed_rejected: bool = False) -> DataFrame:  # noqa: B008
    """(stream_id, t, samples) to a result for each window, batch or streaming: no shuffle, models loaded once a worker, embedding run on accepted windows only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = windows.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {kind}, {WINDOW}"
    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                b = batch.slice(a, ROWS)
                rows = [window_result(t, x.astype(float), classifier, embedder, guards, embed_rejected) for t, x in zip(b.column(1).to_pylist(), arrays(b.column(2)), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(fields)[1:])], schema=fields)

    return windows.select("stream_id", F.col("t").cast("double"), F.col("samples").cast("array<float>")).mapInArrow(run, schema)


def accepted(windows: DataFrame) -> DataFrame:
    """The windows that the guards accepted."""
    return windows.where("guard.accepted")


def vectors_of(windows: DataFrame, embedding_space: bool) -> DataFrame:
    """``windows`` with a column vector: the embedding, or the feature vector, whose shapes are mel and band levels less their means."""
    if embedding_space:
        return windows.withColumn("vector", F.col("embedding").cast("array<double>"))
    shape = lambda a: F.transform(a, lambda x: x - F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))
    f = F.col("features")
    scalars = F.array(*(f[c] for c in ("rms_dbfs", "spectral_flatness", "spectral_centroid_hz", "spectral_flux", "am_hz", "am_depth")))
    return windows.withColumn("vector", F.concat(shape(f["log_mel"]), shape(F.transform(f["bands"], lambda b: b["level_dbfs"])), scalars).cast("array<float>").cast("array<double>"))


def has_embeddings(windows: DataFrame) -> bool:
    """Whether every window has an embedding."""
    return not windows.where(F.coalesce(F.size("embedding"), F.lit(0)) <= 0).head(1)


def feature_map(windows: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature, value): the scalars that an explanation can name, nine of each window and each band's level above the window's."""
    f = F.col("features")
    peak = F.get(f["peaks"], F.lit(0))
    named = {
        "level": f["rms_dbfs"], "spectralFlatness": f["spectral_flatness"], "spectralCentroidHz": f["spectral_centroid_hz"], "spectralFlux": f["spectral_flux"], "onsetPeriodicity": f["onset_periodicity"],
        "amplitudeModulationHz": f["am_hz"], "amplitudeModulationDepth": f["am_depth"], "peakFrequencyHz": F.coalesce(peak["frequency_hz"], F.lit(0.0)), "peakProminenceDb": F.coalesce(peak["prominence_db"], F.lit(0.0)),
    }
    scalars = F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in named.items()))
    bands = F.transform(f["bands"], lambda b: F.struct(F.concat(F.lit("band"), F.floor(b["low_hz"] + 0.5).cast("string"), F.lit("Hz")).alias("feature"), (b["level_dbfs"] - f["rms_dbfs"]).alias("value")))
    return windows.select(*keys, F.explode(F.concat(scalars, bands)).alias("x")).select(*keys, "x.*")
