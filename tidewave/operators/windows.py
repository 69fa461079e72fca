"""Operators on streams of windows: guards, class merging, feature statistics, watch mode, events, signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import columns as C
from tidewave.functions import signal
from tidewave.functions.labels import DESCRIPTIONS, HUMAN_VOICE_CLASSES, INTERFERENCE_CLASSES
from tidewave.functions.machines import EventDetector, StreamScorer


def guard(rms: Column, classes: Column, floor: float = -65, ceiling: float = -3, interference: float = 0.35, labels: list[str] = INTERFERENCE_CLASSES) -> Column:
    """Struct of accepted, reasons and the strongest interfering class."""
    hits = F.filter(classes, lambda c: c["label"].isin(labels) & (c["score"] >= interference))
    best = F.reduce(hits, F.get(hits, F.lit(0)), lambda s, c: F.when(c["score"] > s["score"], c).otherwise(s))
    reasons = F.array_compact(F.array(F.when(rms < floor, "silence"), F.when(rms > ceiling, "too-loud"), F.when(F.size(hits) > 0, "interference")))
    return F.struct((F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"), best.alias("interference"))


def human_score(classes: Column) -> Column:
    return C.max_score_of(classes, HUMAN_VOICE_CLASSES)


def merge_classes(rows: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, label, score, place): the greatest score of each label, strongest first; empty labels are skipped."""
    best = rows.where("label <> ''").groupBy(key, "label").agg(F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "label"))).where(F.col("place") <= most)


def feature_stats(rows: DataFrame, key: str, features: list[str], exact: bool = True) -> DataFrame:
    """(key, feature, mean, deviation, p05, p95), populations' deviations.

    All features are aggregated in one pass, one row a key, and turned to rows after.  Exact percentiles keep the distinct values of a
    key in one buffer; with ``exact`` false they are within 1/10000 of the rank, in bounded memory.
    """
    percentiles = (lambda c: F.percentile(c, F.array(F.lit(0.05), F.lit(0.95)))) if exact else (lambda c: F.percentile_approx(c, [0.05, 0.95], 10_000))

    def of(f: str) -> Column:
        c = F.col(f).cast("double")
        return F.struct(F.lit(f).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation"), percentiles(c).alias("p"))

    wide = rows.groupBy(key).agg(*(of(f).alias(f"_{i}") for i, f in enumerate(features)))
    long = wide.select(key, F.explode(F.array(*(f"_{i}" for i in range(len(features))))).alias("x"))
    return long.select(key, "x.feature", "x.mean", "x.deviation", F.col("x.p")[0].alias("p05"), F.col("x.p")[1].alias("p95"))


def long_features(rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, feature, value): one row for each feature of a row."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("x")
    return rows.select(key, pairs).select(key, "x.*")


def describe_difference(stats: DataFrame, seen: DataFrame, key: str, features: list[str], most: int = 3, least: float = 1.5) -> DataFrame:
    """(key, feature, value, mean, z, place, direction): features whose mean over ``seen`` is at least ``least`` deviations off, the furthest first."""
    wide = seen.groupBy(key).agg(*(F.avg(F.col(f).cast("double")).alias(f) for f in features))
    z = long_features(wide, key, features).join(stats, [key, "feature"]).where("deviation > 0").withColumn("z", (F.col("value") - F.col("mean")) / F.col("deviation")).where(F.abs("z") >= least)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("z")), "feature"))
    return z.withColumn("place", place).where(F.col("place") <= most).withColumn("direction", F.when(F.col("z") > 0, "higher").otherwise("lower"))


def descriptor_text(feature: Column, z: Column, value: Column, reference: Column) -> Column:
    """A sentence; features that are not described are bands or stand for themselves."""
    label, unit, word = C.band_label(feature), F.lit("dB"), F.when(z > 0, "louder").otherwise("quieter")
    for name, lab, u, up, down in DESCRIPTIONS:
        mine = feature == name
        label, unit, word = F.when(mine, lab).otherwise(label), F.when(mine, u).otherwise(unit), F.when(mine, F.when(z > 0, up).otherwise(down)).otherwise(word)
    gap = F.abs(value - reference)
    amount = F.when(unit == "", F.format_string("%.2f", gap)).otherwise(F.concat(C.format_number(gap), F.lit(" "), unit))
    return F.concat(C.capitalize(label), F.lit(" is "), word, F.lit(" than usual, by "), amount, F.lit("."))


def calibrated(watch: Column, anomalous: Column, verdict: Column, score: Column, rate: float = 0.5) -> Column:
    """Struct (watch, anomalous) after a verdict on a check."""
    lit = F.lit
    up_w = watch + rate * (F.least(lit(0.995), score + 0.01) - watch)
    up_a = F.greatest(up_w + 0.01, anomalous + rate * (F.least(lit(0.999), score + 0.02) - anomalous))
    down_a = anomalous - rate * (anomalous - F.greatest(lit(0.5), score - 0.01))
    down_w = F.least(down_a - 0.01, watch - rate * (watch - F.greatest(lit(0.4), score - 0.05)))
    up, down = (verdict == "normal") & (score >= watch), (verdict == "anomalous") & (score < anomalous)
    w, a = F.when(up, up_w).when(down, down_w).otherwise(watch), F.when(up, up_a).when(down, down_a).otherwise(anomalous)
    return F.struct(C.clamp(F.least(w, a - 0.005), 0.4, 0.995).alias("watch"), C.clamp(a, 0.45, 0.999).alias("anomalous"))


def drift(rows: DataFrame, key: str, order: list[str], score: str, recent: int = 60, reference: int = 240, delta: float = 0.15) -> DataFrame:
    """Columns drift and drifting: mean of the last rows less that of those before, 0 until both are full."""
    w = Window.partitionBy(key).orderBy(*order)
    full = F.count("*").over(w.rowsBetween(-(recent + reference - 1), 0)) == recent + reference
    gap = F.avg(score).over(w.rowsBetween(-(recent - 1), 0)) - F.avg(score).over(w.rowsBetween(-(recent + reference - 1), -recent))
    out = rows.withColumn("drift", F.when(full, gap).otherwise(F.lit(0.0)))
    return out.withColumn("drifting", full & (F.col("drift") >= delta))


def series(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, values): each stream's values in order.  A stream's order is its meaning: it is one row."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("a")).select(key, F.transform("a", lambda x: x[value].cast("double")).alias("values"))


def smoothed(values: Column, alpha: float = 0.2) -> Column:
    """Exponential average seeded with the first value, at the end of the series."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda s, x: s + alpha * (x - s))


def watch(rows: DataFrame, key: str, order: list[str], score: str, low: float, high: float, **options) -> DataFrame:
    """(key, place, smoothed, status, changed, drifting, drift) of each row in watch mode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, values in zip(b[key], b["values"], strict=True):
                s = StreamScorer(low, high, **options)
                out = [(k, i, *s.push(float(v))) for i, v in enumerate(values)]
                yield pd.DataFrame(out, columns=[key, "place", "smoothed", "status", "changed", "drifting", "drift"])

    kind = rows.schema[key].dataType.simpleString()
    return series(rows, key, order, score).mapInPandas(run, f"{key} {kind}, place int, smoothed double, status string, changed boolean, drifting boolean, drift double")


def merge_intervals(rows: DataFrame, key: str, gap: float) -> DataFrame:
    """(key, start, stop, n): intervals (start, stop) merged where one begins less than ``gap`` after the ends before it."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(before.isNull() | (F.col("start") - before >= gap), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("island")


def onset_times(candidates: DataFrame, key: str, hop_s: float, interval: float = 0.05) -> DataFrame:
    """(key, times): onsets (key, place) in order, each at least ``interval`` after the last one taken."""
    in_order = candidates.groupBy(key).agg(F.sort_array(F.collect_list("place")).alias("p"))
    none = F.array().cast("array<double>")
    take = lambda s, p: F.when((F.size(s) == 0) | (p * F.lit(hop_s) - F.element_at(s, -1) >= interval), F.concat(s, F.array(p * F.lit(hop_s)))).otherwise(s)
    # element_at of an empty array is never read: the first test is true
    return in_order.select(key, F.aggregate("p", none, take).alias("times"))


def pitch_summary(frames: DataFrame, key: str, t: str, f0: str) -> DataFrame:
    """(key, median_f0, voiced_fraction, min_f0, max_f0, slope) of pitch frames; a frame is voiced if f0 is above 0.

    The slope is that of semitones over time by least squares, 0 for fewer than two voiced frames or equal times: sums are pre-aggregated, no stream is gathered.
    """
    voiced = F.col(f0) > 0
    y = F.when(voiced, 12 * F.log2(F.col(f0)))
    only = lambda c: F.when(voiced, F.col(c))
    out = frames.groupBy(key).agg(
        F.expr(f"percentile(CASE WHEN {f0} > 0 THEN {f0} END, 0.5)").alias("median_f0"), F.avg(voiced.cast("double")).alias("voiced_fraction"), F.min(only(f0)).alias("min_f0"), F.max(only(f0)).alias("max_f0"),
        F.regr_slope(y, only(t)).alias("slope"),
    )
    return out.fillna(0.0, ["median_f0", "min_f0", "max_f0", "slope"])


def onset_candidates(rows: DataFrame, key: str, order: list[str], value: str, factor: float = 1.5, radius: int = 8, least: float = 0.05) -> DataFrame:
    """(key, place, value): interior local maxima above the median and mean deviation of the rows around."""
    w = Window.partitionBy(key).orderBy(*order)
    near = F.collect_list(value).over(w.rowsBetween(-radius, radius))
    x = rows.select(key, F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("place"), F.lag(value).over(w).alias("before"), F.lead(value).over(w).alias("after"), near.alias("near"))
    x = x.where((F.col("v") >= least) & (F.col("v") > F.col("before")) & (F.col("v") >= F.col("after"))).withColumn("m", C.median(F.col("near")))
    spread = C.mean(F.transform("near", lambda y: F.abs(y - F.col("m"))))
    return x.where(F.col("v") >= F.col("m") + factor * spread).select(key, "place", F.col("v").alias("value"))


#: Rows whose samples a kernel's results are gathered for at once; bounds what a task holds beside its batch.
KERNEL_ROWS = 256


def arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as views of its buffer; a null row is empty."""
    flat = column.values.to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _by_row(kernel, fields: list[tuple[str, pa.DataType]], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, KERNEL_ROWS):
                b = batch.slice(a, KERNEL_ROWS)
                rows = [kernel(x.astype(float)) for x in arrays(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields))], [key, *(n for n, _ in fields)])

    return run


def apply_kernel(rows: DataFrame, key: str, samples: str, kernel, **fields: str) -> DataFrame:
    """(key, fields): a kernel over each row's samples, which returns one value per field; Arrow batches in and out."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    types = [(n, to_arrow_type(_parse_datatype_string(t))) for n, t in fields.items()]
    kind = rows.schema[key].dataType.simpleString()
    schema = ", ".join([f"{key} {kind}", *(f"{n} {t}" for n, t in fields.items())])
    return rows.select(key, samples).mapInArrow(_by_row(kernel, types, key), schema)


def spectra(rows: DataFrame, key: str, samples: str, size: int, hop: int, fft: int) -> DataFrame:
    """(key, frame, spectrum): magnitudes of every frame, by real FFTs of whole batches."""
    signal.spectrogram(np.zeros(1), size, hop, fft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = [signal.spectrogram(v.astype(float), size, hop, fft) for v in arrays(b.column(1))]
            n = [len(p) for p in parts]
            flat = np.concatenate(parts) if parts else np.zeros((0, fft // 2 + 1))
            frames = np.concatenate([np.arange(c) for c in n]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(frames), lists], [key, "frame", "spectrum"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, samples).mapInArrow(run, f"{key} {kind}, frame int, spectrum array<double>")


def features(windows: DataFrame, key: str = "window_id", samples: str = "samples") -> DataFrame:
    """(key, vector, rms, flatness, centroid, flux, am_hz): all features of each window from one STFT."""

    def kernel(x: np.ndarray) -> tuple:
        f = signal.extract(x)
        return signal.feature_vector(f).tolist(), f["rms_dbfs"], f["flatness"], f["centroid_hz"], f["flux"], f["am_hz"]

    return apply_kernel(windows, key, samples, kernel, vector="array<float>", rms="double", flatness="double", centroid="double", flux="double", am_hz="double")


def detect_events(windows: DataFrame, triggers: list[str], **options) -> DataFrame:
    """(stream_id, start, stop, type, confidence, syllables): events of streams of (stream_id, t, samples, label, score) windows, in order of t.

    Windows are searched wherever they lie; only what was found, without samples, meets in the order of its stream, and is read row by row.
    """
    seen = pa.schema([("stream_id", pa.string()), ("t", pa.float64()), ("triggered", pa.bool_()), ("start", pa.float64()), ("end", pa.float64()), ("type", pa.string()), ("confidence", pa.float64()), ("syllables", pa.int32()), ("peak", pa.float64()), ("human", pa.bool_())])
    given = pa.schema([("stream_id", pa.string()), ("start", pa.float64()), ("stop", pa.float64()), ("type", pa.string()), ("confidence", pa.float64()), ("syllables", pa.int32())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = EventDetector(triggers, HUMAN_VOICE_CLASSES, **options)
        for b in batches:
            number = lambda i: b.column(i).to_numpy(zero_copy_only=False).astype(float).tolist()  # noqa: B023, E731
            rows = []
            for stream, t, x, label, score in zip(b.column(0).to_pylist(), number(1), arrays(b.column(2)), b.column(3).to_pylist(), number(4), strict=True):
                triggered, e = d.search(t, x, [(label, score)], describe=False)
                rows.append({"stream_id": stream, "t": t, "triggered": triggered} | (e or {}))
            yield pa.RecordBatch.from_pylist(rows, seen)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda stream, events: pa.RecordBatch.from_pylist([e | {"stream_id": stream, "stop": e["end"]} for e in events], given)
        d, stream = None, None
        for b in batches:
            for r in b.to_pylist():
                if d is None or r["stream_id"] != stream:
                    if d is not None:
                        yield rows(stream, d.flush())
                    d, stream = EventDetector(triggers, HUMAN_VOICE_CLASSES, **options), r["stream_id"]
                if out := d.take(r["triggered"], r if r["start"] is not None else None):
                    yield rows(stream, out)
        if d is not None:
            yield rows(stream, d.flush())

    columns = lambda s: ", ".join(f"{f.name} {({pa.string(): 'string', pa.float64(): 'double', pa.bool_(): 'boolean', pa.int32(): 'int'})[f.type]}" for f in s)
    found = windows.select(F.col("stream_id").cast("string"), F.col("t").cast("double"), "samples", "label", F.col("score").cast("double")).mapInArrow(search, columns(seen))
    return found.repartition("stream_id").sortWithinPartitions("stream_id", F.col("t").asc_nulls_last()).mapInArrow(fold, columns(given))
