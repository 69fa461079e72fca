"""WAV files as tables, read with Spark's binaryFile source and a decoder of our own."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.constants import SAMPLE_RATE_HZ
from tidewave.functions.signal import resample


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """(interleaved samples in -1..1, rate, channels); chunks of odd size are padded."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        chunk = data[at + 8 : at + 8 + size]
        form, body = (chunk if name == b"fmt " else form), (chunk if name == b"data" else body)
        at += 8 + size + size % 2
    if form is None or body is None:
        raise ValueError("a chunk is missing")
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    body = body[: len(body) // (bits // 8) * (bits // 8)]
    if kind == 3 and bits == 32:
        x = np.frombuffer(body, "<f4").astype(np.float32)
    elif kind != 1:
        raise ValueError(f"format {kind} is not supported")
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 16:
        x = np.frombuffer(body, "<i2") / np.float32(32768)
    elif bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / np.float32(8388608)
    elif bits == 32:
        x = np.frombuffer(body, "<i4") / np.float32(2147483648)
    else:
        raise ValueError(f"{bits} bits are not supported")
    return x.astype(np.float32), rate, channels


def encode(x: np.ndarray, rate: int = SAMPLE_RATE_HZ) -> bytes:
    """Mono, 16 bits."""
    body = np.clip(np.round(np.asarray(x, float) * 32767), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def decode_mono(data: bytes, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    """Mean of the channels at ``rate``, by linear interpolation without a low-pass."""
    x, source, channels = decode(data)
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    return resample(x, source, rate, smooth=False)


def read_wav(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """path, label (second part of the file's name between underscores), sample_rate, samples; any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    files = files.orderBy("path").limit(limit) if limit else files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "sample_rate": SAMPLE_RATE_HZ, "samples": [decode_mono(c) for c in b["content"]]})

    out = files.mapInPandas(run, "path string, sample_rate int, samples array<float>")
    return out.withColumn("label", F.split(F.regexp_extract("path", r"([^/]*)$", 1), "_")[1])
