"""Scalar and vector functions as Column expressions: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewave.constants import DBFS_FLOOR, SILENCE_EPSILON


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x)


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def clamp_nan_low(v: Column, low, high) -> Column:
    """clamp, with NaN as the low end."""
    return F.when(F.isnan(v), F.lit(low)).otherwise(clamp(v, low, high))


def mean(a: Column) -> Column:
    """Mean of an array, 0 if it is empty."""
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(F.lit(0.0))


def standard_deviation(a: Column) -> Column:
    """Population deviation, 0 for fewer than two values."""
    m = mean(a)
    return F.when(F.size(a) < 2, F.lit(0.0)).otherwise(F.sqrt(total(F.transform(doubles(a), lambda x: (x - m) * (x - m))) / F.size(a)))


def percentile(a: Column, p: float) -> Column:
    """Percentile by linear interpolation between ranks, 0 if empty; p in 0..100 is clamped."""
    p = min(100.0, max(0.0, p))
    s, n = F.sort_array(doubles(a)), F.size(a)
    rank = F.lit(p / 100) * (n - 1)
    low = F.floor(rank).cast("int")
    x, y = F.get(s, low), F.get(s, F.least(low + 1, n - 1))
    return F.when(n == 0, F.lit(0.0)).otherwise(x + (y - x) * (rank - low))


def median(a: Column) -> Column:
    return percentile(a, 50)


def percentile_rank(s: Column, v: Column) -> Column:
    """Rank in 0..1 of v in a sorted array: 0 up to the first value, 1 from the last, else interpolated."""
    s, n = doubles(s), F.size(s)
    at = F.size(F.filter(s, lambda x: x <= v)) - 1
    x, y = F.get(s, at), F.get(s, at + 1)
    part = F.when(y > x, (v - x) / (y - x)).otherwise(F.lit(0.0))
    return F.when((n == 0) | (v <= F.get(s, F.lit(0))), F.lit(0.0)).when(v >= F.get(s, n - 1), F.lit(1.0)).otherwise((at + part) / (n - 1))


def amplitude_to_dbfs(v: Column) -> Column:
    return F.when(v < SILENCE_EPSILON, F.lit(DBFS_FLOOR)).otherwise(F.greatest(F.lit(DBFS_FLOOR), 20 * F.log10(v)))


def power_to_db(v: Column) -> Column:
    return F.when(v <= 0, F.lit(DBFS_FLOOR)).otherwise(F.greatest(F.lit(DBFS_FLOOR), 10 * F.log10(v)))


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def semitones(low: Column, high: Column) -> Column:
    """Distance of two frequencies; 0 if one is not positive."""
    return F.when((low <= 0) | (high <= 0), F.lit(0.0)).otherwise(12 * F.log2(high / low))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if a vector is zero."""
    x, y = norm(a), norm(b)
    return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(dot(a, b) / (x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def next_power_of_two(n: Column) -> Column:
    """At least 8."""
    return F.greatest(F.lit(8), F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("int"))


def _multiply32(a: Column, b: Column) -> Column:
    """Product modulo 2^32 in halves, so that no 64-bit product overflows."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return (a * low + F.pmod(a * high, F.lit(65536)) * 65536).bitwiseAND(F.lit(0xFFFFFFFF))


def random_draw(seed: Column, i: Column) -> Column:
    """The i-th (from 0) number in [0, 1) of the seeded generator: each is computed from its place alone."""
    mask, long = F.lit(0xFFFFFFFF), "long"
    x = (seed.cast(long) + F.pmod((i.cast(long) + 1) * 0x6D2B79F5, F.lit(1 << 32))).bitwiseAND(mask)
    t = _multiply32(x.bitwiseXOR(F.shiftright(x, 15)), x.bitwiseOR(F.lit(1).cast(long)))
    t = t.bitwiseXOR((t + _multiply32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast(long)))).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


# levels and framing


def rms_dbfs(a: Column) -> Column:
    rms = F.sqrt(total(F.transform(doubles(a), lambda x: x * x)) / F.size(a))
    return F.when(F.size(a) == 0, F.lit(DBFS_FLOOR)).otherwise(amplitude_to_dbfs(rms))


def peak_dbfs(a: Column) -> Column:
    return F.when(F.size(a) == 0, F.lit(DBFS_FLOOR)).otherwise(amplitude_to_dbfs(F.array_max(F.transform(doubles(a), F.abs))))


def frames(a: Column, window: int, hop: int) -> Column:
    """Overlapping windows; a partial tail is dropped."""
    if not 0 < hop <= window:
        raise ValueError("hop must be above 0 and no longer than the window")
    n = F.when(F.size(a) >= window, F.floor((F.size(a) - window) / F.lit(hop)).cast("int") + 1).otherwise(0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(a, k * hop + 1, window))).otherwise(F.slice(F.array(a), 1, 0))


def envelope(a: Column, hop: int) -> Column:
    """Levels of windows that do not overlap."""
    return F.transform(frames(a, hop, hop), rms_dbfs)


def mono(a: Column, channels: int) -> Column:
    """Mean of interleaved channels; a ragged tail is dropped."""
    if channels <= 1:
        return a
    return F.transform(frames(a, channels, channels), mean)


# quantisation and text


def quantize_int8(a: Column) -> Column:
    """Struct of scale and values in -127..127, halves rounded up."""
    peak = F.coalesce(F.array_max(F.transform(doubles(a), F.abs)), F.lit(0.0))
    scale = F.when(peak > 0, peak / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(doubles(a), lambda x: clamp(F.floor(x / scale + 0.5), -127, 127).cast("int")).alias("data"))


def dequantize_int8(q: Column) -> Column:
    return F.transform(q["data"], lambda x: x * q["scale"])


def dequantize_checked(scale: Column, payload: Column, length: int) -> Column:
    """Values of a base64 payload of signed bytes; another length than ``length`` is an error."""
    raw = F.unbase64(payload)
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
    values = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (F.when(byte(i) > 127, byte(i) - 256).otherwise(byte(i))) * scale)
    return F.when(F.octet_length(raw) == length, values).otherwise(F.raise_error(F.lit(f"a payload of {length} bytes is needed")).cast("array<double>"))


def int8_payload(q: Column) -> Column:
    """Base64 of the signed bytes of quantize_int8."""
    bytes_ = F.transform(q["data"], lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256)).cast("long")), 2, "0"))
    return base64_plain(F.unhex(F.array_join(bytes_, "")))


def float16_value(v: Column) -> Column:
    """The value that float16 keeps of a number within its range, halves of a unit rounded away from zero."""
    a = F.abs(v.cast("float").cast("double"))
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(a)), F.lit(-14)) - 10)
    return F.when(a == 0, F.lit(0.0)).otherwise(F.signum(v) * F.floor(a / step + 0.5) * step)


def base64_plain(b: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(b), r"[\r\n]", "")


def format_number(v: Column) -> Column:
    a = F.abs(v)
    return F.when(a >= 100, F.format_string("%.0f", v)).when(a >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))


def format_hz(v: Column) -> Column:
    return F.when(v >= 1000, F.concat(format_number(v / 1000), F.lit(" kHz"))).otherwise(F.concat(format_number(v), F.lit(" Hz")))


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def band_label(key: Column) -> Column:
    hz = F.regexp_extract(key, r"^band(\d+)Hz$", 1)
    return F.when(hz != "", F.concat(F.lit("the "), hz, F.lit(" Hz band"))).otherwise(key)


# class lists: arrays of struct(label, score)


def score_of(classes: Column, label: str) -> Column:
    return F.coalesce(F.get(F.filter(classes, lambda c: c["label"] == label), F.lit(0))["score"], F.lit(0.0))


def possibly_human(classes: Column, labels: list[str], least: float = 0.3) -> Column:
    """Whether a class of the labels scores at least ``least``."""
    return max_score_of(classes, labels) >= least


def max_score_of(classes: Column, labels: list[str]) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(F.filter(classes, lambda c: c["label"].isin(labels)), lambda c: c["score"])), F.lit(0.0)))
