"""Queries over the tables, each with the SQL that gives the same rows, if there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.functions import columns as C
from tidewave.functions import learning, signal
from tidewave.operators import vectors as V
from tidewave.operators import windows as W
from tidewave.sources import synthetic

#: Vectors of a label that the MLP head learns from at most: training is a sequence of small steps on the driver.
HEAD_ROWS = 200
#: Windows of audio made at once: 4 MB of samples.
AUDIO_ROWS = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + 0.0


EMB = "CAST(embedding AS DOUBLE[])"
SUMSQ = f"list_sum(list_transform({EMB}, lambda x: x * x))"


@query(f"""
SELECT vec_id, round(sqrt({SUMSQ}), 6) + 0.0 AS norm, round(list_avg({EMB}), 6) + 0.0 AS mean, round(list_stddev_pop({EMB}), 6) + 0.0 AS deviation,
       round(list_aggregate({EMB}, 'quantile_cont', 0.5), 6) + 0.0 AS median, round(list_aggregate({EMB}, 'quantile_cont', 0.9), 6) + 0.0 AS p90,
       round(greatest(-120, 20 * log10(sqrt({SUMSQ} / len(embedding)))), 6) + 0.0 AS rms_dbfs,
       round(greatest(-120, 20 * log10(list_max(list_transform({EMB}, lambda x: abs(x))))), 6) + 0.0 AS peak_dbfs
FROM embeddings""")
def vector_math(s, d):
    e = F.col("embedding")
    return _t(s, d, "embeddings").select("vec_id", r6(C.norm(e)).alias("norm"), r6(C.mean(e)).alias("mean"), r6(C.standard_deviation(e)).alias("deviation"), r6(C.median(e)).alias("median"), r6(C.percentile(e, 90)).alias("p90"), r6(C.rms_dbfs(e)).alias("rms_dbfs"), r6(C.peak_dbfs(e)).alias("peak_dbfs"))


@query("""
SELECT s_suppkey, round(least(greatest(s_acctbal, 0), 5000), 6) + 0.0 AS clamped, round(CASE WHEN s_acctbal <= 0 THEN -120 ELSE greatest(-120, 10 * log10(s_acctbal)) END, 6) + 0.0 AS db,
       round(CASE WHEN s_acctbal <= 0 THEN 0 ELSE 12 * log2(s_acctbal / 440) END, 6) + 0.0 AS st, round(2595 * log10(1 + abs(s_acctbal) / 700), 6) + 0.0 AS mel,
       CAST(greatest(8, pow(2, ceil(log2(s_suppkey + 1)))) AS INTEGER) AS pow2
FROM supplier""")
def scalar_math(s, d):
    b = F.col("s_acctbal")
    return _t(s, d, "supplier").select(
        "s_suppkey", r6(C.clamp(b, 0.0, 5000.0)).alias("clamped"), r6(C.power_to_db(b)).alias("db"), r6(C.semitones(F.lit(440.0), b)).alias("st"),
        r6(C.hz_to_mel(F.abs(b))).alias("mel"), C.next_power_of_two(F.col("s_suppkey") + 1).alias("pow2"),
    )


MULBERRY = """
WITH a AS (SELECT p_partkey, (7 + (CAST(p_partkey AS HUGEINT) * 1831565813)) % 4294967296 AS x FROM part),
b AS (SELECT p_partkey, xor(CAST(x AS BIGINT), CAST(x AS BIGINT) >> 15) AS l, (CAST(x AS BIGINT) | 1) AS r FROM a),
c AS (SELECT p_partkey, CAST((CAST(l AS HUGEINT) * r) % 4294967296 AS BIGINT) AS t FROM b),
e AS (SELECT p_partkey, xor(t, CAST((t + (CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296) % 4294967296 AS BIGINT)) AS t FROM c)
SELECT p_partkey, round(xor(t, t >> 14) / 4294967296.0::DOUBLE, 9) AS draw FROM e"""


@query(MULBERRY)
def seeded_random(s, d):
    return _t(s, d, "part").select("p_partkey", F.round(C.random_draw(F.lit(7), F.col("p_partkey") - 1), 9).alias("draw"))


@query(r"""
SELECT p_partkey, CASE WHEN p_retailprice >= 1000 THEN printf('%.2f', p_retailprice / 1000) || ' kHz' WHEN p_retailprice >= 100 THEN CAST(CAST(floor(p_retailprice + 0.5) AS BIGINT) AS VARCHAR) || ' Hz' ELSE printf('%.2f', p_retailprice) || ' Hz' END AS hz,
       upper(left(p_name, 1)) || substr(p_name, 2) AS name, to_base64(encode(p_type)) AS code, CASE WHEN p_size > 5 THEN 'the ' || p_size || ' Hz band' ELSE 'level' || p_size || 'Hz' END AS band
FROM part""")
def text_functions(s, d):
    hz = C.format_hz(F.col("p_retailprice"))
    return _t(s, d, "part").select("p_partkey", hz.alias("hz"), C.capitalize(F.col("p_name")).alias("name"), C.base64_plain(F.encode("p_type", "UTF-8")).alias("code"), C.band_label(F.concat(F.when(F.col("p_size") > 5, "band").otherwise("level"), F.col("p_size"), F.lit("Hz"))).alias("band"))


@query(f"""
WITH a AS (SELECT vec_id, {EMB} AS e, CASE WHEN list_max(list_transform({EMB}, lambda x: abs(x))) > 0 THEN list_max(list_transform({EMB}, lambda x: abs(x))) / 127 ELSE 1.0::DOUBLE END AS scale FROM embeddings)
SELECT vec_id, round(scale, 9) AS scale, array_to_string(list_transform(e, lambda x: CAST(least(greatest(floor(x / scale + 0.5), -127), 127) AS INTEGER)), ',') AS data,
       round(list_max(list_transform(e, lambda x: abs(x - least(greatest(floor(x / scale + 0.5), -127), 127) * scale))), 6) + 0.0 AS worst FROM a""")
def quantize_int8(s, d):
    e = C.doubles(F.col("embedding"))
    rows = _t(s, d, "embeddings").select("vec_id", e.alias("e"), C.quantize_int8(e).alias("q"))
    worst = F.array_max(F.zip_with("e", C.dequantize_int8(F.col("q")), lambda x, y: F.abs(x - y)))
    return rows.select("vec_id", F.round("q.scale", 9).alias("scale"), F.array_join("q.data", ",").alias("data"), r6(worst).alias("worst"))


@query(f"""
WITH f AS (SELECT vec_id, unnest(range(0, 7)) AS frame, {EMB} AS e FROM embeddings), g AS (SELECT vec_id, frame, e[frame * 8 + 1:frame * 8 + 16] AS w FROM f)
SELECT vec_id, CAST(frame AS INTEGER) AS frame, round(greatest(-120, 20 * log10(sqrt(list_sum(list_transform(w, lambda x: x * x)) / 16))), 6) + 0.0 AS level FROM g""")
def framing(s, d):
    rows = _t(s, d, "embeddings").select("vec_id", F.posexplode(C.frames(F.col("embedding"), 16, 8)).alias("frame", "w"))
    return rows.select("vec_id", "frame", r6(C.rms_dbfs(F.col("w"))).alias("level"))


@query(f"""
WITH f AS (SELECT vec_id, unnest(range(0, 16)) AS hop, {EMB} AS e FROM embeddings)
SELECT vec_id, CAST(hop AS INTEGER) AS hop, round(greatest(-120, 20 * log10(sqrt(list_sum(list_transform(e[hop * 4 + 1:hop * 4 + 4], lambda x: x * x)) / 4))), 6) + 0.0 AS level,
       round((e[hop * 4 + 1] + e[hop * 4 + 2]) / 2, 6) + 0.0 AS mono FROM f""")
def envelope(s, d):
    e = F.col("embedding")
    pairs = F.zip_with(C.envelope(e, 4), F.filter(C.mono(e, 2), lambda x, i: i % 2 == 0), lambda x, y: F.struct(x.alias("level"), y.alias("mono")))
    rows = _t(s, d, "embeddings").select("vec_id", F.posexplode(pairs).alias("hop", "x"))
    return rows.select("vec_id", "hop", r6(F.col("x.level")).alias("level"), r6(F.col("x.mono")).alias("mono"))


@query(f"""
WITH a AS (SELECT vec_id, {EMB} AS e FROM embeddings), b AS (SELECT vec_id, e, unnest(range(0, 128)) AS i FROM a)
SELECT vec_id, round(sum(CASE WHEN i % 2 = 0 THEN e[i // 2 + 1] ELSE CAST((e[i // 2 + 1] + e[least(i // 2 + 2, 64)]) / 2 AS FLOAT) END), 4) + 0.0 AS total, count(*) AS n FROM b GROUP BY vec_id""")
def resample_up(s, d):
    def kernel(x):
        y = signal.resample(x, 8000, 16000)
        return float(y.astype(float).sum()), len(y)

    out = W.apply_kernel(_t(s, d, "embeddings"), "vec_id", "embedding", kernel, total="double", n="long")
    return out.select("vec_id", (F.round("total", 4) + 0.0).alias("total"), "n")


DFT = f"""x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest({EMB}) AS v FROM embeddings),
m AS (SELECT vec_id, k.k AS bin, sqrt(pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * cos(2 * pi() * k.k * i / 64)), 2) + pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * sin(2 * pi() * k.k * i / 64)), 2)) * 2 / 32 AS mag
      FROM x, (SELECT unnest(range(0, 33)) AS k) k GROUP BY vec_id, k.k)"""


def _spectra(s, d):
    return W.spectra(_t(s, d, "embeddings"), "vec_id", "embedding", 64, 64, 64).drop("frame")


@query(f"WITH {DFT} SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(mag, 6) + 0.0 AS mag, bin * 250.0::DOUBLE AS hz FROM m")
def dft_magnitude(s, d):
    return _spectra(s, d).select("vec_id", F.posexplode("spectrum").alias("bin", "m")).select("vec_id", "bin", r6(F.col("m")).alias("mag"), (F.col("bin") * 250.0).alias("hz"))


@query(f"""WITH {DFT}
SELECT vec_id, round(least(1, exp(avg(ln(mag * mag + 1e-20)) FILTER (bin > 0)) / (avg(mag * mag + 1e-20) FILTER (bin > 0))), 6) + 0.0 AS flatness,
       round((sum(mag * bin * 250) FILTER (bin > 0)) / (sum(mag) FILTER (bin > 0)), 4) + 0.0 AS centroid FROM m GROUP BY vec_id""")
def spectral_shape(s, d):
    out = W.apply_kernel(_spectra(s, d), "vec_id", "spectrum", lambda m: (signal.flatness(m), signal.centroid(m, 16000, 64)), flatness="double", centroid="double")
    return out.select("vec_id", r6(F.col("flatness")).alias("flatness"), (F.round("centroid", 4) + 0.0).alias("centroid"))


@query(f"""WITH {DFT}, e AS (SELECT unnest([62.5, 125, 250, 500, 1000, 2000, 4000]::DOUBLE[]) AS low)
SELECT vec_id, low, round(CASE WHEN coalesce(sum(mag * mag), 0) <= 0 THEN -120 ELSE greatest(-120, 10 * log10(sum(mag * mag))) END, 6) + 0.0 AS level
FROM (SELECT DISTINCT vec_id FROM embeddings) v CROSS JOIN e LEFT JOIN m USING (vec_id) WHERE FALSE GROUP BY vec_id, low
UNION ALL SELECT v.vec_id, e.low, round(coalesce((SELECT CASE WHEN sum(mag * mag) > 0 THEN greatest(-120, 10 * log10(sum(mag * mag))) ELSE -120 END FROM m WHERE m.vec_id = v.vec_id AND bin > 0 AND bin * 250 >= e.low AND bin * 250 < 2 * e.low), -120), 6) + 0.0 FROM embeddings v CROSS JOIN e""")
def band_energies(s, d):
    out = W.apply_kernel(_spectra(s, d), "vec_id", "spectrum", lambda m: (signal.band_levels(m, rate=16000, fft=64).tolist(),), levels="array<double>")
    return out.select("vec_id", F.posexplode("levels").alias("i", "level")).select("vec_id", (62.5 * F.pow(F.lit(2.0), F.col("i"))).alias("low"), r6(F.col("level")).alias("level"))


@query(f"""WITH {DFT}, g AS (SELECT unnest(range(0, 8)) AS b, 2595 * log10(1 + 125.0::DOUBLE / 700) AS lo, 2595 * log10(1 + 7500.0::DOUBLE / 700) AS hi),
h AS (SELECT b, CAST(CAST(700 * (pow(10, (lo + (hi - lo) * b / 9) / 2595) - 1) AS FLOAT) AS DOUBLE) AS l, CAST(CAST(700 * (pow(10, (lo + (hi - lo) * (b + 1) / 9) / 2595) - 1) AS FLOAT) AS DOUBLE) AS c, CAST(CAST(700 * (pow(10, (lo + (hi - lo) * (b + 2) / 9) / 2595) - 1) AS FLOAT) AS DOUBLE) AS r FROM g),
w AS (SELECT b, k.k AS bin, CASE WHEN k.k * 250 > l AND k.k * 250 <= c THEN (k.k * 250 - l) / (c - l) WHEN k.k * 250 > c AND k.k * 250 < r THEN (r - k.k * 250) / (r - c) ELSE 0 END AS w FROM h, (SELECT unnest(range(0, 33)) AS k) k),
n AS (SELECT b, bin, CASE WHEN sum(w) OVER (PARTITION BY b) > 0 THEN w / sum(w) OVER (PARTITION BY b) ELSE 0 END AS w FROM w)
SELECT vec_id, CAST(b AS INTEGER) AS band, round(CASE WHEN sum(mag * mag * w) > 0 THEN greatest(-120, 10 * log10(sum(mag * mag * w))) ELSE -120 END, 5) + 0.0 AS level FROM m JOIN n USING (bin) GROUP BY vec_id, b""")
def log_mel(s, d):
    out = W.apply_kernel(_spectra(s, d), "vec_id", "spectrum", lambda m: (signal.log_mel(m, signal.mel_bank(8, 64)).tolist(),), levels="array<double>")
    return out.select("vec_id", F.posexplode("levels").alias("band", "level")).select("vec_id", "band", (F.round("level", 5) + 0.0).alias("level"))


FLUX = f"""x AS (SELECT vec_id, f.f AS frame, i.i AS i, CAST(embedding[f.f * 16 + i.i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(0, 3)) AS f) f, (SELECT unnest(range(0, 32)) AS i) i),
m AS (SELECT vec_id, frame, k.k AS bin, sqrt(pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * cos(2 * pi() * k.k * i / 32)), 2) + pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * sin(2 * pi() * k.k * i / 32)), 2)) * 2 / 16 AS mag
      FROM x, (SELECT unnest(range(1, 17)) AS k) k GROUP BY vec_id, frame, k.k),
g AS (SELECT vec_id, frame, greatest(0, log10(mag + 1e-6) - lag(log10(mag + 1e-6)) OVER (PARTITION BY vec_id, bin ORDER BY frame)) AS rise FROM m)"""


@query(f"WITH {FLUX} SELECT vec_id, CAST(frame AS INTEGER) AS frame, round(coalesce(sum(rise), 0) / 16, 6) + 0.0 AS strength FROM g GROUP BY vec_id, frame")
def spectral_flux(s, d):
    out = W.apply_kernel(_t(s, d, "embeddings"), "vec_id", "embedding", lambda x: (signal.spectral_flux(signal.spectrogram(x, 32, 16, 32)).tolist(),), flux="array<double>")
    return out.select("vec_id", F.posexplode("flux").alias("frame", "f")).select("vec_id", "frame", r6(F.col("f")).alias("strength"))




LONG = f"x AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest({EMB}) AS v FROM embeddings)"
GAUSS = f"""{LONG}, mo AS (SELECT label, pos, avg(v) AS mean, coalesce(var_samp(v), 0) AS v, count(*) AS n FROM x GROUP BY label, pos),
po AS (SELECT label, avg(v) AS pooled FROM mo GROUP BY label),
ga AS (SELECT label, pos, mean, greatest(1e-6, (1 - least(1, 0.25 / greatest(1, n / 8))) * v + least(1, 0.25 / greatest(1, n / 8)) * pooled) AS variance, n FROM mo JOIN po USING (label))"""
DIST = f"{GAUSS}, di AS (SELECT x.label, vec_id, sqrt(avg((v - mean) * (v - mean) / variance)) AS distance FROM x JOIN ga USING (label, pos) GROUP BY x.label, vec_id)"


@query(f"WITH {GAUSS} SELECT label, CAST(pos AS INTEGER) AS pos, round(mean, 6) + 0.0 AS mean, round(variance, 9) AS variance, n FROM ga")
def gaussian_fit(s, d):
    return V.gaussians(_t(s, d, "embeddings")).select("label", "pos", r6(F.col("mean")).alias("mean"), F.round("variance", 9).alias("variance"), "n")


@query(f"WITH {DIST} SELECT label, vec_id, round(distance, 6) + 0.0 AS distance FROM di")
def mahalanobis(s, d):
    return V.distances(_t(s, d, "embeddings")).select("label", "vec_id", r6(F.col("distance")).alias("distance"))


@query(f"""WITH {DIST} SELECT label, round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.9), 6) AS p90, round(quantile_cont(distance, 0.95), 6) AS p95, round(quantile_cont(distance, 0.99), 6) AS p99,
round(max(distance), 6) AS max, CAST(least(512, count(*)) AS INTEGER) AS n FROM di GROUP BY label""")
def distance_distribution(s, d):
    out = V.distributions(V.distances(_t(s, d, "embeddings")))
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99", "max")), F.size("samples").alias("n"))


SCORE = f"""{DIST}, ra AS (SELECT label, vec_id, distance, row_number() OVER (PARTITION BY label ORDER BY distance) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM di),
th AS (SELECT label, list(distance ORDER BY distance) AS s FROM ra WHERE n <= 512 OR EXISTS (SELECT 1 FROM range(0, 512) t(i) WHERE floor(t.i * (n - 1)::DOUBLE / 511 + 0.5) = r) GROUP BY label),
q AS (SELECT label, quantile_cont(distance, 0.5) AS p50, quantile_cont(distance, 0.95) AS p95, max(distance) AS top FROM di GROUP BY label),
lo AS (SELECT di.label, vec_id, distance, s, p50, p95, top, len(list_filter(s, lambda y: y <= distance)) AS c FROM di JOIN th USING (label) JOIN q USING (label)),
sc AS (SELECT label, vec_id, CASE WHEN distance <= top THEN 0.5 * CASE WHEN distance <= s[1] THEN 0 WHEN distance >= s[len(s)] THEN 1 ELSE (c - 1 + CASE WHEN s[c + 1] > s[c] THEN (distance - s[c]) / (s[c + 1] - s[c]) ELSE 0 END) / (len(s) - 1) END
       ELSE 1 - 0.5 * exp(-(distance - top) / greatest(p95 - p50, 0.05 * top, 1e-6)) END AS score FROM lo)"""


@query(f"WITH {SCORE} SELECT label, vec_id, round(score, 6) + 0.0 AS score FROM sc")
def score_windows(s, d):
    return V.scores(_t(s, d, "embeddings")).select("label", "vec_id", r6(F.col("score")).alias("score"))


@query(f"""WITH {SCORE}, ch AS (SELECT label, quantile_cont(score, 0.9) AS score, avg(CASE WHEN score >= 0.9 THEN 1 ELSE 0 END) AS f, count(*) AS windows FROM sc GROUP BY label)
SELECT label, round(score, 6) + 0.0 AS score, round(f, 6) + 0.0 AS anomalous_fraction, windows, CASE WHEN score >= 0.9 THEN 'anomalous' WHEN score >= 0.75 THEN 'watch' ELSE 'normal' END AS status FROM ch""")
def profile_check(s, d):
    out = V.check_profiles(_t(s, d, "embeddings"))
    return out.select("label", r6(F.col("score")).alias("score"), r6(F.col("anomalous_fraction")).alias("anomalous_fraction"), "windows", "status")


PROTO = f"""{LONG}, un AS (SELECT vec_id, label, pos, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM x),
ps AS (SELECT label, pos, sum(v) AS v, count(*) AS n FROM un GROUP BY label, pos), pr AS (SELECT label, pos, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v, n FROM ps)"""


@query(f"WITH {PROTO} SELECT label, CAST(pos AS INTEGER) AS pos, round(v, 6) + 0.0 AS x, n FROM pr")
def prototypes(s, d):
    return V.prototypes(_t(s, d, "embeddings")).select("label", F.posexplode("embedding").alias("pos", "x"), "n").select("label", "pos", r6(F.col("x")).alias("x"), "n")


@query(f"""WITH {PROTO}, c AS (SELECT un.vec_id, pr.label, 1 / (1 - sum(un.v * pr.v) + 1e-6) AS w FROM un JOIN pr USING (pos) GROUP BY un.vec_id, pr.label)
SELECT vec_id, arg_max(label, w) AS label, round(max(w) / sum(w), 6) AS confidence FROM c GROUP BY vec_id""")
def prototype_predict(s, d):
    e = _t(s, d, "embeddings")
    return V.predict_by_prototype(e, V.prototypes(e)).select("vec_id", "label", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {LONG} SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) + 0.0 AS x FROM x GROUP BY label, pos")
def embedding_average(s, d):
    return V.average(_t(s, d, "embeddings")).select("label", "pos", r6(F.col("x")).alias("x"))


NEAR = f"""u AS (SELECT vec_id, label, list_transform({EMB}, lambda x: x / sqrt({SUMSQ})) AS e, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings),
pairs AS (SELECT a.vec_id AS id, a.label AS truth, b.vec_id AS other, b.label AS label, 1 - list_dot_product(a.e, b.e) AS distance, a.fold AS f, b.fold AS g FROM u a JOIN u b ON a.vec_id <> b.vec_id)"""


@query(f"""WITH {NEAR}, top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, other) <= 5),
v AS (SELECT id, label, sum(1 / (distance + 1e-6)) AS w FROM top GROUP BY id, label) SELECT id, arg_max(label, w) AS label, round(max(w) / sum(w), 6) AS confidence FROM v GROUP BY id""")
def knn_predict(s, d):
    e = _t(s, d, "embeddings")
    return V.predict(e, e).select("id", "label", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {LONG}, ce AS (SELECT label AS cluster, arg_min(vec_id, vec_id) AS id FROM embeddings GROUP BY label), cx AS (SELECT cluster, x.pos, x.v FROM ce JOIN x ON x.vec_id = ce.id),
dd AS (SELECT x.vec_id, cluster, sum((x.v - cx.v) * (x.v - cx.v)) AS dist FROM x JOIN cx USING (pos) GROUP BY x.vec_id, cluster), ne AS (SELECT vec_id, arg_min(cluster, dist) AS cluster FROM dd GROUP BY vec_id)
SELECT cluster, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) + 0.0 AS x, count(*) AS n FROM x JOIN ne USING (vec_id) GROUP BY cluster, pos""")
def lloyd_step(s, d):
    e = _t(s, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumnRenamed("label", "cluster")
    return V.lloyd_step(e, first).select("cluster", "pos", r6(F.col("x")).alias("x"), "n")


LEVEL = "greatest(-120, 20 * log10(value / 500))"


@query(f"""WITH e AS (SELECT event_id, {LEVEL} AS rms, value / 500 AS score, event_type IN ('click', 'view') AS hit FROM events),
g AS (SELECT event_id, list_filter([CASE WHEN rms < -20 THEN 'silence' END, CASE WHEN rms > -3 THEN 'too-loud' END, CASE WHEN hit AND score >= 0.35 THEN 'interference' END], lambda x: x IS NOT NULL) AS r FROM e)
SELECT event_id, len(r) = 0 AS accepted, array_to_string(r, '+') AS reasons FROM g""")
def guards(s, d):
    classes = F.array(F.struct(F.col("event_type").alias("label"), (F.col("value") / 500).alias("score")))
    g = W.guard(C.amplitude_to_dbfs(F.col("value") / 500), classes, floor=-20, labels=["click", "view"])
    return _t(s, d, "events").select("event_id", g.alias("g")).select("event_id", "g.accepted", F.array_join("g.reasons", "+").alias("reasons"))


@query("""SELECT user_id, event_type AS label, round(max(value), 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, event_type) AS INTEGER) AS place FROM events WHERE event_type <> '' GROUP BY user_id, event_type
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, event_type) <= 3""")
def merge_classes(s, d):
    rows = _t(s, d, "events").select("user_id", F.col("event_type").alias("label"), F.col("value").alias("score"))
    return W.merge_classes(rows, "user_id", 3).select("user_id", "label", F.round("score", 6).alias("score"), "place")


@query("""SELECT user_id, round(coalesce(max(CASE WHEN event_type IN ('click', 'view') THEN value END), 0), 6) AS human, round(coalesce(max(CASE WHEN event_type = 'purchase' THEN value END), 0), 6) AS first_score FROM events GROUP BY user_id""")
def human_score(s, d):
    rows = _t(s, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v")).groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("label"), F.col("v").alias("score"))).alias("c"))
    return rows.select("user_id", F.round(C.max_score_of(F.col("c"), ["click", "view"]), 6).alias("human"), F.round(C.score_of(F.col("c"), "purchase"), 6).alias("first_score"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STACK = "SELECT l_suppkey, l_shipdate, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem"


@query(f"""WITH x AS ({STACK}) SELECT l_suppkey, feature, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS deviation, round(quantile_cont(value, 0.05), 4) AS p05, round(quantile_cont(value, 0.95), 4) AS p95 FROM x GROUP BY l_suppkey, feature""")
def feature_stats(s, d):
    out = W.feature_stats(_t(s, d, "lineitem"), "l_suppkey", FEATURES)
    return out.select("l_suppkey", "feature", *(F.round(c, 4).alias(c) for c in ("mean", "deviation", "p05", "p95")))


@query(f"""WITH x AS ({STACK}), st AS (SELECT l_suppkey, feature, avg(value) AS mean, stddev_pop(value) AS deviation FROM x GROUP BY l_suppkey, feature),
no AS (SELECT l_suppkey, feature, avg(value) AS value FROM x WHERE l_shipdate >= TIMESTAMP '1998-11-01' GROUP BY l_suppkey, feature),
z AS (SELECT l_suppkey, feature, (value - mean) / deviation AS z FROM no JOIN st USING (l_suppkey, feature) WHERE deviation > 0 AND abs((value - mean) / deviation) >= 0.1)
SELECT l_suppkey, feature, round(z, 6) AS z, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(z) DESC, feature) AS INTEGER) AS place, CASE WHEN z > 0 THEN 'higher' ELSE 'lower' END AS direction FROM z QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(z) DESC, feature) <= 3""")
def describe_difference(s, d):
    rows = _t(s, d, "lineitem")
    late = rows.where(F.col("l_shipdate") >= F.lit("1998-11-01").cast("timestamp_ntz"))
    out = W.describe_difference(W.feature_stats(rows, "l_suppkey", FEATURES), late, "l_suppkey", FEATURES, 3, 0.1)
    return out.select("l_suppkey", "feature", F.round("z", 6).alias("z"), "place", "direction")


@query("""WITH a AS (SELECT event_id, least(1, value / 500) AS score, CASE WHEN event_id % 2 = 0 THEN 'normal' ELSE 'anomalous' END AS v, 0.6::DOUBLE AS w, 0.8::DOUBLE AS a FROM events),
b AS (SELECT *, v = 'normal' AND score >= w AS up, v = 'anomalous' AND score < a AS down FROM a),
c AS (SELECT *, CASE WHEN up THEN w + 0.5 * (least(0.995, score + 0.01) - w) END AS uw, CASE WHEN down THEN a - 0.5 * (a - greatest(0.5, score - 0.01)) END AS da FROM b),
e AS (SELECT event_id, CASE WHEN up THEN uw WHEN down THEN least(da - 0.01, w - 0.5 * (w - greatest(0.4, score - 0.05))) ELSE w END AS w, CASE WHEN up THEN greatest(uw + 0.01, a + 0.5 * (least(0.999, score + 0.02) - a)) WHEN down THEN da ELSE a END AS a FROM c)
SELECT event_id, round(least(greatest(least(w, a - 0.005), 0.4), 0.995), 6) AS watch, round(least(greatest(a, 0.45), 0.999), 6) AS anomalous FROM e""")
def calibrate(s, d):
    verdict = F.when(F.col("event_id") % 2 == 0, "normal").otherwise("anomalous")
    c = W.calibrated(F.lit(0.6), F.lit(0.8), verdict, F.least(F.lit(1.0), F.col("value") / 500))
    return _t(s, d, "events").select("event_id", c.alias("c")).select("event_id", F.round("c.watch", 6).alias("watch"), F.round("c.anomalous", 6).alias("anomalous"))


@query("""WITH x AS (SELECT user_id, event_id, value, count(*) OVER l AS n, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND 5 PRECEDING) AS b FROM events WINDOW l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n = 15 THEN a - b ELSE 0 END, 6) + 0.0 AS drift, n = 15 AND a - b >= 20 AS drifting FROM x""")
def drift(s, d):
    return W.drift(_t(s, d, "events"), "user_id", ["ts", "event_id"], "value", 5, 10, 20.0).select("event_id", r6(F.col("drift")).alias("drift"), "drifting")


@query("""WITH x AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(v, lambda a, b: a + 0.2 * (b - a)), 6) + 0.0 AS smoothed, len(v) AS n FROM x""")
def ema_watch(s, d):
    rows = W.series(_t(s, d, "events"), "user_id", ["ts", "event_id"], "value")
    return rows.select("user_id", r6(W.smoothed(F.col("values"))).alias("smoothed"), F.size("values").cast("long").alias("n"))


@query("""WITH i AS (SELECT user_id, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value * 100 AS stop FROM events),
n AS (SELECT *, CASE WHEN max(stop) OVER w IS NULL OR start - max(stop) OVER w >= 3600 THEN 1 ELSE 0 END AS new FROM i WINDOW w AS (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, round(min(start), 3) AS start, round(max(stop), 3) AS stop, count(*) AS n FROM k GROUP BY user_id, island""")
def event_merge(s, d):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = _t(s, d, "events").select("user_id", start.alias("start"), (start + F.col("value") * 100).alias("stop"))
    return W.merge_intervals(rows, "user_id", 3600.0).select("user_id", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"), "n")


@query("""WITH x AS (SELECT user_id, value, row_number() OVER w - 1 AS place, lag(value) OVER w AS b, lead(value) OVER w AS a, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, list_median(l) AS m FROM x WHERE value >= 0.05 AND value > b AND value >= a)
SELECT user_id, CAST(place AS INTEGER) AS place, round(value, 6) AS value FROM y WHERE value >= m + 1.5 * list_avg(list_transform(l, lambda v: abs(v - m)))""")
def onsets(s, d):
    return W.onset_candidates(_t(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "place", F.round("value", 6).alias("value"))


@query("""WITH x AS (SELECT toxic, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents JOIN labels USING (doc_id))
SELECT round((sum(CASE WHEN toxic = 1 THEN r END) - sum(toxic) * (sum(toxic) + 1) / 2) / (sum(toxic) * (count(*) - sum(toxic))), 6) AS auc FROM x""")
def roc_auc(s, d):
    rows = _t(s, d, "documents").select("doc_id", "n_chars").join(_t(s, d, "labels"), "doc_id")
    return V.roc_auc(rows, "toxic", "n_chars", "doc_id").select(F.round("auc", 6).alias("auc"))


@query("SELECT label, min(vec_id) AS first_id, count(*) AS n FROM embeddings GROUP BY label")
def knn_labels(s, d):
    return _t(s, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))


# without SQL: tests hold these against plain forms






def _levels(s, d):
    rows = _t(s, d, "events").withColumn("level", C.amplitude_to_dbfs(F.col("value") / 500))
    return W.series(rows, "user_id", ["ts", "event_id"], "level")










@query()
def kmeans_select(s, d):
    return V.cluster_groups(_t(s, d, "embeddings"), "label").groupBy("label", "cluster", "k").agg(F.count("*").alias("n"))


@query()
def learn_profile(s, d):
    """Profile of every label: states, weights and thresholds, also through their compact form."""

    def run(table):
        x = V._matrix(table.sort_by("vec_id")["embedding"]).astype(np.float32)
        p = learning.learn_profile(x)
        score, _, _ = learning.score_windows(p, x)
        again, _, _ = learning.score_windows(learning.expand(learning.compact(p)), x)
        return pa.table({"label": table["label"].slice(0, 1), "states": pa.array([len(p["states"])], pa.int32()), "watch": [p["watch"]], "anomalous": [p["anomalous"]], "check_score": [float(np.percentile(score, 90))], "compact_score": [float(np.percentile(again, 90))]})

    return _t(s, d, "embeddings").select("label", "vec_id", "embedding").groupBy("label").applyInArrow(run, "label int, states int, watch double, anomalous double, check_score double, compact_score double")


@query()
def mlp_head(s, d):
    """Predictions of every vector by an MLP head that is trained on at most HEAD_ROWS vectors of each label, those of the least hash."""
    e = _t(s, d, "embeddings")
    names = sorted(str(r.label) for r in e.select("label").distinct().collect())
    least = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("vec_id"), "vec_id"))
    rows = e.withColumn("r", least).where(F.col("r") <= HEAD_ROWS).select("vec_id", "label", "embedding").orderBy("vec_id").toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    head = learning.MlpHead(names)
    head.train(x, [str(v) for v in rows["label"]])
    model = s.sparkContext.broadcast(head)
    out = W.apply_kernel(_t(s, d, "embeddings"), "vec_id", "embedding", lambda v: (int(model.value.predict(v[None])[0].argmax()),), predicted="int")
    return out.join(_t(s, d, "embeddings").select("vec_id", "label"), "vec_id").groupBy("label", "predicted").agg(F.count("*").alias("n"))


def audio(s, d) -> DataFrame:
    """One window of synthetic audio per user of the events: a call whose pitch the user sets, over noise.  The tables hold no audio; of events only the distinct users are read."""

    def make(batches):
        for b in batches:
            for a in range(0, b.num_rows, AUDIO_ROWS):
                part = b.column(0).slice(a, AUDIO_ROWS)
                x = [synthetic.mix(synthetic.concat(synthetic.silence(0.25), synthetic.harmonic_call(0.475, 200 + i % 500), synthetic.silence(0.25)), synthetic.white_noise(0.975, 0.003, i + 1)) for i in part.to_pylist()]
                ends = np.cumsum([0, *map(len, x)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(np.float32)))], ["window_id", "samples"])

    return _t(s, d, "events").select(F.col("user_id").alias("window_id")).distinct().repartition(max(1, s.sparkContext.defaultParallelism), "window_id").mapInArrow(make, "window_id long, samples array<float>")


@query()
def feature_extract(s, d):
    return W.features(audio(s, d)).drop("vector")


@query()
def pitch_track(s, d):
    def kernel(x):
        p = signal.summarize_pitch(signal.track_pitch(x))
        return tuple(p[c] for c in ("median_f0", "voiced_fraction", "min_f0", "max_f0", "slope"))

    return W.apply_kernel(audio(s, d), "window_id", "samples", kernel, f0="double", voiced="double", low="double", high="double", slope="double")


@query()
def event_detector(s, d):
    rows = audio(s, d).select(F.pmod("window_id", F.lit(8)).cast("string").alias("stream_id"), (F.col("window_id") * 1.0).alias("t"), "samples", F.lit("Cat").alias("label"), F.lit(0.9).alias("score"))
    return W.detect_events(rows, ["Cat"])
