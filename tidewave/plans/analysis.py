"""Queries on sequences, windows, profiles and stores, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewave.functions import columns as C
from tidewave.functions import signal
from tidewave.functions.labels import DESCRIPTIONS, HUMAN_VOICE_CLASSES, INTERFERENCE_CLASSES
from tidewave.functions.models import Classifier, Embedder
from tidewave.operators import engine as E
from tidewave.operators import store, suites
from tidewave.operators import vectors as V
from tidewave.operators import windows as W
from tidewave.plans.queries import DFT, DIST, EMB, FEATURES, FLUX, MULBERRY, NEAR, PROTO, STACK, SUMSQ, _levels, _spectra, _t, query, r6

# signals


@query(f"WITH {FLUX} SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(avg(mag), 6) + 0.0 AS mag FROM m GROUP BY vec_id, bin")
def average_spectrum(s, d):
    kernel = lambda x: (signal.average_spectrum(signal.spectrogram(x, 32, 16, 32)).tolist(),)
    out = W.apply_kernel(_t(s, d, "embeddings"), "vec_id", "embedding", kernel, spectrum="array<double>")
    return out.select("vec_id", F.posexplode("spectrum").alias("bin", "m")).where("bin > 0").select("vec_id", "bin", r6(F.col("m")).alias("mag"))


@query(f"""WITH t AS (SELECT unnest(range(0, 63)) AS i), h AS (SELECT i, (CASE WHEN i = 31 THEN 2 * 0.225 ELSE sin(2 * pi() * 0.225 * (i - 31)) / (pi() * (i - 31)) END) * (0.42 - 0.5 * cos(2 * pi() * i / 62) + 0.08 * cos(4 * pi() * i / 62)) AS h FROM t),
g AS (SELECT i, h / sum(h) OVER () AS h FROM h), x AS (SELECT vec_id, unnest(range(0, 64)) AS j, unnest({EMB}) AS v FROM embeddings),
y AS (SELECT vec_id, (j + i - 31) // 2 AS k, CAST(sum(v * h) AS FLOAT) AS y FROM x, g WHERE (j + i - 31) % 2 = 0 AND j + i - 31 BETWEEN 0 AND 63 GROUP BY vec_id, k)
SELECT vec_id, CAST(k AS INTEGER) AS place, round(CAST(y AS DOUBLE), 5) + 0.0 AS sample FROM y""")
def resample_down(s, d):
    out = W.apply_kernel(_t(s, d, "embeddings"), "vec_id", "embedding", lambda x: (signal.resample(x, 16000, 8000).astype(float).tolist(),), lower="array<double>")
    return out.select("vec_id", F.posexplode("lower").alias("place", "x")).select("vec_id", "place", (F.round("x", 5) + 0.0).alias("sample"))


@query(f"""WITH {DFT}, b AS (SELECT vec_id, bin, 20 * log10(greatest(mag, 1e-6)) AS db FROM m),
c AS (SELECT *, lag(db) OVER w AS x, lead(db) OVER w AS z FROM b WINDOW w AS (PARTITION BY vec_id ORDER BY bin)),
p AS (SELECT c.vec_id, c.bin, c.db, c.x, c.z, list_sort(list(b.db)) AS near FROM c JOIN b ON b.vec_id = c.vec_id AND b.bin >= greatest(1, c.bin - 6) AND b.bin < least(32, c.bin + 6) AND abs(b.bin - c.bin) > 1
      WHERE c.bin BETWEEN 1 AND 31 AND c.db > c.x AND c.db >= c.z GROUP BY ALL),
q AS (SELECT vec_id, bin, db, db - near[len(near) // 2 + 1] AS prominence, x - 2 * db + z AS dd, x, z FROM p)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY prominence DESC, bin) - 1 AS INTEGER) AS place, round((bin + CASE WHEN dd = 0 THEN 0 ELSE least(0.5, greatest(-0.5, 0.5 * (x - z) / dd)) END) * 250, 4) + 0.0 AS hz,
       round(db, 6) + 0.0 AS level, round(prominence, 6) + 0.0 AS prominence FROM q WHERE prominence >= 6 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY prominence DESC, bin) <= 5""")
def spectral_peaks(s, d):
    kernel = lambda m: ([list(p) for p in signal.find_peaks(m, 16000, 64, radius_hz=1500)],)
    out = W.apply_kernel(_spectra(s, d), "vec_id", "spectrum", kernel, peaks="array<array<double>>").select("vec_id", F.posexplode("peaks").alias("place", "p"))
    return out.select("vec_id", "place", (F.round(F.col("p")[0], 4) + 0.0).alias("hz"), r6(F.col("p")[1]).alias("level"), r6(F.col("p")[2]).alias("prominence"))


@query(f"""WITH e AS (SELECT vec_id, {EMB} AS x FROM embeddings), l AS (SELECT unnest(range(0, 27)) AS lag),
f AS (SELECT vec_id, lag, list_sum(list_transform(range(1, 39), lambda j: pow(x[j + lag] - x[j], 2))) AS diff FROM e, l),
n AS (SELECT vec_id, lag, CAST(CASE WHEN lag = 0 THEN 1 WHEN sum(CASE WHEN lag > 0 THEN diff END) OVER w > 0 THEN diff * lag / sum(CASE WHEN lag > 0 THEN diff END) OVER w ELSE 1 END AS FLOAT) AS v FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY lag)),
o AS (SELECT vec_id, list(v ORDER BY lag) AS v FROM n GROUP BY vec_id),
b AS (SELECT vec_id, v, list_min(list_filter(range(4, 27), lambda i: v[i + 1] < 0.15::FLOAT)) AS b FROM o),
c AS (SELECT vec_id, v, b, CASE WHEN b IS NOT NULL THEN list_min(list_filter(range(b, 27), lambda i: i = 26 OR v[i + 2] >= v[i + 1])) ELSE list_min(list_filter(range(4, 27), lambda i: v[i + 1] = list_min(v[5:27]))) END AS lag FROM b),
g AS (SELECT vec_id, CAST(v[lag + 1] AS DOUBLE) AS h, CAST(v[lag] AS DOUBLE) AS a, CAST(v[least(lag + 2, 27)] AS DOUBLE) AS z, lag, (b IS NOT NULL OR v[lag + 1] <= 0.6::FLOAT) AND NOT (list_min(v[3:4]) <= v[lag + 1] + 1e-6::FLOAT AND list_min(v[3:4]) < 0.15::FLOAT) AS ok FROM c),
k AS (SELECT vec_id, ok, h, 16000 / (lag + CASE WHEN lag < 26 AND a - 2 * h + z <> 0 THEN least(1, greatest(-1, 0.5 * (a - z) / (a - 2 * h + z))) ELSE 0 END) AS hz FROM g)
SELECT vec_id, CASE WHEN ok AND hz BETWEEN 600 AND 4000 THEN round(hz, 4) ELSE 0 END + 0.0 AS f0, CASE WHEN ok AND hz BETWEEN 600 AND 4000 THEN round(least(1, greatest(0, 1 - h)), 6) ELSE 0 END + 0.0 AS confidence FROM k""")
def yin_pitch(s, d):
    out = W.apply_kernel(_t(s, d, "embeddings"), "vec_id", "embedding", lambda x: signal.yin(x, 600, 4000), f0="double", confidence="double")
    return out.select("vec_id", (F.round("f0", 4) + 0.0).alias("f0"), r6(F.col("confidence")).alias("confidence"))


@query(f"""WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest({EMB}) AS v, list_avg({EMB}) AS mean FROM embeddings),
m AS (SELECT vec_id, k.k, sqrt(pow(sum((v - mean) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * cos(2 * pi() * k.k * i / 64)), 2) + pow(sum((v - mean) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * sin(2 * pi() * k.k * i / 64)), 2)) AS mag FROM x, (SELECT unnest(range(3, 26)) AS k) k GROUP BY vec_id, k.k)
SELECT vec_id, round(arg_max(k, mag) / 1.28, 6) AS rate, round(max(mag) / sum(mag), 6) AS depth FROM m GROUP BY vec_id""")
def modulation_rate(s, d):
    out = W.apply_kernel(_t(s, d, "embeddings"), "vec_id", "embedding", lambda x: signal.modulation(x, 0.02), rate="double", depth="double")
    return out.select("vec_id", r6(F.col("rate")).alias("rate"), r6(F.col("depth")).alias("depth"))


#: Levels of each user's events in order: user_id, i (from 0), x.
LEVELS = "lv AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN value / 500 < 1e-7 THEN -120 ELSE greatest(-120, 20 * log10(value / 500)) END AS x FROM events)"
#: The syllable machine over rows (g, i from 0, x): its last row by g has n.
SYLLABLES = """st AS (SELECT g, i, 1 AS n, true AS rising, x AS peak, x AS valley FROM runs WHERE i = 0
UNION ALL SELECT r.g, r.i, CASE WHEN NOT st.rising AND r.x - least(st.valley, r.x) >= 6 THEN st.n + 1 ELSE st.n END, CASE WHEN st.rising THEN greatest(st.peak, r.x) - r.x < 6 ELSE r.x - least(st.valley, r.x) >= 6 END,
  CASE WHEN st.rising THEN greatest(st.peak, r.x) WHEN r.x - least(st.valley, r.x) >= 6 THEN r.x ELSE st.peak END, CASE WHEN st.rising THEN CASE WHEN greatest(st.peak, r.x) - r.x >= 6 THEN r.x ELSE st.valley END ELSE least(st.valley, r.x) END
  FROM st JOIN runs r ON r.g = st.g AND r.i = st.i + 1),
sy AS (SELECT g, arg_max(n, i) AS n FROM st GROUP BY g)"""


@query(f"""WITH RECURSIVE {LEVELS}, runs AS (SELECT user_id AS g, i, x FROM lv), {SYLLABLES} SELECT g AS user_id, CAST(n AS BIGINT) AS syllables FROM sy""")
def syllables(s, d):
    return W.apply_kernel(_levels(s, d), "user_id", "values", lambda v: (signal.count_syllables(v),), syllables="long")


@query(f"""WITH RECURSIVE {LEVELS}, fl AS (SELECT user_id, quantile_cont(x, 0.2) AS floor FROM lv GROUP BY user_id),
de AS (SELECT lv.*, CASE WHEN x >= floor + 12 THEN 1 WHEN x < floor + 6 THEN 0 END AS c FROM lv JOIN fl USING (user_id)),
op AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i), 0) AS o FROM de),
ed AS (SELECT *, o = 1 AND coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY i), 0) = 0 AS b FROM op),
ru AS (SELECT user_id, min(i) AS a, max(i) + 1 AS z FROM (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS r FROM ed) WHERE o = 1 GROUP BY user_id, r),
mg AS (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY user_id ORDER BY a) <= 6 THEN 0 ELSE 1 END AS new FROM ru),
sg AS (SELECT user_id, min(a) AS a, least(max(z), min(a) + 500) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a) AS k FROM mg) GROUP BY user_id, k),
kp AS (SELECT *, row_number() OVER (ORDER BY user_id, a) AS g FROM sg WHERE (z - a) * 0.01::DOUBLE + 1e-12 >= 0.04),
runs AS (SELECT g, lv.i - a AS i, x FROM kp JOIN lv ON lv.user_id = kp.user_id AND lv.i >= a AND lv.i < z), {SYLLABLES}, pk AS (SELECT g, max(x) AS peak FROM runs GROUP BY g)
SELECT user_id, round(a * 0.01::DOUBLE, 6) AS start, round(z * 0.01::DOUBLE, 6) AS stop, round(peak, 6) + 0.0 AS peak, CAST(n AS DOUBLE) AS syllables FROM kp JOIN pk USING (g) JOIN sy USING (g)""")
def segmentation(s, d):
    kernel = lambda v: ([list(map(float, x)) for x in signal.segment(v, 0.01)],)
    out = W.apply_kernel(_levels(s, d), "user_id", "values", kernel, spans="array<array<double>>")
    return out.select("user_id", F.explode("spans").alias("x")).select("user_id", *(r6(F.col("x")[i]).alias(n) for i, n in enumerate(("start", "stop", "peak", "syllables"))))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM e), q AS (SELECT user_id, median(gap) AS seed, count(*) AS n FROM g GROUP BY user_id),
p AS (SELECT user_id, k.k, seed * (1 + k.k / 100.0::DOUBLE) AS p FROM q, (SELECT unnest(range(-40, 41)) AS k) k WHERE n >= 3 AND seed > 0),
c AS (SELECT user_id, k, any_value(p) AS p, sqrt(pow(avg(cos(2 * pi() * t / p)), 2) + pow(avg(sin(2 * pi() * t / p)), 2)) AS s FROM p JOIN e USING (user_id) GROUP BY user_id, k),
b AS (SELECT user_id, max(s) AS strength, arg_max(p, s) AS period FROM c GROUP BY user_id)
SELECT user_id, round(coalesce(strength, 0), 6) + 0.0 AS strength, round(coalesce(period, 0), 3) + 0.0 AS period FROM q LEFT JOIN b USING (user_id)""")
def onset_periodicity(s, d):
    rows = W.series(_t(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), "user_id", ["ts", "event_id"], "t")
    out = W.apply_kernel(rows, "user_id", "values", lambda t: signal.onset_periodicity(t.tolist()), strength="double", period="double")
    return out.select("user_id", r6(F.col("strength")).alias("strength"), (F.round("period", 3) + 0.0).alias("period"))


@query("""WITH RECURSIVE x AS (SELECT user_id, value, row_number() OVER w - 1 AS place, lag(value) OVER w AS b, lead(value) OVER w AS a, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, list_median(l) AS m FROM x WHERE value >= 0.05 AND value > b AND value >= a),
c AS (SELECT user_id, place, row_number() OVER (PARTITION BY user_id ORDER BY place) AS k FROM y WHERE value >= m + 1.5 * list_avg(list_transform(l, lambda v: abs(v - m)))),
t AS (SELECT user_id, k, place * 0.01::DOUBLE AS last, true AS taken FROM c WHERE k = 1
UNION ALL SELECT c.user_id, c.k, CASE WHEN c.place * 0.01::DOUBLE - last >= 0.05 THEN c.place * 0.01::DOUBLE ELSE last END, c.place * 0.01::DOUBLE - last >= 0.05 FROM t JOIN c ON c.user_id = t.user_id AND c.k = t.k + 1)
SELECT user_id, round(last, 6) AS onset FROM t WHERE taken""")
def onset_times(s, d):
    found = W.onset_candidates(_t(s, d, "events"), "user_id", ["ts", "event_id"], "value")
    return W.onset_times(found, "user_id", 0.01).select("user_id", F.explode("times").alias("onset")).select("user_id", F.round("onset", 6).alias("onset"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value / 500 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
d AS (SELECT user_id, i, count(*) OVER a AS n, avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 14 PRECEDING AND 5 PRECEDING) AS gap FROM e WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
sm AS (SELECT user_id, i, x AS smoothed FROM e WHERE i = 0 UNION ALL SELECT e.user_id, e.i, smoothed + 0.2 * (e.x - smoothed) FROM sm JOIN e ON e.user_id = sm.user_id AND e.i = sm.i + 1),
se AS (SELECT *, CASE WHEN smoothed >= 0.5 THEN 'anomalous' WHEN smoothed >= 0.2 THEN 'watch' ELSE 'normal' END AS seen FROM sm),
m AS (SELECT user_id, -1::BIGINT AS i, 'normal' AS status, 'normal' AS candidate, 0 AS k, false AS changed FROM e WHERE i = 0
UNION ALL SELECT m.user_id, m.i + 1, CASE WHEN seen <> status AND seen = candidate AND k + 1 >= 3 THEN seen ELSE status END, seen, CASE WHEN seen = status THEN 0 WHEN seen <> candidate THEN 1 WHEN k + 1 >= 3 THEN 0 ELSE k + 1 END, seen <> status AND seen = candidate AND k + 1 >= 3
  FROM m JOIN se ON se.user_id = m.user_id AND se.i = m.i + 1)
SELECT user_id, CAST(i AS INTEGER) AS place, round(smoothed, 6) + 0.0 AS smoothed, status, changed, n = 15 AND gap >= 0.15 AS drifting, round(CASE WHEN n = 15 THEN gap ELSE 0 END, 6) + 0.0 AS drift FROM m JOIN sm USING (user_id, i) JOIN d USING (user_id, i)""")
def watch_mode(s, d):
    rows = _t(s, d, "events").withColumn("score", F.col("value") / 500)
    out = W.watch(rows, "user_id", ["ts", "event_id"], "score", 0.2, 0.5, recent=5, reference=10)
    return out.select("user_id", "place", r6(F.col("smoothed")).alias("smoothed"), "status", "changed", "drifting", r6(F.col("drift")).alias("drift"))


@query("""WITH f AS (SELECT user_id, 0.01::DOUBLE * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS t, CASE WHEN value >= 100 THEN value ELSE 0 END AS f0 FROM events)
SELECT user_id, round(coalesce(median(f0) FILTER (f0 > 0), 0), 6) + 0.0 AS median_f0, round(avg(CASE WHEN f0 > 0 THEN 1 ELSE 0 END), 6) + 0.0 AS voiced_fraction, round(coalesce(min(f0) FILTER (f0 > 0), 0), 6) + 0.0 AS min_f0, round(coalesce(max(f0) FILTER (f0 > 0), 0), 6) + 0.0 AS max_f0,
       round(CASE WHEN count(*) FILTER (f0 > 0) < 2 THEN 0 ELSE coalesce(regr_slope(12 * log2(f0), t) FILTER (f0 > 0), 0) END, 4) + 0.0 AS slope FROM f GROUP BY user_id""")
def pitch_summary(s, d):
    t = 0.01 * (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    rows = _t(s, d, "events").select("user_id", t.alias("t"), F.when(F.col("value") >= 100, F.col("value")).otherwise(0.0).alias("f0"))
    out = W.pitch_summary(rows, "user_id", "t", "f0")
    return out.select("user_id", *(r6(F.col(c)).alias(c) for c in ("median_f0", "voiced_fraction", "min_f0", "max_f0")), (F.round("slope", 4) + 0.0).alias("slope"))


@query("""SELECT CAST(i AS INTEGER) AS place, 'mel shape[' || i || ']' AS name FROM range(0, 64) t(i)
UNION ALL SELECT CAST(64 + i AS INTEGER), 'band balance ' || CASE WHEN i = 0 THEN '62.5' ELSE CAST(CAST(62.5 * pow(2, i) AS INTEGER) AS VARCHAR) END || '-' || CAST(CAST(125 * pow(2, i) AS INTEGER) AS VARCHAR) || ' Hz' FROM range(0, 7) t(i)
UNION ALL SELECT CAST(71 + i AS INTEGER), ['level', 'spectral flatness', 'spectral centroid', 'spectral flux', 'AM rate', 'AM depth'][i + 1] FROM range(0, 6) t(i)""")
def feature_names(s, d):
    return s.createDataFrame(list(enumerate(signal.feature_names())), "place int, name string")


# quantisation


@query(f"""WITH a AS (SELECT vec_id, {EMB} AS e, list_max(list_transform({EMB}, lambda x: abs(x))) / 127 AS scale FROM embeddings),
q AS (SELECT vec_id, scale, list_transform(e, lambda x: CAST(least(greatest(floor(x / scale + 0.5), -127), 127) AS INTEGER)) AS q FROM a)
SELECT vec_id, to_base64(unhex(array_to_string(list_transform(q, lambda v: lpad(hex(CASE WHEN v < 0 THEN v + 256 ELSE v END), 2, '0')), ''))) AS payload, round(list_sum(list_transform(q, lambda v: v * scale)), 6) + 0.0 AS total, round(q[3] * scale, 9) + 0.0 AS third FROM q""")
def quantize_payload(s, d):
    rows = _t(s, d, "embeddings").select("vec_id", C.quantize_int8(F.col("embedding")).alias("q")).select("vec_id", "q.scale", C.int8_payload(F.col("q")).alias("payload"))
    back = rows.withColumn("x", C.dequantize_checked(F.col("scale"), F.col("payload"), 64))
    return back.select("vec_id", "payload", r6(C.total(F.col("x"))).alias("total"), (F.round(F.col("x")[2], 9) + 0.0).alias("third"))


@query(f"""WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest({EMB}) AS v FROM embeddings), s AS (SELECT *, pow(2, greatest(floor(log2(abs(v))), -14) - 10) AS step FROM x WHERE v <> 0)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, sign(v) * floor(abs(v) / step + 0.5) * step AS kept FROM s""")
def float16_values(s, d):
    """The numbers that float16 keeps, once by bits in a kernel and once by arithmetic; both must agree."""
    kernel = lambda x: (signal.from_half(signal.to_half(x)).astype(float).tolist(),)
    out = W.apply_kernel(_t(s, d, "embeddings"), "vec_id", "embedding", kernel, kept="array<double>").join(_t(s, d, "embeddings").select("vec_id", C.doubles(F.col("embedding")).alias("e")), "vec_id")
    rows = out.select("vec_id", F.posexplode(F.arrays_zip("kept", "e")).alias("pos", "x")).where("x.e <> 0")
    same = F.col("x.kept") == C.float16_value(F.col("x.e"))
    return rows.select("vec_id", "pos", F.when(same, F.col("x.kept")).alias("kept"))


@query("SELECT p_partkey, CASE WHEN p_retailprice - 1000 < 0 THEN 0.0 ELSE least(p_retailprice - 1000, 500) END AS clamped FROM part UNION ALL SELECT -1, 0.0")
def clamp_nan(s, d):
    v = _t(s, d, "part").select("p_partkey", (F.col("p_retailprice") - 1000).alias("v")).unionByName(s.createDataFrame([(-1, float("nan"))], "p_partkey long, v double"))
    return v.select("p_partkey", C.clamp_nan_low(F.col("v"), 0.0, 500.0).alias("clamped"))


# labels, guards and windows


def _strings(labels) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in labels)


@query(f"SELECT 'interference' AS kind, unnest([{_strings(INTERFERENCE_CLASSES)}]) AS label UNION ALL SELECT 'human', unnest([{_strings(HUMAN_VOICE_CLASSES)}])")
def label_sets(s, d):
    return s.createDataFrame([("interference", x) for x in INTERFERENCE_CLASSES] + [("human", x) for x in HUMAN_VOICE_CLASSES], "kind string, label string")


NAMED = {"click": "Speech", "view": "Dog", "purchase": "Singing", "scroll": "Cat"}


def _named(c):
    return F.coalesce(F.create_map(*(F.lit(x) for kv in NAMED.items() for x in kv))[c], F.lit("Engine"))


CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMED.items()) + " ELSE 'Engine' END"


@query(f"""WITH c AS (SELECT user_id, {CASE} AS label, max(value) / 500 AS score FROM events GROUP BY 1, 2)
SELECT user_id, round(coalesce(max(CASE WHEN label IN ({_strings(HUMAN_VOICE_CLASSES)}) THEN score END), 0), 6) AS human, coalesce(max(CASE WHEN label IN ({_strings(HUMAN_VOICE_CLASSES)}) THEN score END), 0) >= 0.3 AS possibly_human FROM c GROUP BY user_id""")
def human_voice(s, d):
    rows = _t(s, d, "events").groupBy("user_id", _named(F.col("event_type")).alias("label")).agg((F.max("value") / 500).alias("score"))
    c = rows.groupBy("user_id").agg(F.collect_list(F.struct("label", "score")).alias("c"))
    return c.select("user_id", F.round(W.human_score(F.col("c")), 6).alias("human"), C.possibly_human(F.col("c"), HUMAN_VOICE_CLASSES).alias("possibly_human"))


def _toy_classes():
    return lambda x: [[("Speech", min(1.0, 4 * abs(float(x[0])))), ("Hum", abs(float(x[1])))]]


def _toy_vector():
    return lambda x: x[:4]


def _analysed(s, d):
    rows = _t(s, d, "embeddings").select(F.col("vec_id").alias("stream_id"), (F.col("vec_id") * 0.4875).alias("t"), F.col("embedding").alias("samples"))
    return E.analyse(rows, Classifier(_toy_classes), Embedder(_toy_vector), E.Guards(floor_dbfs=-65.0))


ANALYSED = f"""a AS (SELECT vec_id, {EMB} AS e, 20 * log10(sqrt({SUMSQ} / len(embedding))) AS rms FROM embeddings),
w AS (SELECT vec_id, rms, e, least(1, 4 * abs(e[1])) AS speech, abs(e[2]) AS hum, least(1, 4 * abs(e[1])) >= 0.35 AS hit, sqrt(list_sum(list_transform(e[1:4], lambda x: x * x))) AS n FROM a)"""


@query(f"""WITH {ANALYSED} SELECT vec_id AS stream_id, round(vec_id * 0.4875, 6) AS t, round(rms, 6) AS rms_dbfs, NOT hit AS accepted, CASE WHEN hit THEN 'interference' ELSE '' END AS reasons, CASE WHEN hit THEN round(speech, 6) END AS interference,
CASE WHEN hum >= 0.02 AND hum > speech THEN 'Hum' WHEN speech >= 0.02 THEN 'Speech' WHEN hum >= 0.02 THEN 'Hum' ELSE '' END AS best, CASE WHEN hit THEN 0 ELSE 4 END AS dimensions, CASE WHEN hit THEN 0 ELSE round(CAST(CAST(e[1] / n AS FLOAT) AS DOUBLE), 5) END + 0.0 AS first FROM w""")
def window_analysis(s, d):
    """Every vector taken as a window's samples, with toy models: the embedder runs on accepted windows only."""
    w = _analysed(s, d)
    return w.select(
        "stream_id", F.round("t", 6).alias("t"), F.round("rms_dbfs", 6).alias("rms_dbfs"), "guard.accepted", F.array_join("guard.reasons", "+").alias("reasons"), F.round("guard.interference.score", 6).alias("interference"),
        F.coalesce(F.get("classes", F.lit(0))["label"], F.lit("")).alias("best"), F.size("embedding").alias("dimensions"), (F.round(F.coalesce(F.get("embedding", F.lit(0)).cast("double"), F.lit(0.0)), 5) + 0.0).alias("first"),
    )


@query(f"WITH {ANALYSED} SELECT vec_id AS stream_id, round(rms, 6) AS level FROM w WHERE NOT hit")
def guard_filter(s, d):
    return E.accepted(_analysed(s, d)).select("stream_id", F.round("features.rms_dbfs", 6).alias("level"))


@query("""SELECT unnest(['floor_dbfs', 'ceiling_dbfs', 'interference_score', 'labels']) AS setting, unnest(['-65.0', '-3.0', '0.35', '16']) AS value""")
def guard_settings(s, d):
    g = E.Guards()
    return s.createDataFrame([("floor_dbfs", str(g.floor_dbfs)), ("ceiling_dbfs", str(g.ceiling_dbfs)), ("interference_score", str(g.interference_score)), ("labels", str(len(g.labels)))], "setting string, value string")


@query(f"""WITH {ANALYSED} SELECT vec_id AS stream_id, unnest(['level', 'peakFrequencyHz', 'band63Hz', 'band4000Hz']) AS feature, unnest([round(rms, 6), 0.0, round(-120 - rms, 6), round(-120 - rms, 6)]) AS value FROM w""")
def feature_map(s, d):
    """Scalars of windows too short for a spectrum: peaks are 0 and bands lie at the floor."""
    rows = E.feature_map(_analysed(s, d), "stream_id").where(F.col("feature").isin("level", "peakFrequencyHz", "band63Hz", "band4000Hz"))
    return rows.select("stream_id", "feature", r6(F.col("value")).alias("value"))


def _meta(i: int) -> str:
    return " ".join(f"WHEN '{m[0]}' THEN '{m[i]}'" for m in DESCRIPTIONS)


FORMAT = "CASE WHEN g >= 100 THEN printf('%.0f', g) WHEN g >= 10 THEN printf('%.1f', g) ELSE printf('%.2f', g) END"


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, ['level', 'spectralFlatness', 'spectralCentroidHz', 'peakProminenceDb', 'band250Hz', 'other'][l_linenumber % 6 + 1] AS f, l_quantity - 25 AS z, l_quantity AS v, 25.5 AS m FROM lineitem),
p AS (SELECT *, abs(v - m) AS g, CASE f {_meta(1)} WHEN 'band250Hz' THEN 'the 250 Hz band' ELSE f END AS label, CASE f {_meta(2)} ELSE 'dB' END AS unit, CASE WHEN z > 0 THEN CASE f {_meta(3)} ELSE 'louder' END ELSE CASE f {_meta(4)} ELSE 'quieter' END END AS word FROM r)
SELECT l_orderkey, l_linenumber, upper(label[1]) || label[2:] || ' is ' || word || ' than usual, by ' || CASE WHEN unit = '' THEN printf('%.2f', g) ELSE {FORMAT} || ' ' || unit END || '.' AS text FROM p""")
def descriptor_texts(s, d):
    names = F.array(*(F.lit(x) for x in ("level", "spectralFlatness", "spectralCentroidHz", "peakProminenceDb", "band250Hz", "other")))
    q = F.col("l_quantity").cast("double")
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", W.descriptor_text(F.get(names, F.col("l_linenumber") % 6), q - 25, q, F.lit(25.5)).alias("text"))


@query(f"""WITH x AS ({STACK}), st AS (SELECT l_suppkey, feature, avg(value) AS mean, stddev_pop(value) AS deviation FROM x GROUP BY l_suppkey, feature),
no AS (SELECT l_suppkey, feature, avg(value) AS value FROM x WHERE l_shipdate >= TIMESTAMP '1998-11-01' GROUP BY l_suppkey, feature),
z AS (SELECT l_suppkey, feature, (value - mean) / deviation AS z, abs(value - mean) AS g FROM no JOIN st USING (l_suppkey, feature) WHERE deviation > 0 AND abs((value - mean) / deviation) >= 0.1)
SELECT l_suppkey, feature, 'L' || feature[2:] || ' is ' || CASE WHEN z > 0 THEN 'louder' ELSE 'quieter' END || ' than usual, by ' || {FORMAT} || ' dB.' AS text FROM z QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(z) DESC, feature) <= 3""")
def difference_texts(s, d):
    rows = _t(s, d, "lineitem")
    late = rows.where(F.col("l_shipdate") >= F.lit("1998-11-01").cast("timestamp_ntz"))
    out = W.describe_difference(W.feature_stats(rows, "l_suppkey", FEATURES), late, "l_suppkey", FEATURES, 3, 0.1)
    return out.select("l_suppkey", "feature", W.descriptor_text(F.col("feature"), F.col("z"), F.col("value"), F.col("mean")).alias("text"))


# stores, profiles and suites

#: Draws of the seeded generator with seed 1: i (from 0) and draw.
DRAWS = MULBERRY.replace("p_partkey, (7 + (CAST(p_partkey AS HUGEINT) * 1831565813)) % 4294967296 AS x FROM part", "i, (1 + (CAST(i + 1 AS HUGEINT) * 1831565813)) % 4294967296 AS x FROM range(0, (SELECT count(*) FROM embeddings)) t(i)").replace("p_partkey", "i").replace("round(xor(t, t >> 14) / 4294967296.0::DOUBLE, 9)", "xor(t, t >> 14) / 4294967296.0::DOUBLE")
FOLDS = f"""dr AS ({DRAWS}), la AS (SELECT label, min(vec_id) AS first, count(*) AS n, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label),
lo AS (SELECT label, n, ids, CAST(coalesce(sum(n - 1) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM la),
sh AS (SELECT label, n, off, n - 1 AS i, ids FROM lo
UNION ALL SELECT label, n, off, sh.i - 1, list_transform(ids, lambda x, k: CASE WHEN k = sh.i + 1 THEN ids[CAST(floor(draw * (sh.i + 1)) AS BIGINT) + 1] WHEN k = CAST(floor(draw * (sh.i + 1)) AS BIGINT) + 1 THEN ids[sh.i + 1] ELSE x END) FROM sh JOIN dr ON dr.i = off + n - 1 - sh.i WHERE sh.i > 0),
nf AS (SELECT greatest(2, least(5, min(n))) AS folds FROM la),
fo AS (SELECT unnest(ids) AS id, unnest(range(0, len(ids))) % (SELECT folds FROM nf) AS fold FROM sh WHERE i = 0),
{NEAR.replace(", (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings", ", fold FROM embeddings JOIN fo ON fo.id = vec_id")},
top AS (SELECT * FROM pairs WHERE f <> g QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, other) <= 5),
v AS (SELECT id, truth, label, sum(1 / (distance + 1e-6)) AS w FROM top GROUP BY id, truth, label), p AS (SELECT id, truth, arg_max(label, w) AS predicted FROM v GROUP BY id, truth)"""


@query(f"WITH RECURSIVE {FOLDS} SELECT truth AS label, predicted, count(*) AS n FROM p GROUP BY truth, predicted")
def cross_validate(s, d):
    return V.cross_validate(_t(s, d, "embeddings"))


@query(f"""WITH RECURSIVE {FOLDS}, r AS (SELECT label, count(*) AS support FROM embeddings GROUP BY label)
SELECT label, support, round((SELECT avg(CASE WHEN predicted = truth THEN 1 ELSE 0 END) FROM p WHERE truth = label), 6) AS recall, round(coalesce((SELECT avg(CASE WHEN predicted = truth THEN 1 ELSE 0 END) FROM p WHERE predicted = label), 0), 6) AS "precision",
       round((SELECT avg(CASE WHEN predicted = truth THEN 1 ELSE 0 END) FROM p), 6) AS accuracy, (SELECT count(*) FROM p) AS total, CAST((SELECT folds FROM nf) AS INTEGER) AS folds FROM r""")
def validation_report(s, d):
    return V.validation_report(_t(s, d, "embeddings")).select("label", "support", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "accuracy")), "total", "folds")


STORE = "ex AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings WHERE vec_id % 2 = 0), st AS (SELECT 'e' || place AS id, 'class ' || label AS label, embedding, place FROM ex WHERE label <> 3 AND place <> 1)"


def _store(s, d):
    e = _t(s, d, "embeddings").where("vec_id % 2 = 0").withColumn("label", F.concat(F.lit("class "), F.col("label").cast("string")))
    half = store.KnnStore.empty(s).add(e.where("vec_id < 200"), "vec_id").add(e.where("vec_id >= 200"), "vec_id")
    return half.remove_label("class 3").remove("e1", "none")


@query(f"WITH {STORE} SELECT id, label, place, round(sqrt({SUMSQ}), 4) AS norm FROM st")
def knn_store(s, d):
    return _store(s, d).examples.select("id", "label", "place", F.round(C.norm(F.col("embedding")), 4).alias("norm"))


@query(f"WITH {STORE} SELECT label, min(place) AS place, count(*) AS n FROM st GROUP BY label")
def knn_store_labels(s, d):
    return _store(s, d).labels()


@query(f"""WITH {STORE}, q AS (SELECT vec_id, list_transform({EMB}, lambda x: x / sqrt({SUMSQ})) AS e FROM embeddings WHERE vec_id % 2 = 1), x AS (SELECT id, label, place, list_transform({EMB}, lambda x: x / sqrt({SUMSQ})) AS e FROM st),
top AS (SELECT q.vec_id AS id, label, 1 - list_dot_product(q.e, x.e) AS distance FROM q, x QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, place) <= 5),
v AS (SELECT id, label, sum(1 / (distance + 1e-6)) AS w FROM top GROUP BY id, label) SELECT id, arg_max(label, w) AS label, round(max(w) / sum(w), 6) AS confidence FROM v GROUP BY id""")
def knn_store_predict(s, d):
    return _store(s, d).predict(_t(s, d, "embeddings").where("vec_id % 2 = 1")).select("id", "label", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {PROTO}, c AS (SELECT un.vec_id, 'text ' || pr.label AS label, sum(un.v * pr.v) AS sim FROM un JOIN pr USING (pos) GROUP BY un.vec_id, pr.label)
SELECT vec_id, label, round(sim, 6) + 0.0 AS similarity, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS INTEGER) AS place FROM c""")
def rank_by_text(s, d):
    e = _t(s, d, "embeddings")
    texts = V.prototypes(e).withColumn("label", F.concat(F.lit("text "), F.col("label").cast("string")))
    return V.rank_by_text(e, texts).select("vec_id", "label", r6(F.col("similarity")).alias("similarity"), "place")


#: Profiles: labels of one parity are the states of a profile, in order of label.
STATES = f"""{DIST}, qs AS (SELECT label, quantile_cont(distance, 0.5) AS p50, quantile_cont(distance, 0.95) AS p95, max(distance) AS top, list(distance ORDER BY distance) AS s FROM di GROUP BY label),
wi AS (SELECT DISTINCT x.vec_id, x.label % 2 AS profile FROM x), al AS (SELECT x.vec_id, x.label % 2 AS profile, ga.label AS state, sqrt(avg((v - mean) * (v - mean) / variance)) AS d FROM x JOIN ga ON ga.pos = x.pos AND ga.label % 2 = x.label % 2 GROUP BY ALL),
lo AS (SELECT al.*, s, p50, p95, top, len(list_filter(s, lambda y: y <= d)) AS c FROM al JOIN qs ON qs.label = state),
so AS (SELECT vec_id, profile, state, d, CASE WHEN d <= top THEN 0.5 * CASE WHEN d <= s[1] THEN 0 WHEN d >= s[len(s)] THEN 1 ELSE (c - 1 + CASE WHEN s[c + 1] > s[c] THEN (d - s[c]) / (s[c + 1] - s[c]) ELSE 0 END) / (len(s) - 1) END ELSE 1 - 0.5 * exp(-(d - top) / greatest(p95 - p50, 0.05 * top, 1e-6)) END AS score FROM lo),
be AS (SELECT * FROM so QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score, state) = 1)"""


def _states(s, d):
    e = _t(s, d, "embeddings")
    states = V.states_of(e, "label").select((F.col("label") % 2).alias("profile"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("state"), F.col("label").alias("place"), "n", "mean", "variance", "samples", "p50", "p95", "max")
    return e.withColumn("profile", F.col("label") % 2), states


@query(f"WITH {STATES} SELECT profile, vec_id, 's' || state AS state, round(score, 6) + 0.0 AS score, round(d, 6) AS distance FROM be")
def state_scores(s, d):
    return V.score_by_state(*_states(s, d), "profile").select("profile", "vec_id", "state", r6(F.col("score")).alias("score"), F.round("distance", 6).alias("distance"))


@query(f"""WITH {STATES}, co AS (SELECT profile, state, count(*) AS c, min(vec_id) AS f FROM be GROUP BY profile, state), dm AS (SELECT profile, 's' || state AS state FROM co QUALIFY row_number() OVER (PARTITION BY profile ORDER BY c DESC, f) = 1),
ch AS (SELECT profile, quantile_cont(score, 0.9) AS score, avg(CASE WHEN score >= 0.9 THEN 1 ELSE 0 END) AS f, count(*) AS windows FROM be GROUP BY profile)
SELECT profile, round(score, 6) + 0.0 AS score, round(f, 6) + 0.0 AS anomalous_fraction, windows, state, CASE WHEN score >= 0.9 THEN 'anomalous' WHEN score >= 0.4 THEN 'watch' ELSE 'normal' END AS status FROM ch JOIN dm USING (profile)""")
def state_check(s, d):
    out = V.check_by_state(V.score_by_state(*_states(s, d), "profile"), "profile", 0.4)
    return out.select("profile", r6(F.col("score")).alias("score"), r6(F.col("anomalous_fraction")).alias("anomalous_fraction"), "windows", "state", "status")


@query("""WITH w AS (SELECT unnest(range(0, 12)) AS i), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT CAST(i % 2 AS INTEGER) AS profile, 's' || i AS state, coalesce(n, 0) AS n FROM w LEFT JOIN n ON n.label = i""")
def state_lookup(s, d):
    wanted = s.range(12).select((F.col("id") % 2).cast("int").alias("profile"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("state"))
    return V.find_state(_states(s, d)[1], "profile", wanted).select("profile", "state", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH RECURSIVE v AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'normal' ELSE 'anomalous' END AS verdict, CASE WHEN event_id % 7 > 0 THEN least(1, value / 500) END AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT user_id, 0::BIGINT AS i, 0.6::DOUBLE AS w, 0.8::DOUBLE AS a, 0.0::DOUBLE AS given FROM v WHERE i = 1
UNION ALL SELECT user_id, i, least(greatest(least(w, a - 0.005), 0.4), 0.995), least(greatest(a, 0.45), 0.999), x FROM (
  SELECT user_id, i, x, CASE WHEN up THEN uw WHEN down THEN least(da - 0.01, w - 0.5 * (w - greatest(0.4, x - 0.05))) ELSE w END AS w, CASE WHEN up THEN greatest(uw + 0.01, a + 0.5 * (least(0.999, x + 0.02) - a)) WHEN down THEN da ELSE a END AS a FROM (
    SELECT v.user_id, v.i, w, a, coalesce(score, w) AS x, verdict = 'normal' AND coalesce(score, w) >= w AS up, verdict = 'anomalous' AND coalesce(score, w) < a AS down, w + 0.5 * (least(0.995, coalesce(score, w) + 0.01) - w) AS uw, a - 0.5 * (a - greatest(0.5, coalesce(score, w) - 0.01)) AS da
    FROM s JOIN v ON v.user_id = s.user_id AND v.i = s.i + 1)))
SELECT user_id, max(i) + 1 AS revision, max(i) AS records, round(arg_max(w, i), 6) AS watch, round(arg_max(a, i), 6) AS anomalous, round(arg_max(given, i), 6) AS last_score FROM s GROUP BY user_id""")
def calibration_history(s, d):
    e = _t(s, d, "events")
    verdicts = e.select("user_id", F.col("event_id").alias("at"), F.when(F.col("event_id") % 2 == 0, "normal").otherwise("anomalous").alias("verdict"), F.when(F.col("event_id") % 7 > 0, F.least(F.lit(1.0), F.col("value") / 500)).alias("score"))
    none = F.array().cast("array<struct<verdict:string,score:double,watch:double,anomalous:double,at:bigint>>")
    profiles = e.select("user_id").distinct().select("user_id", F.lit(0.6).alias("watch"), F.lit(0.8).alias("anomalous"), F.lit(1).cast("long").alias("revision"), none.alias("calibrations"))
    out = store.calibrate(profiles, verdicts, "user_id")
    last = F.element_at("calibrations", -1)["score"]
    return out.select("user_id", "revision", F.size("calibrations").cast("long").alias("records"), F.round("watch", 6).alias("watch"), F.round("anomalous", 6).alias("anomalous"), F.round(last, 6).alias("last_score"))


@query("""WITH d AS (SELECT user_id % 10 AS machine, event_id AS clip, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS abnormal, value AS score FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY score, clip) AS r FROM d), s AS (SELECT machine, sum(CASE WHEN abnormal = 1 THEN r END) AS s, sum(abnormal) AS p, count(*) AS n FROM r GROUP BY machine)
SELECT machine, round(CASE WHEN p = 0 OR p = n THEN 0 ELSE (s - p * (p + 1) / 2) / (p * (n - p)) END, 6) AS auc, n AS clips FROM s""")
def anomaly_auc(s, d):
    rows = _t(s, d, "events").select((F.col("user_id") % 10).alias("machine"), F.col("event_id").alias("clip"), (F.col("event_type") == "purchase").cast("int").alias("abnormal"), F.col("value").alias("score"))
    return suites.anomaly_auc(rows).select("machine", F.round("auc", 6).alias("auc"), "clips")


@query("""SELECT round(avg(CASE WHEN n > 0 THEN 1 ELSE 0 END), 6) AS recall, count(*) AS clips FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value >= 300) AS n FROM events GROUP BY user_id)""")
def detection_recall(s, d):
    e = _t(s, d, "events").withColumn("stream_id", F.col("user_id"))
    return suites.detection_recall(e, e.where((F.col("event_type") == "purchase") & (F.col("value") >= 300))).select(F.round("recall", 6).alias("recall"), "clips")


@query("""SELECT l_suppkey AS label, l_partkey AS clip, arg_max(l_quantity, struct_pack(a := l_extendedprice, b := -l_orderkey, c := -l_linenumber)) AS loudest FROM lineitem GROUP BY ALL""")
def loudest_window(s, d):
    rows = _t(s, d, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_partkey").alias("clip"), F.array("l_quantity").alias("embedding"), F.col("l_extendedprice").alias("rms_dbfs"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"))
    return suites.loudest(rows).select("label", "clip", F.col("embedding")[0].alias("loudest"))


@query()
def pair_identity(s, d):
    return suites.pair_identity(_t(s, d, "embeddings"))


@query()
def anomaly_suite(s, d):
    """Two machines of each label's vectors: clips of six windows, a third of them from another label."""
    e = _t(s, d, "embeddings").select("vec_id", "label", C.doubles(F.col("embedding")).alias("vector"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = e.withColumn("i", place).select(F.pmod("label", F.lit(2)).alias("machine"), (F.col("label").cast("long") * (1 << 32) + F.floor(F.col("i") / 6)).alias("clip"), (F.col("label") >= 8).cast("int").alias("abnormal"), F.lit(True).alias("accepted"), F.col("i").cast("double").alias("t"), "vector")
    return suites.anomaly_auc(suites.anomaly_scores(rows))
