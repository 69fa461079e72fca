import numpy as np
import pandas as pd

from tidewave.functions.machines import StreamScorer
from tidewave.sources import synthetic
from tidewave.streaming.processors import frame_stream, watch_stream


def _drain(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).toPandas()


def test_streams_equal_batches(spark, tmp_path):
    scores = np.random.default_rng(1).uniform(0, 1, 60)
    rows = pd.DataFrame({"stream_id": ["a"] * 60, "t": np.arange(60.0), "score": scores})
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("stream_id string, t double, score double").parquet(str(tmp_path / "s"))
    got = _drain(watch_stream(stream, 0.5, 0.8), "watched", spark).sort_values("t")
    plain = StreamScorer(0.5, 0.8)
    want = [plain.push(float(x)) for x in scores]
    assert len(got) == 60 and np.allclose(got["smoothed"], [w[0] for w in want]) and got["status"].tolist() == [w[1] for w in want]


def test_frames_of_a_stream(spark, tmp_path):
    x = synthetic.pink_noise(2)
    chunks = [("a", i, x[a : a + 4000].tolist()) for i, a in enumerate(range(0, len(x), 4000))]
    spark.createDataFrame(chunks, "stream_id string, chunk_seq long, samples array<float>").coalesce(1).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("stream_id string, chunk_seq long, samples array<float>").parquet(str(tmp_path / "c"))
    got = _drain(frame_stream(stream), "framed", spark).sort_values("t")
    assert len(got) == (len(x) - 15600) // 7800 + 1 and np.allclose(got["samples"].iloc[1], x[7800 : 7800 + 15600])
