import duckdb
import pytest

from tidewave.plans import queries as core

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels".split():
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, duck, name):
    a, b = core.QUERIES[name](spark, D).toPandas(), duck.sql(core.SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda x: sorted(map(tuple, x[columns].astype(str).values.tolist()))
    assert rows(a) == rows(b)


#: Queries that SQL can't express, and what holds for their rows.
GOLDEN = {
    # windows differ in the pitch of their call only; centroids rise with it
    "feature_extract": lambda t: t.window_id.is_unique and t.rms.between(-20.1, -19.9).all() and t.flatness.between(0, 0.01).all() and t.centroid.corr(t.window_id) > 0.9 and t.flux.between(0.05, 0.3).all(),
    # the call of window i is at 200 + i % 500 Hz, and the middle half of the window is voiced
    "pitch_track": lambda t: ((t.f0 - (200 + t.window_id % 500)).abs() < 0.02 * t.f0).mean() > 0.95 and t.voiced.between(0.35, 0.65).mean() > 0.95 and (t.slope.abs() < 5).mean() > 0.9,
    "kmeans_select": lambda t: t.groupby("label").n.sum().sum() == 500 and (t.groupby("label").k.nunique() == 1).all(),
    "learn_profile": lambda t: len(t) == 10 and (t.watch < t.anomalous).all() and t.watch.between(0.55, 0.9).all() and (t.check_score - t.compact_score).abs().max() < 0.01,
    "mlp_head": lambda t: t.n.sum() == 500 and t[t.label == t.predicted].n.sum() > 300,
    "event_detector": lambda t: (t.stop > t.start).all() and (t.type == "Cat").all() and (t.syllables >= 1).all(),
    "pair_identity": lambda t: len(t) == 45 and t.accuracy.between(0, 1).all() and t.accuracy.mean() > 0.5,
    "anomaly_suite": lambda t: len(t) == 2 and t.auc.between(0, 1).all(),
}


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql(spark, name):
    t = core.QUERIES[name](spark, D).toPandas()
    assert len(t) and GOLDEN[name](t), t.head()
