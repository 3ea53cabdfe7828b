"""Invariants over the driver fixtures and a hot-event (skew) check."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremor.operators import features as A
from tremor.operators import labels as L
from tremor.operators import pooling as V
from tremor.operators import scoring as E
from tremor.operators import windows as W
from tremor.sources import fixtures as FX

from conftest import SF_MID, rows


def test_feature_invariants(spark):
    f = A.event_features(FX.fx_meta(spark, SF_MID), default_year=2024)
    assert A.check_features(f).count() == 0
    for c in ("night_ratio", "user_post_ratio", "location_diversity", "top_location_ratio"):
        lo, hi = f.agg(F.min(c), F.max(c)).first()
        assert 0.0 <= lo <= hi <= 1.0, c
    assert f.agg(F.sum("post_count")).first()[0] == FX.table(spark, SF_MID, "events").count()


def test_probabilities_sum_to_one(spark):
    v = FX.fx_vec(spark, SF_MID).select(F.col("pos").cast("string").alias("event"), "logits")
    s = E.score_events(v).select(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x).alias("t"))
    lo, hi = s.agg(F.min("t"), F.max("t")).first()
    assert abs(lo - 1) < 1e-12 and abs(hi - 1) < 1e-12


def test_split_and_results_invariants(spark):
    lab = L.encode_labels(FX.fx_labels(spark, SF_MID))
    sp = L.stratified_split(FX.fx_catalogue(spark, SF_MID), lab)
    assert L.split_overlap(sp).count() == 0
    assert sp.count() == lab.count()
    conv = FX.fx_conv(spark, SF_MID).drop("conv_id")
    capped = W.cap_posts(conv, 4)
    preds = conv.select("event").distinct().select("event", F.lit(1).alias("predicted_class"),
                                                   F.lit("中等").alias("predicted_label"))
    assert E.post_results(capped, preds).count() <= capped.count()
    sizes = W.post_lists(capped, 4).select(F.size("posts").alias("n")).distinct().collect()
    assert [r.n for r in sizes] == [4]


@pytest.fixture(scope="module")
def hot(spark):
    """One event holds 40% of all posts; 300 small events share the rest."""
    rng = np.random.default_rng(4)
    n = 30000
    ev = np.where(np.arange(n) < 12000, "hot", np.char.add("e", (np.arange(n) % 300).astype(str)))
    pdf = pd.DataFrame({
        "event": ev, "pos": np.arange(n, dtype=np.int64),
        "published_raw": [f"2025-01-{1 + i % 28:02d} {i % 24:02d}:{i % 60:02d}" for i in range(n)],
        "reposts": (np.arange(n) % 7).astype(str), "comments": "1", "likes": "2",
        "nickname": np.char.add("u", (rng.integers(0, 5000, n)).astype(str)),
        "location": np.char.add("p", (np.arange(n) % 13).astype(str)),
        "text": np.where(np.arange(n) % 10 == 0, " ", "t"),
    })
    return pdf, spark.createDataFrame(pdf).repartition(8)


def test_hot_event_features(spark, hot):
    pdf, df = hot
    f = {r.event: r for r in A.event_features(df, 2024).collect()}
    h = pdf[pdf.event == "hot"]
    assert f["hot"].post_count == len(h)
    assert f["hot"].unique_users == h.nickname.nunique()
    assert f["hot"].location_diversity == pytest.approx(h.location.nunique() / len(h))
    assert f["hot"].avg_reposts == pytest.approx(h.reposts.astype(float).mean())
    hours = pd.to_datetime(h.published_raw).dt.hour.value_counts()
    assert f["hot"].peak_hour == min(hours[hours == hours.max()].index)
    assert len(f) == 301


def test_hot_event_caps_and_pools(spark, hot):
    pdf, df = hot
    capped = W.cap_posts(df, 5)
    got = capped.where(F.col("event") == "hot").orderBy("pos").select("pos").collect()
    expect = pdf[(pdf.event == "hot") & (pdf.text != " ")].pos.head(5).tolist()
    assert [r.pos for r in got] == expect
    vec = df.select("event", "pos", F.array(F.col("pos").cast("double"), F.lit(1.0)).alias("vec"),
                    (F.col("text") != " ").alias("valid"))
    m = {r.event: r.vec for r in V.mean_pool(vec).collect()}
    hv = pdf[(pdf.event == "hot") & (pdf.text != " ")].pos
    assert m["hot"][0] == pytest.approx(hv.sum() / (len(hv) + 1e-10))
    dropped = W.drop_posts(df.select("event", "pos"), 0.99, seed=5)
    per = dropped.groupBy("event").count()
    assert per.count() == 301 and per.agg(F.min("count")).first()[0] >= 1


def test_two_stage_cap_is_exact(spark, hot):
    """Any number of buckets gives the same first n rows."""
    _, df = hot
    one = rows(W.cap_posts(df, 5, buckets=1), "event", "pos", "slot")
    assert one == rows(W.cap_posts(df, 5, buckets=3), "event", "pos", "slot") == rows(W.cap_posts(df, 5), "event", "pos", "slot")
    assert len(one) > 0
