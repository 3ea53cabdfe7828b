"""Labels, split, windows, pooling, metrics and losses against hand or numpy values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import labels as L
from tremor.operators import metrics as M
from tremor.operators import pooling as V
from tremor.operators import windows as W

from conftest import rows


# ---------------------------------------------------------------- labels / split

def test_label_dedupe_last_wins(spark):
    df = spark.createDataFrame([("a", "r1", "轻微", 0), ("a", "r2", "严重", 1), ("b", "r", "中等", 0)],
                               "event string, reason string, severity string, position int")
    assert rows(L.dedupe_labels(df)) == [("a", "r2", "严重"), ("b", "r", "中等")]


def test_join_labels_defaults(spark):
    ev = spark.createDataFrame([("a",), ("z",)], "event string")
    lab = L.encode_labels(spark.createDataFrame([("a", "严重")], "event string, severity string"))
    assert rows(L.join_labels(ev, lab), "event", "level", "label_defaulted") == [("a", 2, False), ("z", 0, True)]


def test_missing_events_strict(spark):
    req = spark.createDataFrame([("a",), ("b",)], "event string")
    have = spark.createDataFrame([("a",)], "event string")
    assert rows(L.missing_events(req, have)) == [("b",)]
    with pytest.raises(FileNotFoundError):
        L.missing_events(req, have, strict=True)


def test_stratified_split(spark):
    ev = [(f"e{i}", i % 3 if i < 60 else 2) for i in range(61)] + [("solo", 5)]
    cat = spark.createDataFrame([(e,) for e, _ in ev], "event string")
    lab = spark.createDataFrame(ev, "event string, level int")
    sp = L.stratified_split(cat, lab, 0.8, 42)
    dist = {(r.part, r.level): r.n for r in L.level_distribution(sp).collect()}
    assert dist[("train", 0)] == 16 and dist[("val", 0)] == 4
    assert dist[("train", 2)] == 16 and dist[("val", 2)] == 5   # n=21 -> floor(16.8)
    assert dist[("train", 5)] == 1 and ("val", 5) not in dist     # singleton goes to train
    assert L.split_overlap(sp).count() == 0
    again = L.stratified_split(cat, lab, 0.8, 42)
    assert rows(sp) == rows(again)


def test_class_weights(spark):
    lab = spark.createDataFrame([(0,)] * 28 + [(1,)] * 50 + [(2,)] * 29, "level int")
    w = {r.level: r.weight for r in L.class_weights(lab).collect()}
    inv = np.array([1 / 28, 1 / 50, 1 / 29])
    exp = inv / inv.sum() * 3
    assert [w[i] for i in range(3)] == pytest.approx(list(exp))
    w2 = {r.level: r.weight for r in L.class_weights(lab, counts=[28, 50, 29]).collect()}
    assert [w2[i] for i in range(3)] == pytest.approx(list(exp))


# ---------------------------------------------------------------- windows

def conv(spark):
    data = [("a", i, str(i), "  " if i in (1, 2) else f"t{i}") for i in range(7)] + [("b", 0, "", "x")]
    return spark.createDataFrame(data, "event string, pos long, id string, text string")


def test_cap_skips_blank(spark):
    got = rows(W.cap_posts(conv(spark), 3), "event", "pos", "slot")
    assert got == [("a", 0, 0), ("a", 3, 1), ("a", 4, 2), ("b", 0, 0)]
    with_blank = rows(W.cap_posts(conv(spark), 3, count_blank=True), "event", "pos")
    assert with_blank == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_cap_plan_has_group_limit(spark):
    plan = W.cap_posts(conv(spark), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_padded_lists_and_topic(spark):
    capped = W.cap_posts(conv(spark), 3)
    long = W.explode_lists(W.post_lists(capped, 3, add_topic=True))
    b = [r for r in long.collect() if r.event == "b"]
    assert [(r.slot, r.text) for r in sorted(b, key=lambda r: r.slot)] == [(0, "Topic: b"), (1, "x"), (2, ""), (3, "")]
    assert sorted(b, key=lambda r: r.slot)[2].id is None


def test_drop_posts_keeps_one(spark):
    df = spark.createDataFrame([(f"e{i % 50}", i) for i in range(200)], "event string, pos long")
    kept = W.drop_posts(df, 0.95, seed=1, epoch=3)
    per = {r.event: r.n for r in kept.groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert len(per) == 50 and min(per.values()) >= 1
    assert kept.count() < 200
    assert rows(kept) == rows(W.drop_posts(df, 0.95, seed=1, epoch=3))
    assert W.drop_posts(df, 0.0).count() == 200


def test_best_epoch(spark):
    h = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.6)], "epoch int, val_f1 double")
    got = rows(W.best_epoch(h), "epoch", "prev_best", "improved", "is_best")
    assert got == [(1, 0.0, True, False), (2, 0.5, True, True), (3, 0.7, False, False), (4, 0.7, False, False)]


# ---------------------------------------------------------------- pooling

def vecs(spark):
    rng = np.random.default_rng(0)
    data = []
    for e in ("a", "b", "c"):
        for p in range(6):
            v = rng.normal(size=4).tolist()
            valid = not (e == "c" or p == 2)
            data.append((e, p, v, valid, float(v[0])))
    return data, spark.createDataFrame(data, "event string, pos long, vec array<double>, valid boolean, score double")


def test_pools_vs_numpy(spark):
    data, df = vecs(spark)
    mean = {r.event: r.vec for r in V.mean_pool(df).collect()}
    mx = {r.event: r.vec for r in V.max_pool(df).collect()}
    cls = {r.event: r.vec for r in V.cls_pool(df).collect()}
    att = {r.event: r.vec for r in V.attentive_pool(df).collect()}
    for e in ("a", "b", "c"):
        rows_e = [d for d in data if d[0] == e]
        m = np.array([d[2] for d in rows_e])
        mask = np.array([d[3] for d in rows_e], dtype=float)
        assert mean[e] == pytest.approx(list((m * mask[:, None]).sum(0) / (mask.sum() + 1e-10)), abs=1e-12)
        assert cls[e] == pytest.approx(list(m[0]))
        s = np.where(mask > 0, [d[4] for d in rows_e], -1e9)
        w = np.exp(s - s.max())
        assert att[e] == pytest.approx(list((w[:, None] * m).sum(0) / w.sum()), abs=1e-12)
        if mask.sum():
            assert mx[e] == pytest.approx(list(m[mask > 0].max(0)))
        else:
            assert mx[e] is None
    assert {r.event: r.vec for r in V.max_pool(df, compat_inf=True).collect()}["c"] == [-math.inf] * 4


def test_unmasked_and_compact(spark):
    data, df = vecs(spark)
    un = {r.event: r.vec for r in V.attentive_pool_unmasked(df, n_slots=10).collect()}
    rows_a = [d for d in data if d[0] == "a"]
    m = np.vstack([np.array([d[2] for d in rows_a]), np.zeros((4, 4))])
    s = np.array([d[4] for d in rows_a] + [0.0] * 4)
    w = np.exp(s - s.max())
    assert un["a"] == pytest.approx(list((w[:, None] * m).sum(0) / w.sum()), abs=1e-12)
    comp = {r.event: r for r in V.compact_slots(df, 4).collect()}
    assert comp["a"].n_valid == 4 and len(comp["a"].vecs) == 4
    assert comp["a"].vecs[2] == pytest.approx(rows_a[3][2])   # pos 2 is invalid, skipped


# ---------------------------------------------------------------- metrics / losses

PRED = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2), (1, 0)]


def pred_df(spark):
    return spark.createDataFrame([(str(i), t, p) for i, (t, p) in enumerate(PRED)], "event string, true int, pred int")


def _ref_metrics():
    labels = sorted({t for t, _ in PRED} | {p for _, p in PRED})
    out = {}
    for c in labels:
        tp = sum(1 for t, p in PRED if t == c and p == c)
        sup = sum(1 for t, _ in PRED if t == c)
        prd = sum(1 for _, p in PRED if p == c)
        pr = tp / prd if prd else 0.0
        rc = tp / sup if sup else 0.0
        out[c] = (pr, rc, 2 * pr * rc / (pr + rc) if pr + rc else 0.0, sup)
    return out


def test_confusion_and_metrics(spark):
    cm = rows(M.confusion(pred_df(spark)))
    assert len(cm) == 9 and sum(n for *_, n in cm) == len(PRED)
    ref = _ref_metrics()
    mac = M.macro_metrics(pred_df(spark)).first()
    assert mac.accuracy == pytest.approx(4 / 7)
    assert mac.macro_f1 == pytest.approx(np.mean([v[2] for v in ref.values()]))
    assert mac.macro_precision == pytest.approx(np.mean([v[0] for v in ref.values()]))
    wm = M.weighted_metrics(pred_df(spark)).first()
    assert wm.weighted_f1 == pytest.approx(sum(v[2] * v[3] for v in ref.values()) / len(PRED))


def logit_df(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(40, 3))
    y = rng.integers(0, 3, size=40)
    df = spark.createDataFrame([(str(i), z[i].tolist(), int(y[i]), i // 4) for i in range(40)],
                               "event string, logits array<double>, y int, batch long")
    return z, y, df


def _logp(z):
    m = z.max(1, keepdims=True)
    return z - m - np.log(np.exp(z - m).sum(1, keepdims=True))


def test_losses_vs_numpy(spark):
    z, y, df = logit_df(spark)
    lp = _logp(z)
    nll = -lp[np.arange(len(y)), y]
    assert M.cross_entropy(df).first().loss == pytest.approx(nll.mean())
    eps = 0.1
    assert M.smoothed_cross_entropy(df, eps).first().loss == pytest.approx(((1 - eps) * nll + eps * (-lp).mean(1)).mean())
    counts = np.bincount(y, minlength=3)
    w = (1 / counts) / (1 / counts).sum() * 3
    num = ((1 - eps) * w[y] * nll + eps / 3 * (w[None, :] * -lp).sum(1)).sum()
    assert M.weighted_smoothed_cross_entropy(df, eps).first().loss == pytest.approx(num / w[y].sum())
    pt = np.exp(-nll)
    assert M.focal_loss(df).first().loss == pytest.approx(((1 - pt) ** 2 * nll).mean())
    assert M.focal_loss(df, reduction="sum").first().loss == pytest.approx(((1 - pt) ** 2 * nll).sum())
    b = M.batched_loss(df).first()
    assert b.loss == pytest.approx(np.mean([nll[i:i + 4].mean() for i in range(0, 40, 4)]))
    assert b.n_batches == 10


def plain_multinomial(x, y, w, reg):
    """Weighted multinomial logistic regression by Newton steps: class probabilities of the rows.

    The penalty is on coefficients of features scaled by their weighted deviation, not on intercepts.
    """
    mean = (w[:, None] * x).sum(0) / w.sum()
    scaled = x / np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w ** 2).sum() / w.sum()))
    a = np.column_stack([scaled, np.ones(len(x))])
    n, classes = a.shape[1], y.max() + 1
    penalty = np.tile(np.append(np.full(n - 1, reg), 0.0), classes)
    beta = np.zeros(n * classes)
    share = w / w.sum()
    for _ in range(60):
        z = a @ beta.reshape(classes, n).T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gradient = ((share[:, None] * (p - np.eye(classes)[y])).T @ a).ravel() + penalty * beta
        hessian = np.diag(penalty)
        for j in range(classes):
            for k in range(classes):
                v = share * p[:, j] * ((j == k) - p[:, k])
                hessian[j * n:(j + 1) * n, k * n:(k + 1) * n] += a.T @ (v[:, None] * a)
        beta = beta - np.linalg.pinv(hessian, rcond=1e-12) @ gradient
    return p


def test_classifier_against_a_plain_fit(spark):
    from tremor.operators import scoring as E
    rng = np.random.default_rng(6)
    y = np.repeat([0, 1, 2], [150, 60, 30])
    x = rng.normal(size=(len(y), 3)) * [1.0, 5.0, 0.2] + np.array([[0, 0, 0], [0.5, 3, 0.1], [-0.5, 4, -0.1]])[y]
    df = spark.createDataFrame([(str(i), v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "event string, features array<double>, label int")
    weights = L.class_weights(df.select(F.col("label").alias("level")))
    by_class = {r.level: r.weight for r in weights.collect()}
    train = df.join(weights.select(F.col("level").alias("label"), "weight"), "label")
    got = {int(r.event): r.probability for r in E.predict_classes(E.train_classifier(train), df).collect()}
    want = plain_multinomial(x, y, np.array([by_class[c] for c in y]), 1e-4)
    assert np.abs(np.array([got[i] for i in range(len(y))]) - want).max() < 2e-3
    unweighted = plain_multinomial(x, y, np.ones(len(y)), 1e-4)
    assert np.abs(unweighted - want).max() > 0.05  # the weights matter here
    plain = {int(r.event): r.probability for r in E.predict_classes(E.train_classifier(df, weight_col=None), df).collect()}
    assert np.abs(np.array([plain[i] for i in range(len(y))]) - unweighted).max() < 2e-3


def test_mlp_classifier(spark):
    from tremor.operators import scoring as E
    rng = np.random.default_rng(2)
    rows_ = [(str(i), rng.normal(size=4).tolist(), int(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows_, "event string, features array<double>, label int")
    model = E.train_classifier(df, classifier="mlp", weight_col=None, max_iter=20, hidden=8)
    out = E.predict_classes(model, df)
    assert out.count() == 60 and set(r.pred for r in out.collect()) <= {0, 1, 2}
    with pytest.raises(ValueError):
        E.train_classifier(df, classifier="svm")


def test_shuffle_key_is_seeded(spark):
    ev = spark.createDataFrame([(f"e{i}",) for i in range(20)], "event string")
    order = lambda s, e: [r.event for r in ev.orderBy(W.shuffle_key(s, e)).collect()]
    assert order(1, 0) == order(1, 0)
    assert order(1, 0) != order(1, 1)


def test_shuffle_partitions_sized_from_input(spark):
    from tremor.plans import tuning
    gb = 1024 ** 3
    assert tuning.shuffle_partitions_for(0, 8) == 8
    assert tuning.shuffle_partitions_for(100 * gb, 8) == 160          # capped at 20 waves
    assert tuning.shuffle_partitions_for(100 * 1024 * gb, 8000) == 160000   # 100 TB: 204,800 wanted, capped
    assert tuning.shuffle_partitions_for(50 * gb, 1000) == 1000       # one wave at least
    assert tuning.shuffle_partitions_for(5000 * gb, 1000) == 10000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert tuning.suggested_shuffle_partitions(spark, spark.createDataFrame([(100 * gb,)], "length long")) == 80
    assert spark.conf.get("spark.sql.shuffle.partitions") == before   # a suggestion only


def test_session_fills_only_unset_settings(spark):
    from tremor import session
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "20m")                      # the cluster's / job's choice
        assert session.fill_unset(spark, {key: "1"}) == {}
        assert spark.conf.get(key) == "20m"
        spark.conf.unset(key)                           # nothing chosen: the default is filled
        assert session.fill_unset(spark, {key: "12345"}) == {key: "12345"}
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.set(key, before)
