"""End-to-end flows over event files written by the test."""

import os

import pytest
from pyspark.sql import functions as F

from tremor.plans import flows
from tremor.sources import files as IO

HEAD = "id,用户昵称,微博正文,发布位置,转发数,评论数,点赞数,发布时间"
WORDS = ["地震", "暴雨", "停电", "火灾", "演唱会", "新品", "比赛", "交通"]


@pytest.fixture(scope="module")
def corpus_root(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("flow"))
    levels = {}
    for e in range(24):
        name = f"事件{e}"
        lvl = e % 3
        levels[name] = ["轻微", "中等", "严重"][lvl]
        lines = [HEAD]
        for p in range(5 + e % 4):
            w = WORDS[(lvl * 2 + p) % len(WORDS)]
            lines.append(f"{p},u{p % 3},#{w}#{w}发生了，请注意！ O网页链接,地点{p % 2},{p},{lvl},{p * 2},2025-0{1 + lvl}-0{1 + p % 5} {8 + p}:00")
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/{name}.csv", "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    os.makedirs(f"{root}/空事件")
    with open(f"{root}/空事件/空事件.csv", "w", encoding="utf-8") as f:
        f.write(HEAD + "\n")
    return root, levels


def test_full_flow(spark, corpus_root, tmp_path):
    root, levels = corpus_root
    corpus = flows.prepare_corpus(spark, root, default_year=2024, cache_path=str(tmp_path / "cache"))
    feats = {r.event: r for r in corpus.features.collect()}
    assert len(feats) == 25 and feats["空事件"].post_count == 0
    assert feats["事件0"].post_count == 5
    labels = spark.createDataFrame([(k, "r", v) for k, v in levels.items()], "event string, reason string, severity string")
    model, preds, metrics, split = flows.train_and_evaluate(corpus, labels, pooling="mean", max_iter=30)
    m = metrics.first()
    assert 0.0 <= m.accuracy <= 1.0
    assert preds.count() == split.where(F.col("part") == "val").count()
    requested = spark.createDataFrame([("事件1",), ("不存在",)], "event string")
    events, posts, status = flows.predict_events(spark, model, corpus, requested)
    st = {r.event: r for r in status.collect()}
    assert st["不存在"].error is not None and st["事件1"].error is None
    ev = {r.event_name: r for r in events.collect()}
    assert abs(sum(ev["事件1"].probabilities.values()) - 1) < 1e-9
    assert posts.where(F.col("event") == "事件1").count() == 6
    out = str(tmp_path / "results")
    IO.write_event_results(events, out)
    assert IO.read_event_results(spark, out).count() == 25


@pytest.mark.parametrize("pooling", ["max", "cls", "attentive"])
def test_event_vectors_poolings(spark, corpus_root, pooling):
    root, _ = corpus_root
    corpus = flows.prepare_corpus(spark, root, default_year=2024)
    vecs = flows.event_vectors(corpus, pooling)
    sizes = {r.n for r in vecs.select(F.size("features").alias("n")).collect()}
    assert sizes == {(1 << 12) + 12}


def test_custom_encoder_mapinpandas(spark, corpus_root):
    root, _ = corpus_root
    corpus = flows.prepare_corpus(spark, root, default_year=2024)

    def enc(texts):
        return [[float(len(t)), float(t.count("地"))] for t in texts]
    vecs = flows.event_vectors(corpus, "mean", encoder=enc, dim=2, add_topic=False)
    r = {x.event: x.features for x in vecs.collect()}
    assert len(r["事件0"]) == 14 and r["空事件"][:2] == [0.0, 0.0]
    with pytest.raises(ValueError):
        flows.event_vectors(corpus, "median")


def test_prepare_corpus_lands_posts_once(spark, corpus_root):
    from conftest import plan_of
    root, _ = corpus_root
    corpus = flows.prepare_corpus(spark, root, default_year=2024)
    plan = plan_of(corpus.posts)
    assert "parquet" in plan.lower() and "csv" not in plan.lower()
    feats = plan_of(corpus.features).lower()
    # statistics read the landed table; only the file listing touches the roots
    assert "csv" not in feats.replace("*.csv", "")
    assert corpus.posts.where(F.col("event") == "事件0").count() == 5


def test_predict_reports_file_without_text_column(spark, corpus_root, tmp_path):
    import shutil
    root, levels = corpus_root
    mixed = str(tmp_path / "mixed")
    shutil.copytree(root, mixed)
    os.makedirs(f"{mixed}/无正文")
    with open(f"{mixed}/无正文/无正文.csv", "w", encoding="utf-8") as f:
        f.write("id,用户昵称,发布时间\n1,u1,2025-01-01 08:00\n")
    corpus = flows.prepare_corpus(spark, mixed, default_year=2024)
    labels = spark.createDataFrame([(k, "r", v) for k, v in levels.items()], "event string, reason string, severity string")
    model, _, _, _ = flows.train_and_evaluate(corpus, labels, pooling="mean", max_iter=10)
    events, posts, status = flows.predict_events(spark, model, corpus)
    st = {r.event: r for r in status.collect()}
    assert st["无正文"].error == "no text column" and st["无正文"].predicted_class is None
    assert st["事件1"].error is None
    assert "无正文" not in {r.event_name for r in events.collect()}
    assert posts.where(F.col("event") == "无正文").count() == 0


def test_given_split_with_missing_event_file_raises(spark, corpus_root):
    root, levels = corpus_root
    corpus = flows.prepare_corpus(spark, root, default_year=2024)
    labels = spark.createDataFrame([(k, "r", v) for k, v in levels.items()], "event string, reason string, severity string")
    split = spark.createDataFrame([("事件0", "train"), ("事件1", "val"), ("没有文件", "train")], "event string, part string")
    with pytest.raises(FileNotFoundError):
        flows.train_and_evaluate(corpus, labels, split=split, max_iter=5)


def test_cache_run_parses_only_new_event_files(spark, corpus_root, tmp_path, monkeypatch):
    import shutil
    root, _ = corpus_root
    mine = str(tmp_path / "grow")
    shutil.copytree(root, mine)
    cache = str(tmp_path / "cache")
    first = flows.prepare_corpus(spark, mine, default_year=2024, cache_path=cache)
    n_first = first.posts.count()
    os.makedirs(f"{mine}/新事件")
    with open(f"{mine}/新事件/新事件.csv", "w", encoding="utf-8") as f:
        f.write("id,用户昵称,微博正文,发布时间\n1,u1,新的帖子,2025-01-03 08:00\n")
    seen = []
    real = IO.ingest

    def spy(spark_, files, *a, **k):
        seen.append(sorted(r.event for r in files.select("event").collect()))
        return real(spark_, files, *a, **k)
    monkeypatch.setattr(IO, "ingest", spy)
    second = flows.prepare_corpus(spark, mine, default_year=2024, cache_path=cache)
    assert seen == [["新事件"]]                     # cached events' CSVs are not parsed again
    assert second.posts.count() == n_first + 1     # every post once
    feats = {r.event: r.post_count for r in second.features.collect()}
    assert feats["新事件"] == 1 and feats["事件0"] == 5 and len(feats) == 26


def test_topic_and_statistics_switches(spark, corpus_root):
    root, _ = corpus_root
    corpus = flows.prepare_corpus(spark, root, default_year=2024)

    def enc(texts):
        return [[float(len(t)), float(t.startswith("Topic: "))] for t in texts]
    vecs = {r.event: r.features for r in flows.event_vectors(corpus, "cls", encoder=enc, dim=2, use_stats=False).collect()}
    # cls pooling takes the topic sentence, also of an event without posts
    assert vecs["事件0"] == [len("Topic: 事件0"), 1.0] and vecs["空事件"] == [len("Topic: 空事件"), 1.0]
    plain = {r.event: r.features for r in flows.event_vectors(corpus, "cls", encoder=enc, dim=2, use_stats=False, add_topic=False).collect()}
    assert plain["事件0"][1] == 0.0 and plain["空事件"] == [0.0, 0.0]


def test_post_drop_and_encoder_factory(spark, corpus_root):
    root, _ = corpus_root
    corpus = flows.prepare_corpus(spark, root, default_year=2024)

    def factory():
        return lambda texts: [[1.0] for _ in texts]
    full = flows.event_vectors(corpus, "mean", encoder_factory=factory, dim=1, use_stats=False, add_topic=False)
    assert {round(r.features[0], 6) for r in full.collect()} == {0.0, 1.0}
    a, b = (flows.event_vectors(corpus, "attentive", dim=1, encoder_factory=lambda: lambda ts: [[float(len(t))] for t in ts],
                                use_stats=False, add_topic=False, drop_p=p).collect() for p in (0.0, 0.9))
    assert {r.event for r in a} == {r.event for r in b} and all(r.features[0] > 0 for r in b if r.event != "空事件")


def test_report_has_both_parts(spark, corpus_root):
    root, levels = corpus_root
    corpus = flows.prepare_corpus(spark, root, default_year=2024)
    labels = spark.createDataFrame([(k, "r", v) for k, v in levels.items()], "event string, reason string, severity string")
    _, _, report, _ = flows.train_and_evaluate(corpus, labels, max_iter=20, drop_p=0.3)
    got = {r.part: r for r in report.collect()}
    assert set(got) == {"train", "val"} and all(r.loss >= 0 and 0 <= r.weighted_f1 <= 1 for r in got.values())
