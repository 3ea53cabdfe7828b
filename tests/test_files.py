"""S1-S12 on small files written by the test into a fresh temporary folder."""

import json
import struct
import zlib
import os

import pytest
from pyspark.sql import functions as F

from tremor.operators import features as A
from tremor.operators import profile as PR
from tremor.operators import scoring as E
from tremor.sources import files as IO

from conftest import rows

HEAD1 = "id,用户昵称,微博正文,发布位置,转发数,评论数,点赞数,发布时间"
HEAD2 = "发布时间,微博正文,id,点赞数,转发数,评论数,用户昵称"   # other order, no location


def write(path, text, bom=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(("﻿" if bom else "") + text)


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    base = tmp_path_factory.mktemp("roots")
    r1, r2 = str(base / "r1"), str(base / "r2")
    write(f"{r1}/ev1/ev1.csv", HEAD1 + "\n"
          '1,u1,"多行\n文本 ""引号""",北京,1,2,3,2025-01-01 08:00:00\n'
          "2,NA,第二条,,0,0,0,05-02 23:10\n"
          "3,u2,,上海,x,1,1,garbage\n", bom=True)
    write(f"{r1}/ev2/ev2.csv", HEAD2 + "\n2025/1/1 8:5:3,hello,9,5,1,1,u9\n")
    write(f"{r1}/ev3/ev3.csv", HEAD1 + "\n")
    write(f"{r1}/ev4/ev4.csv", "")
    write(f"{r1}/a b.c/a b.c.csv", HEAD1 + "\n7,u,t,l,1,1,1,2025-01-01 00:00\n")
    write(f"{r2}/ev1/ev1.csv", HEAD1 + "\n99,zz,from root2,x,1,1,1,2025-01-01 00:00\n")
    write(f"{r2}/ev5/ev5.csv", HEAD1 + "\n5,u5,only in r2,广州,1,1,1,2025-01-01 00:00\n")
    img = f"{r1}/ev1/images"
    os.makedirs(img)
    # whole containers: the manifest walks them to their end
    jpeg = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00abc\xff\xd9"
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b""))
    for name, data in [("1.jpg", jpeg), ("1.png", png), ("2.jpg", b""), ("2.png", png), ("3.jpeg", b"notanimage")]:
        with open(f"{img}/{name}", "wb") as f:
            f.write(data)
    return r1, r2


def test_read_posts_multi_root(spark, roots):
    posts = IO.read_posts(spark, list(roots))
    got = {(r.event, r.pos): r for r in posts.collect()}
    assert ("ev1", 0) in got and got[("ev1", 0)].root_rank == 0
    assert not any(r.text == "from root2" for r in got.values())
    assert got[("ev5", 0)].root_rank == 1
    assert got[("ev1", 0)].text == '多行\n文本 "引号"'
    assert got[("ev1", 0)].id == "1"                                 # BOM stripped from the first header
    assert got[("ev1", 1)].nickname is None and got[("ev1", 1)].location is None   # NA and empty -> missing
    assert got[("ev1", 2)].text is None
    ev2 = got[("ev2", 0)]
    assert (ev2.text, ev2.id, ev2.likes, ev2.has_location, ev2.has_counts) == ("hello", "9", "5", False, True)
    assert got[("a b.c", 0)].text == "t"                             # space and dot in the event name
    assert not any(k[0] in ("ev3", "ev4") for k in got)


def test_catalogue_and_empty_events(spark, roots):
    cat = IO.catalogue(spark, roots[0])
    assert sorted(r.event for r in cat.collect()) == ["a b.c", "ev1", "ev2", "ev3"]   # ev4 is zero bytes
    posts = IO.read_posts(spark, roots[0])
    f = {r.event: r for r in A.event_features(posts, 2024, catalogue=cat).collect()}
    assert f["ev3"].post_count == 0 and f["ev3"].timespan_hours == 0.0
    assert f["ev2"].location_diversity == 0.0 and f["ev2"].top_location == "未知"
    assert f["ev1"].post_count == 3 and f["ev1"].unique_users == 2


def test_labels_and_split_json(spark, tmp_path):
    lab = tmp_path / "labels.json"
    lab.write_text(json.dumps([{"topic": "a", "reason": "r", "severity": "轻微"},
                               {"topic": "b", "reason": "r", "severity": "中等"},
                               {"topic": "a", "reason": "r2", "severity": "严重"}], ensure_ascii=False), encoding="utf-8")
    got = IO.read_labels(spark, str(lab)).orderBy("position").collect()
    assert [(r.event, r.severity) for r in got] == [("a", "轻微"), ("b", "中等"), ("a", "严重")]
    from tremor.operators import labels as L
    assert rows(L.dedupe_labels(IO.read_labels(spark, str(lab))), "event", "severity") == [("a", "严重"), ("b", "中等")]
    sp = tmp_path / "split.json"
    sp.write_text(json.dumps({"train_topics": ["a", "c d"], "val_topics": ["b"]}), encoding="utf-8")
    split = IO.read_split(spark, str(sp))
    assert rows(split) == [("a", "train"), ("b", "val"), ("c d", "train")]
    out = str(tmp_path / "split_out")
    IO.write_split(split, out)
    assert rows(spark.read.json(out), "event", "part") == rows(split)
    obj = str(tmp_path / "split_obj")
    IO.write_split_object(split, obj)
    back = spark.read.json(obj).first()
    assert back.train_topics == ["a", "c d"] and back.val_topics == ["b"]


def test_result_sinks(spark, tmp_path):
    ev = spark.createDataFrame([("e1", [0.1, 2.0, 0.3])], "event string, logits array<double>")
    scored = E.score_events(ev)
    out = str(tmp_path / "events")
    IO.write_event_results(scored, out)
    r = IO.read_event_results(spark, out).first()
    assert (r.event_name, r.predicted_class, r.predicted_label) == ("e1", 1, "中等")
    assert abs(sum(r.probabilities.values()) - 1) < 1e-12
    posts = spark.createDataFrame([("e1", 0, "", "hi"), ("e1", 1, "5", "  ")], "event string, pos long, id string, text string")
    res = E.post_results(posts, scored)
    assert rows(res, "id", "text", "predicted_class") == [("0", "hi", 1)]
    csv_out = str(tmp_path / "posts")
    IO.write_post_results(res.where("false"), csv_out)
    text = "".join(open(os.path.join(csv_out, f), encoding="utf-8").read() for f in os.listdir(csv_out) if f.endswith(".csv"))
    assert text.strip() == "id,text,predicted_class,predicted_label"


def test_image_manifest_pick(spark, roots):
    man = IO.image_manifest(spark, roots[0], verify=True)
    pick = {r.id: r.ext for r in PR.pick_images(man).collect()}
    assert pick == {"1": "jpg", "2": "png"}     # 2.jpg empty -> png; 3.jpeg unreadable -> none
    posts = spark.createDataFrame([("ev1", 0, "1", "a"), ("ev1", 1, "3", "b"), ("ev1", 2, "2", " ")],
                                  "event string, pos long, id string, text string")
    mix = PR.modality_mix(PR.attach_images(posts, PR.pick_images(man))).first()
    assert (mix.multimodal, mix.text_only, mix.none) == (1, 1, 1)


def test_modality_of_a_prepared_corpus(spark, roots):
    from tremor.plans import flows
    corpus = flows.prepare_corpus(spark, roots[0], default_year=2024, images=True)
    mix = {r.event: (r.multimodal, r.text_only, r.none) for r in corpus.modality().collect()}
    assert mix["ev1"] == (2, 0, 1) and mix["ev2"] == (0, 1, 0)


def test_cleaned_cache(spark, roots, tmp_path):
    cache = str(tmp_path / "cache")
    posts = IO.read_posts(spark, roots[0]).select("event", "pos", "text")
    first = IO.cleaned_cache(spark, posts.where(F.col("event") == "ev1"), cache)
    assert first.count() == 3
    both = IO.cleaned_cache(spark, posts, cache)
    assert both.count() == 5
    assert IO.read_cache(spark, cache).count() == 5             # ev1 was not cleaned twice
    assert rows(IO.cached_events(spark, cache), "event") == sorted((e,) for e in ("ev1", "ev2", "a b.c"))


def test_cache_with_header_only_event(spark, roots, tmp_path):
    cache = str(tmp_path / "cache")
    cat = IO.event_files(spark, roots[0]).where(F.col("event") == "ev3")
    first = IO.cleaned_cache(spark, IO.read_posts_of(spark, cat), cache, requested=cat)
    assert first.count() == 0 and "clean_text" in first.columns
    assert rows(IO.cached_events(spark, cache), "event") == [("ev3",)]


def test_unfinished_cache_run_is_not_read(spark, roots, tmp_path):
    cache = str(tmp_path / "cache")
    posts = IO.read_posts(spark, roots[0]).select("event", "pos", "text")
    IO.cleaned_cache(spark, posts.where(F.col("event") == "ev1"), cache)
    # posts of a run that died before it entered its events
    IO.write_cache_run(posts.withColumn("clean_text", F.lit("x")), posts, cache, "dead")
    import shutil
    shutil.rmtree(f"{cache}/events/run=dead")
    assert IO.cleaned_cache(spark, posts, cache).count() == 5


def test_two_roots_wide_headers_and_stray_files(spark, tmp_path):
    a, b = str(tmp_path / "A"), str(tmp_path / "B")
    wide = ",".join(["id"] + [f'"x,{i}"' for i in range(60)] + ["微博正文"])
    write(f"{a}/ev1/ev1.csv", HEAD1 + "\n")                       # header-only: still the event's file
    write(f"{b}/ev1/ev1.csv", HEAD1 + "\n99,zz,from B,x,1,1,1,2025-01-01 00:00\n")
    write(f"{b}/ev2/ev2.csv", wide + "\n1," + ",".join(["z"] * 60) + ",wide text\n")
    write(f"{b}/ev2/ev3.csv", HEAD1 + "\n5,u,stray,x,1,1,1,2025-01-01 00:00\n")
    write(f"{b}/ev3/ev3.csv", HEAD1 + "\n6,u,own,x,1,1,1,2025-01-01 00:00\n")
    write(f"{b}/ev3/ev3_post_results.csv", "id,text\n1,stray\n")
    posts = IO.read_posts(spark, [a, b])
    assert rows(posts, "event", "pos", "id", "text") == [("ev2", 0, "1", "wide text"), ("ev3", 0, "6", "own")]
    from tremor.plans import flows
    plain = flows.prepare_corpus(spark, [a, b], default_year=2024)
    listed = flows.prepare_corpus(spark, [a, b], default_year=2024, events=plain.catalogue.select("event"))
    cached = flows.prepare_corpus(spark, [a, b], default_year=2024, cache_path=str(tmp_path / "c"))
    again = flows.prepare_corpus(spark, [a, b], default_year=2024, cache_path=str(tmp_path / "c"))
    want = [("ev1", 0), ("ev2", 1), ("ev3", 1)]
    for corpus in (plain, listed, cached, again):
        assert rows(corpus.features, "event", "post_count") == want


def test_paths_reach_the_reader_in_batches(spark, roots, monkeypatch):
    monkeypatch.setattr(IO, "FILES_PER_READ", 2)
    many = rows(IO.read_posts(spark, list(roots)), "event", "pos", "text")
    monkeypatch.setattr(IO, "FILES_PER_READ", 1000)
    assert many == rows(IO.read_posts(spark, list(roots)), "event", "pos", "text")


def test_split_object_is_one_object_at_every_size(spark, tmp_path):
    split = spark.range(2500).select(F.concat(F.lit('e" \\ é'), F.col("id")).alias("event"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("part")).repartition(5)
    for n, part in enumerate((split, split.where("part = 'val'"), split.limit(0))):
        IO.write_split_object(part, str(tmp_path / f"o{n}"))
        (name,) = [f for f in os.listdir(tmp_path / f"o{n}") if f.startswith("part-")]
        with open(tmp_path / f"o{n}" / name, encoding="utf-8") as f:
            got = json.load(f)
        assert set(got) == {"train_topics", "val_topics"}
        assert sorted([(e, "train") for e in got["train_topics"]] + [(e, "val") for e in got["val_topics"]]) == rows(part, "event", "part")
    IO.write_split_object(split, str(tmp_path / "o"))
    assert rows(IO.read_split(spark, str(tmp_path / "o")), "event", "part") == rows(split, "event", "part")


def test_split_layouts_and_post_csv_whitespace(spark, tmp_path):
    split = spark.createDataFrame([("a", "train"), ("b", "val"), ("c d", "train")], "event string, part string")
    want = [("a", "train"), ("b", "val"), ("c d", "train")]
    IO.write_split(split, str(tmp_path / "lines"))
    IO.write_split_object(split, str(tmp_path / "obj"))
    os.makedirs(tmp_path / "pretty")
    with open(tmp_path / "pretty" / "split.json", "w", encoding="utf-8") as f:
        json.dump({"train_topics": ["a", "c d"], "val_topics": ["b"]}, f, indent=2, ensure_ascii=False)
    for layout in ("lines", "obj", "pretty"):
        assert rows(IO.read_split(spark, str(tmp_path / layout)), "event", "part") == want, layout
    res = spark.createDataFrame([("e1", "1", "  lead and trail  ", 1, "中等"), ("e1", "2", 'quote " and\nnewline', 2, "严重")],
                                "event string, id string, text string, predicted_class int, predicted_label string")
    IO.write_post_results(res, str(tmp_path / "csv"), partition_by_event=True)
    back = IO.read_post_results(spark, str(tmp_path / "csv"), partitioned_by_event=True)
    assert rows(back, "event", "id", "text") == [("e1", "1", "  lead and trail  "), ("e1", "2", 'quote " and\nnewline')]


AWKWARD = ["a b", "百分%号", "pct%20lit", "plus+x", "事件1.5"]


def test_awkward_event_names_in_both_layouts(spark, tmp_path):
    root = tmp_path / "ref"
    for name in AWKWARD:
        os.makedirs(root / name / "images")
        with open(root / name / f"{name}.csv", "w", encoding="utf-8") as f:
            f.write(f"id,微博正文\n{name}1,hello {name}\n")
        with open(root / name / "images" / f"{name}1.png", "wb") as f:
            f.write(b"\x89PNG\r\n\x1a\n")
    assert rows(IO.catalogue(spark, str(root)), "event") == sorted((n,) for n in AWKWARD)
    posts = IO.read_posts(spark, str(root))
    assert rows(posts, "event", "id") == sorted((n, n + "1") for n in AWKWARD)
    assert rows(IO.image_manifest(spark, str(root)), "event", "id") == sorted((n, n + "1") for n in AWKWARD)
    # Spark-written key=value folders (their own %XX escaping)
    spark_root = str(tmp_path / "spark")
    df = spark.createDataFrame([(n, n + "1", "t " + n) for n in AWKWARD], "event string, id string, `微博正文` string")
    IO.write_event_csvs(df, spark_root)
    pattern = r"event=([^/]+)/[^/]+$"
    assert rows(IO.catalogue(spark, spark_root, event_pattern=pattern).select("event").distinct(), "event") == \
        sorted((n,) for n in AWKWARD)
    assert rows(IO.read_posts(spark, spark_root, event_pattern=pattern), "event", "id") == \
        sorted((n, n + "1") for n in AWKWARD)


def test_read_posts_of_keeps_root_rank(spark, roots):
    cat = IO.event_files(spark, list(roots))
    posts = IO.read_posts_of(spark, cat)
    got = {(r.event, r.root_rank) for r in posts.select("event", "root_rank").distinct().collect()}
    assert ("ev5", 1) in got and ("ev1", 0) in got
    assert rows(posts, "event", "pos") == rows(IO.read_posts(spark, list(roots)), "event", "pos")
