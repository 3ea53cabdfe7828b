"""Files that cannot be read are errors of their own; image containers are walked to their end."""

import os
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tremor.functions import text as T
from tremor.plans import flows
from tremor.sources import files as IO
from tremor.sources.images import image_fault, png_bytes

HEAD = "id,微博正文,发布时间\n"


def put(root, event, data):
    os.makedirs(f"{root}/{event}", exist_ok=True)
    with open(f"{root}/{event}/{event}.csv", "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def root(tmp_path):
    root = str(tmp_path / "root")
    put(root, "好", HEAD + '1,"多行\n文本, ""引"" ",2025-01-01 08:00\n2,é ok,2025-01-02 08:00\n')
    put(root, "bom", "﻿" + HEAD + "1,文,2025-01-01 08:00\n")
    put(root, "stray", HEAD + '1,5" and 6" wide,2025-01-01 08:00\n2,a"b,x\n')
    put(root, "last stray", HEAD + '1,x,2025-01-01 08:00\n2,a"b,c')
    put(root, "gbk", HEAD.encode() + "1,微博,2025-01-01 08:00\n".encode("gbk"))
    put(root, "late byte", HEAD.encode() + b"1,ok,x\n" * 500 + b"2,\xff,x\n")
    put(root, "cut off", HEAD.encode() + "1,微博".encode()[:-1])
    put(root, "open", HEAD + '1,"never closed,2025\n2,y,z\n')
    put(root, "open last line", HEAD + '1,x,y\n2,"open')
    put(root, "closed twice", HEAD + '1,"a","b"\n2,"x,""","y"')
    put(root, "no text", "id,other\n1,x\n")
    put(root, "header only", HEAD)
    put(root, "wide", ",".join(["微博正文", *(f"c{i}" for i in range(60))]) + "\n" + ",".join(["宽"] + ["v"] * 60) + "\n")
    put(root, "full", ",".join(["微博正文", *(f"c{i}" for i in range(47))]) + "\n" + ",".join(['"open'] + ["v"] * 47) + "\n")
    return root


BAD = {"gbk": "not UTF-8", "late byte": "not UTF-8", "cut off": "not UTF-8", "open": "unclosed quote", "open last line": "unclosed quote", "full": "unclosed quote",
       "no text": "no text column", "gone": "file not found"}


def test_each_file_is_judged_on_its_own(spark, root):
    files = IO.event_files(spark, root).select("event", "path", "length", "root_rank")
    gone = spark.createDataFrame([("gone", f"file:{root}/gone/gone.csv", 5, 0)], files.schema)
    posts, errors = IO.ingest(spark, files.unionByName(gone))
    assert {r.event: r.error for r in errors.collect()} == BAD
    got = {}
    for r in posts.collect():
        got.setdefault(r.event, []).append((r.pos, r.text))
    assert sorted(got["好"]) == [(0, '多行\n文本, "引" '), (1, "é ok")]
    assert got["bom"] == [(0, "文")] and got["wide"] == [(0, "宽")]
    assert sorted(got["stray"]) == [(0, '5" and 6" wide'), (1, 'a"b')] and len(got["last stray"]) == 2 and len(got["closed twice"]) == 2
    assert set(got) == {"好", "bom", "stray", "last stray", "closed twice", "wide"}


def test_bad_files_in_the_flow(spark, root, tmp_path):
    for cache in (None, str(tmp_path / "cache"), str(tmp_path / "cache")):
        corpus = flows.prepare_corpus(spark, root, default_year=2024, cache_path=cache)
        assert {r.event: r.error for r in corpus.errors.collect()} == {k: v for k, v in BAD.items() if k != "gone"}
        assert sorted({r.event for r in corpus.posts.collect()}) == sorted(["好", "bom", "stray", "last stray", "closed twice", "wide"])


def test_open_quotes():
    for row, is_open in (('a,b', False), ('"a', True), ('"a"', False), ('"a""', True), ('"a"""', False), ('x"y', False), ('x","y', True), (',"', True), ('""', False),
                         ('"a"b,"c', True), ('"a\n1,"b', False), ("", False), ('a,"b","c\n', True), ('"x,""","y"', False)):
        assert IO.quote_is_open(row) is is_open, row


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, bits=8, colour=2, interlaced=0, lose=0):
    pixels = bytes(png_bytes(width, height, bits, colour, bool(interlaced)) - lose)
    packed = zlib.compress(pixels)
    half = len(packed) // 2
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlaced)) + chunk(b"tEXt", b"k\0v")
            + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b""))


def jpeg(body=b"picture\xff\x00bytes\xff\xd3more"):
    return (b"\xff\xd8\xff\xe0\x00\x05abc\xff\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + body
            + b"\xff\xc4\x00\x04xy\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + body + b"\xff\xd9")


def test_png_containers():
    whole = png(300, 500)
    assert image_fault(whole) == ("png", None) and image_fault(whole + b"trailing") == ("png", None)
    assert image_fault(png(9, 13, 1, 0, 1)) == ("png", None) and image_fault(png(7, 3, 16, 6)) == ("png", None)
    assert png_bytes(8, 8, 8, 0, False) == 72 and png_bytes(1, 1, 8, 0, True) == 2 and png_bytes(5, 5, 2, 3, False) == 15
    for n in (8, 20, 33, 60, len(whole) // 2, len(whole) - 12, len(whole) - 1):
        assert image_fault(whole[:n]) == ("png", "truncated"), n
    for n in (20, 50, len(whole) - 20):
        assert image_fault(whole[:n] + bytes([whole[n] ^ 1]) + whole[n + 1:])[1] in ("wrong checksum", "truncated"), n
    assert image_fault(png(30, 50, lose=1)) == ("png", "pixels missing")
    assert image_fault(whole[:8] + chunk(b"IEND", b"")) == ("png", "no header") and image_fault(png(0, 5)) == ("png", "no header")
    assert image_fault(whole[:33] + chunk(b"IDAT", b"no stream") + chunk(b"IEND", b"")) == ("png", "bad pixels")
    assert image_fault(png(4000, 4000, colour=0)) == ("png", None)


def test_jpeg_containers():
    whole = jpeg()
    assert image_fault(whole) == ("jpeg", None) and image_fault(whole + b"trailing") == ("jpeg", None)
    for n in range(2, len(whole)):
        assert image_fault(whole[:n])[1] is not None, n
    assert image_fault(b"\xff\xd8\xff\xd9") == ("jpeg", "no picture") and image_fault(b"\xff\xd8abc") == ("jpeg", "bad marker")
    assert image_fault(b"") == (None, "empty") and image_fault(None) == (None, "empty") and image_fault(b"GIF89a") == (None, "unknown format")


def test_manifest_falls_through_to_the_next_extension(spark, tmp_path):
    folder = tmp_path / "root" / "ev" / "images"
    os.makedirs(folder)
    for name, data in (("1.jpg", jpeg()[:-2]), ("1.png", png(3, 3)), ("2.jpg", jpeg()), ("2.png", png(3, 3)), ("3.jpeg", b""), ("3.png", png(3, 3)[:-3])):
        (folder / name).write_bytes(data)
    manifest = IO.image_manifest(spark, str(tmp_path / "root"), verify=True)
    assert rows(manifest, "id", "ext", "readable") == [("1", "jpg", False), ("1", "png", True), ("2", "jpg", True), ("2", "png", True), ("3", "png", False)]  # empty files are not listed
    from tremor.operators.profile import pick_images
    assert rows(pick_images(manifest), "id", "ext") == [("1", "png"), ("2", "jpg")]


def test_stream_reads_headers_wider_than_its_width(spark, tmp_path):
    from tremor.sources.files import read_cache
    from tremor.streaming.cache_stream import start_cache_stream
    put(str(tmp_path / "in"), "宽", ",".join([*(f"c{i}" for i in range(9)), "微博正文"]) + "\n" + ",".join(["v"] * 9 + ["文"]) + "\n")
    put(str(tmp_path / "in"), "a%20b +", HEAD + "1,窄,x\n")
    query = start_cache_stream(spark, str(tmp_path / "in"), str(tmp_path / "cache"), width=4)
    query.awaitTermination(120)
    assert query.exception() is None
    assert rows(read_cache(spark, str(tmp_path / "cache")), "event", "clean_text") == [("a%20b +", "窄"), ("宽", "文")]


def cleaning_seconds(spark, body):
    best = []
    df = spark.createDataFrame([(body,)], "text string").cache()
    df.count()
    for _ in range(3):
        began = time.perf_counter()
        df.select(T.dedupe_hashtags("text").alias("x")).write.format("noop").mode("overwrite").save()
        best.append(time.perf_counter() - began)
    return min(best)


def test_hashtags_grow_in_proportion(spark):
    bodies = [" ".join(f"#tag{i}# w" for i in range(n)) for n in (20_000, 80_000)]
    cleaning_seconds(spark, bodies[0])
    small, large = (cleaning_seconds(spark, b) for b in bodies)
    assert large < 8 * small + 0.5


def test_emails_and_guards_change_nothing(spark):
    """The rules with guards and run heads against the plain patterns, on random strings."""
    import re
    rnd = random.Random(6)
    parts = ["a", "b.c", "@", "x-y", ".", "d.org", "co", "+", " ", "\n", "://", "http://e.x/", "<b>", "L", "的微博视频", "[t](u)", "](", "回复@", ":", "转发微博", "，", "  ", "#", "#t#", "1"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["a@b.com.c@d.org", "a@b.com-x@d.org", "." * 2000 + "@", "a" * 5000]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, text string")
    got = {r.n: r for r in df.select("n", T.remove_emails("text").alias("e"), T.remove_video("text").alias("v"), T.clean_text("text").alias("c"),
                                     T.collapse_ws(T.halfwidth_punct(T.remove_forward(T.demojize(T.platform_clean(T.dedupe_hashtags(T.remove_video(T.remove_links("text")))))))).alias("steps")).collect()}
    for n, t in enumerate(texts):
        assert got[n].e == re.sub(r"[A-Za-z0-9_.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", "", t), t
        assert got[n].v == re.sub(r"L([^\n]+)的微博视频", "", t)
        assert got[n].c == got[n].steps, t
    assert df.select(F.lit(None).cast("string").alias("text")).select(T.clean_text("text")).first()[0] == ""
