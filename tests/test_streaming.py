"""Incremental cache stream: files landing between runs are cleaned exactly once."""

import os

from tremor.sources.files import read_cache
from tremor.streaming.cache_stream import start_cache_stream

HEAD = "id,用户昵称,微博正文,发布时间"


def land(root, name, lines):
    os.makedirs(f"{root}/{name}", exist_ok=True)
    with open(f"{root}/{name}/{name}.csv", "w", encoding="utf-8") as f:
        f.write("\n".join([HEAD] + lines) + "\n")


def test_cache_stream_incremental(spark, tmp_path):
    landing, cache, ckpt = str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "ckpt")
    land(landing, "甲", ['1,u1,"你好，世界！ #话题#",2025-01-01 08:00', "2,u2,转发微博,2025-01-01 09:00"])
    land(landing, "乙", ["1,u3,第二个事件,05-02 10:00"])
    q = start_cache_stream(spark, landing, cache, ckpt)
    q.awaitTermination(120)
    got = {(r.event, r.pos): r.clean_text for r in read_cache(spark, cache).collect()}
    assert got == {("甲", 0): "你好,世界! 话题", ("甲", 1): "", ("乙", 0): "第二个事件"}
    land(landing, "丙", ["9,u9,新的,2025-01-03 08:00"])
    q = start_cache_stream(spark, landing, cache, ckpt)
    q.awaitTermination(120)
    rows = read_cache(spark, cache).collect()
    assert len(rows) == 4 and sorted({r.event for r in rows}) == ["丙", "乙", "甲"]


def test_two_landings_share_a_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    for n in (1, 2, 2):  # the last run finds nothing new
        land(str(tmp_path / f"in{n}"), f"事件{n}", [f"{n},u,文{n},2025-01-01 08:00"])
        q = start_cache_stream(spark, str(tmp_path / f"in{n}"), cache)
        q.awaitTermination(120)
    assert sorted((r.event, r.id, r.clean_text) for r in read_cache(spark, cache).collect()) == [("事件1", "1", "文1"), ("事件2", "2", "文2")]
