"""Fill-in-middle, substring deduplication and ranked search against plain versions: odd texts, nulls,
empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random
import re

import numpy as np
import pytest

from llm import brute
from llm.test_edges import CLASHES, SCHEMA, TEXTS
from tremor.llm import fim, ranked_search, substrings
from tremor.llm.common import scratch


def rows_of(spark, texts, parts=3):
    return spark.createDataFrame([(k, t, None, *CLASHES) for k, t in texts], SCHEMA).repartition(parts)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, "" if x is None else x) for x in r))


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    parts = ["a", "Bc", " ", "\n", "é", "漢", "😀", "<P", "<S>", "<", ">", "P>", "12", "\x00", "İ", "\t", "word" * 9]
    return [(1000 + k, "".join(rnd.choice(parts[:7] + parts[8 if rnd.random() < 0.02 else 9:]) for _ in range(rnd.randint(0, 40)))) for k in range(n)]


ODD = odd_texts(300) + [(k, t) for k, t, _ in TEXTS] + [(-5, "<P>x"), (-6, "x<M>"), (-7, "<S"), (-8, "ab" * 5000), (-9, "漢" * 3000)]


@pytest.mark.parametrize("frame_bytes", [1, 2, 5, 64, fim.FRAME_BYTES])
def test_fill_in_middle(spark, frame_bytes):
    docs = rows_of(spark, ODD)
    frames = fim.write_frames(spark, docs, f"{scratch(spark, 'fim-test')}/frames", frame_bytes=frame_bytes)
    want = brute.fill_in_middle(ODD)
    made = [tuple(r) for r in fim.outputs(frames).collect()]
    assert ordered(made) == ordered(want)
    text_of = dict(ODD)
    for key, _, form, _, _, output in made:
        assert fim.restore(output, form) == (text_of[key] or "")
    found = [tuple(r) for r in fim.digests(frames).collect()]
    assert ordered(found) == ordered([(*r[:5], brute.sha(r[5]), brute.sha(text_of[r[0]] or "")) for r in want])
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_fill_in_middle_opens_only_cut_frames(spark):
    text = "one two three " * 4000
    frames = fim.write_frames(spark, rows_of(spark, [(1, text)], 1), f"{scratch(spark, 'fim-test')}/frames", frame_bytes=1000).collect()[0]
    opened = []

    class Count:
        def decompress(self, data):
            opened.append(len(data))
            return fim.zstandard.ZstdDecompressor().decompress(data)

    whole = fim.Text(frames.ends, frames.units, frames.chars, frames.bytes, frames.inside, frames.payload, Count())
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert whole.cut(12_345) == (len("".join(units[:12_345])),) * 2
    assert len(opened) == 1 and len(frames.ends) == -(-len(text) // 1000)


def repeating_texts():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["ab", "c", "été", "漢", "x\x00y", "D,", "e.", "\x1ff"]) + rnd.choice(["", "1", "2", "3", "4"])
    passage = [word() for _ in range(60)]
    line = [word() for _ in range(30)]
    texts = []
    for k in range(120):
        own = [word() for _ in range(rnd.randint(0, 80))]
        at = rnd.randint(0, len(own))
        if k % 3 == 0:  # the passage, whole or in part
            own[at:at] = passage[rnd.randint(0, 20):rnd.randint(36, 60)]
        elif k % 3 == 1:  # a line too short for a window, which longer repeats may hold
            own[at:at] = line + (["same"] * 5 if k % 2 else [])
        texts.append((k, rnd.choice([" ", "\n", " \t "]).join(own)))
    texts += [(200, " ".join(["same"] * 300)), (201, " ".join("abc"[n % 3] for n in range(200))), (202, " ".join(passage[:34])), (203, " ".join(passage[:35])),
              (204, " ".join(["one", "two"] * 2000)), (None, " ".join(line * 3)), (205, texts[0][1]), (205, texts[0][1]), (206, None), (207, ""), (208, " \n ")]
    return texts


REPEATING = repeating_texts()


@pytest.mark.parametrize("group_rows, bin_rows", [(substrings.GROUP_ROWS, substrings.BIN_ROWS), (10, 40), (1, 7)])
def test_substrings(spark, group_rows, bin_rows):
    texts = REPEATING + [(k, t) for k, t, _ in TEXTS]
    found = substrings.find_repeats(spark, rows_of(spark, texts), group_rows=group_rows, bin_rows=bin_rows).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = brute.substrings(texts)
    assert ordered([tuple(r) for r in found]) == ordered([(*r[:3], brute.sha(r[3])) for r in want])
    assert sum(0 < r[2] < r[1] for r in want) > 20


def test_substrings_at_other_widths(spark):
    for width in (12, 13, 20, 50):
        found = substrings.find_repeats(spark, rows_of(spark, REPEATING), width=width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert ordered([tuple(r) for r in found]) == ordered([(*r[:3], brute.sha(r[3])) for r in brute.substrings(REPEATING, width)])
    with pytest.raises(ValueError):
        substrings.find_repeats(spark, rows_of(spark, REPEATING), width=11)


def test_substrings_removed_from_texts(spark):
    docs = rows_of(spark, REPEATING)
    left = substrings.remove_repeats(spark, docs)
    assert left.columns == docs.columns
    want = [(r[0], t if not r[2] else r[3]) for r, (_, t) in zip(brute.substrings(REPEATING), REPEATING, strict=True)]
    assert ordered([(r.doc_id, r.text) for r in left.collect()]) == ordered(want)


def test_anchors_are_alike_in_equal_windows():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 5, 4000).astype(np.uint64)
    hashes = substrings.mixed(words + np.uint64(1))
    at, low, high = substrings.anchors(hashes, np.array([0, 1500]), np.array([1500, 2500]), 35, 24, 8)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)])
    assert covered.tolist() == [*range(0, 1466), *range(1500, 3966)]
    grams = substrings.gram_hashes(hashes, 8)
    for a, b, c in zip(at, low, high, strict=True):
        for s in (b, c):
            assert a == s + int(np.argmin(grams[s:s + 24]))


def test_ranked_search(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "of", "Été", "漢字", "a1", "x"] + [f"w{n}" for n in range(60)])
    texts = [(k, " ".join(word() for _ in range(rnd.randint(0, 60)))) for k in range(400)]
    texts += [(k, "same tie text") for k in range(900, 930)] + [(1, "same tie text"), (None, "same tie text rare"), (None, "rare"), (950, None), (951, ""), (952, "!!"),
                                                               (953, "the " * 30_000)]
    items = [(k, " ".join(word() for _ in range(rnd.randint(1, 30)))) for k in range(30)]
    items += [(40, "tie"), (41, "TIE tie"), (42, "rare"), (43, "absent"), (44, None), (45, ""), (None, "same"), (0, "rare the the"), (46, "... the, of!")]
    asked = spark.createDataFrame([(k, t, "x", "y") for k, t in items], "item_id long, text string, key string, item_row string")
    for parts in (1, 5):
        found = ranked_search.search(spark, rows_of(spark, texts, parts), asked).collect()
        assert ordered([tuple(r) for r in found]) == ordered(brute.ranked(texts, items))
    few = ranked_search.search(spark, rows_of(spark, texts), asked, k=3).collect()
    assert ordered([tuple(r) for r in few]) == ordered(brute.ranked(texts, items, 3))


def test_ranked_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 5)
    texts = [(k, f"alpha beta{k % 3} gamma{k % 7} delta{k}") for k in range(50)]
    items = [(k, f"alpha beta{k % 3} gamma{k} delta{k} delta{k + 1}") for k in range(9)]
    found = ranked_search.search(spark, rows_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert ordered([tuple(r) for r in found]) == ordered(brute.ranked(texts, items))


def test_ranked_search_stops_early():
    """Lists are not read to their ends once nothing unseen can reach the k-th score."""
    import pyarrow as pa
    texts = [f"common {'top ' * 9 if n < 20 else ''}{'word ' * (n % 50 + 5)}" for n in range(2000)]
    terms, term, row, times, sizes = ranked_search.counted(pa.array(texts))
    raw, ends = ranked_search.text_bytes(terms)
    stored = {"term_ends": ends.astype(np.int32).tobytes(), "term_bytes": raw.tobytes(), "counts": np.bincount(term).astype(np.int32).tobytes(),
              "docs": row.astype(np.int32).tobytes(), "times": times.astype(np.int32).tobytes(), "sizes": sizes.astype(np.int32).tobytes()}
    lists = ranked_search.Lists(stored, pa.array(["common", "top"]), 2000, int(sizes.sum()))
    best = ranked_search.Best(10)
    met = []
    add = best.add
    best.add = lambda scores, docs, keys: (met.extend(docs.tolist()), add(scores, docs, keys))
    ranked_search.best_positions(lists, np.array([0, 1]), np.array([1, 5000]), best, pa.array(range(2000)))
    assert len(best.rows) == 10 and {k for _, k in best.rows} <= set(range(20)) and len(met) < 200


def test_string_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "the same words"), ("a", "the same words"), (None, None)], "doc_id string, text string")
    items = spark.createDataFrame([("q", "same")], "item_id string, text string")
    assert [tuple(r) for r in ranked_search.search(spark, docs, items).orderBy("rank").collect()][0][:3] == ("q", 1, "a")
    assert {r.doc_id for r in substrings.find_repeats(spark, docs).collect()} == {"a", "b", None}
    assert {r.doc_id for r in fim.fill_in_middle(spark, docs)[0].collect()} == {"a", "b", None}
    none = docs.limit(0)
    assert ranked_search.search(spark, none, items).collect() == [] and ranked_search.search(spark, docs, items.limit(0)).collect() == []
    assert substrings.find_repeats(spark, none).collect() == [] and substrings.remove_repeats(spark, none).collect() == []
    assert [d.collect() for d in fim.fill_in_middle(spark, none)] == [[], []]
