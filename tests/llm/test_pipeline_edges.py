"""The pipeline as a whole on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import types as T

import corpus_pipeline

CLASHES = ["key", "row", "text_hash", "_row_key0", "kept", "score", "bucket", "fingerprint", "component", "ids", "part", "tie", "sequence_id"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHES]])
ITEM = "the quick brown fox jumps over the lazy dog near the old river bank today"
PROSE = ("The committee met on Tuesday to discuss the new plan for the harbour. Several members said that the costs were higher than expected, "
         "and they asked the engineers for a second report. The mayor thanked everyone who came and promised an answer before the summer. ")


def prose(n):
    names = ["Anna", "Bernd", "Clara", "David", "Edith", "Franz", "Greta", "Heinz", "Irene", "Jakob", "Karin", "Ludwig"]
    things = ["bridge", "school", "market", "garden", "theatre", "station", "library", "museum", "hospital", "factory", "church"]
    return PROSE.replace("committee", f"{things[n % 11]} board").replace("The mayor", names[n % 12]) + \
        f"{names[n * 7 % 12]} wrote about the {things[n * 5 % 11]} and the {things[n * 3 % 11]}, which {names[n * 5 % 12]} had seen as a child in another town. " * 2


ROWS = [(n, prose(n), "ab"[n % 2]) for n in range(40)] + [
    (40, prose(3).replace("harbour", "Harbour"), "a"), (41, prose(5), "b"), (41, prose(5), "b"),  # a copy in other case, a copy twice under one key
    (42, prose(6) + ITEM + ". " + prose(8), None),                           # holds a benchmark window
    (43, None, "a"), (44, "", "b"), (45, " \n\t ", None), (None, prose(9) + "It was late.", "a"), (None, None, None),
    (46, (PROSE + "And so it went on for many years. ") * 400, "b"),
]


def put(spark, folder, rows, items):
    spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def stages(spark, folder):
    """(name, rows before, rows after) of each stage."""
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        stage(spark, before, str(folder)).write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
        yield name, before, frame


def test_odd_rows(spark, tmp_path):
    put(spark, tmp_path, ROWS, [("i1", ITEM), ("i1", ITEM), ("i2", None), (None, ""), ("i3", "short one")])
    kept = {}
    for name, before, after in stages(spark, tmp_path):
        if name == "packing":
            pieces = after.collect()
            continue
        assert after.columns == before.columns == SCHEMA.names
        known = {(r.doc_id, r.text, r.source) for r in before.collect()}
        rows = after.collect()
        assert all(tuple(r)[3:] == tuple(CLASHES) and (r.doc_id, r.text, r.source) in known for r in rows)
        kept[name] = [(r.doc_id, r.text) for r in rows]
    good = kept["quality_classifier"]
    assert {k for k, _ in good} >= set(range(42))  # clean prose stays
    exact = kept["exact_dedup"]
    folded = [(t or "").lower() for _, t in exact]
    assert len(set(folded)) == len(folded) and set(folded) == {(t or "").lower() for _, t in good}
    assert 40 in dict(exact) and 3 not in dict(exact) and [k for k, _ in exact].count(41) == 1
    near = kept["simhash_near_dedup"]
    assert set(near) <= set(exact) and near
    clean = kept["benchmark_decontamination"]
    assert sorted(map(str, clean)) == sorted(str(r) for r in near if ITEM not in (r[1] or ""))
    sizes, ends = {}, {}
    for p in pieces:
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.length
        ends[p.doc_id] = p.doc_tokens
        assert p.offset + p.length <= 4096
    assert sizes == ends and set(sizes) == {k for k, _ in clean}


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(7, None, "a"), (7, None, "a"), (8, "", None)]])
def test_hardly_any_rows(spark, tmp_path, rows):
    put(spark, tmp_path, rows, [])
    for name, before, after in stages(spark, tmp_path):
        assert name == "packing" or after.columns == before.columns == SCHEMA.names
        assert name == "packing" or after.count() <= before.count()
        if not rows:
            assert after.count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    put(spark, tmp_path, [], [("i1", ITEM)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
