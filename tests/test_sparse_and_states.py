"""Sparse vectors, encoder batches, the score network, numbered epochs and mergeable statistics."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import SF_SMALL, plan_of, rows
from tremor.operators import features as A
from tremor.operators import pooling as V
from tremor.operators import scoring as E
from tremor.operators import sparse as SP
from tremor.operators import windows as W
from tremor.sources import fixtures as FX

TEXTS = [("a", 0, "hello world"), ("a", 1, "héllo 漢字 😀😀"), ("a", 2, "x"), ("b", 0, " "), ("b", 1, None), ("c", 0, "aaaa"), ("c", 1, "bbbb\n"), ("c", 2, "ab" * 900)]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(TEXTS, "event string, pos long, text string").repartition(3)


def test_murmur_values():
    assert [SP.murmur3(x) for x in (b"", b"a", b"ab", b"abc", b"abcd", b"h e")] == [SP.murmur3(x, 42) for x in (b"", b"a", b"ab", b"abc", b"abcd", b"h e")]
    assert SP.murmur3(b"", 0) == 0 and SP.murmur3(b"hello", 0) == 0x248BFA47 and SP.murmur3(b"hello, world", 0) == 0x149BBB7F


def test_sparse_vectors_equal_the_dense_form(spark, posts):
    thin = {(r.event, r.pos): r.v for r in E.embed(posts).select("event", "pos", SP.dense("vec").alias("v")).collect()}
    full = {(r.event, r.pos): r.vec for r in E.embed(posts, sparse=False).collect()}
    assert set(thin) == set(full) == {(e, p) for e, p, t in TEXTS if t and t.strip()}
    for k, v in full.items():
        assert len(thin[k]) == E.EMBED_DIM and np.allclose(thin[k], v, atol=1e-12), k
    assert sum(thin[("a", 2)]) == 0.0  # one character has no bigram
    counts = {}
    for a, b in zip("hello world", "ello world", strict=False):
        at = SP.murmur3(f"{a} {b}".encode()) % E.EMBED_DIM
        counts[at] = counts.get(at, 0) + 1
    norm = math.sqrt(sum(c * c for c in counts.values()))
    assert all(abs(thin[("a", 0)][i] - c / norm) < 1e-12 for i, c in counts.items())


def vector_forms(spark):
    rnd = random.Random(2)
    data = []
    for n in range(60):
        v = [rnd.choice([0.0, 0.0, rnd.uniform(-2, 2)]) for _ in range(7)]
        data.append((f"e{n % 4}", n, v, n % 3 != 0 and n % 4 != 3, rnd.uniform(-1, 1)))
    arrays = spark.createDataFrame(data, "event string, pos long, vec array<double>, valid boolean, score double").repartition(3)
    structs = spark.createDataFrame([(e, p, (7, [i for i, x in enumerate(v) if x], [x for x in v if x]), ok, s) for e, p, v, ok, s in data],
                                    f"event string, pos long, vec {SP.SPARSE}, valid boolean, score double")
    vectors = spark.createDataFrame([(e, p, Vectors.sparse(7, [(i, x) for i, x in enumerate(v) if x]) if p % 2 else Vectors.dense(v), ok, s) for e, p, v, ok, s in data],
                                    ["event", "pos", "vec", "valid", "score"])
    return arrays, structs, vectors


@pytest.mark.parametrize("pool", [V.mean_pool, V.max_pool, V.cls_pool, V.attentive_pool, lambda p: V.max_pool(p, compat_inf=True)])
def test_pools_of_sparse_and_ml_vectors(spark, pool):
    arrays, *others = vector_forms(spark)
    want = {r.event: r.vec for r in pool(arrays).collect()}
    for form in others:
        got = {r.event: r.vec for r in pool(form).collect()}
        assert set(got) == set(want)
        for e, v in want.items():
            assert (got[e] is None) == (v is None) and (v is None or np.allclose(got[e], v, atol=1e-12)), e


def test_encoder_batches():
    lengths = [5, 700, 3, 3, 9000, 1, 40] + [2] * 1200
    batches = E.encode_batches(lengths, 512, 1000)
    assert sorted(p for b in batches for p in b) == list(range(len(lengths)))
    assert all(len(b) <= 512 and (len(b) == 1 or sum(lengths[p] for p in b) <= 1000) for b in batches)
    assert [4] in batches
    assert [len(b) for b in E.encode_batches([1] * 1100, 512)] == [512, 512, 76]


def test_encoder_sees_bounded_batches_and_rows_keep_their_places(spark):
    texts = [f"t{n} " + "y" * (n % 17) for n in range(1300)] + ["z" * 5000, " ", None]
    posts = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id long, text string").coalesce(1)

    def encode(said):
        assert 0 < len(said) <= 512 and (len(said) == 1 or sum(map(len, said)) <= 2000)
        return [[float(len(t)), float(len(said))] for t in said]
    got = {r.id: r.vec for r in E.embed(posts, encoder=encode, dim=2, batch_chars=2000).collect()}
    assert {n: v[0] for n, v in got.items()} == {n: float(len(t)) for n, t in enumerate(texts) if t and t.strip()}
    assert got[1300] == [5000.0, 1.0]


@pytest.mark.parametrize("max_bytes", [64 << 20, 200])
def test_score_network(spark, max_bytes):
    rnd = np.random.default_rng(3)
    w, b, v = rnd.normal(size=(11, 7)), rnd.normal(size=11), rnd.normal(size=11)
    weights = spark.createDataFrame([(n, w[n].tolist(), float(b[n]), float(v[n])) for n in range(11)], "unit int, w array<double>, b double, v double")
    for form in vector_forms(spark):
        arrays = {r.pos: r.vec for r in vector_forms(spark)[0].collect()}
        got = {r.pos: r.score for r in V.attention_score(form, weights, max_bytes=max_bytes).collect()}
        assert all(abs(got[p] - np.tanh(w @ x + b) @ v) < 1e-9 for p, x in arrays.items())
    null = spark.createDataFrame([(1, None), (2, [0.0] * 7)], "pos long, vec array<double>")
    got = {r.pos: r.score for r in V.attention_score(null, weights, max_bytes=max_bytes).collect()}
    assert got[1] is None and abs(got[2] - np.tanh(b) @ v) < 1e-9
    assert [r.score for r in V.attention_score(null, weights.limit(0)).orderBy("pos").collect()] == [None, 0.0]


def test_numbers_without_a_single_task(spark, tmp_path):
    events = spark.range(1000).select(F.concat(F.lit("e"), F.col("id")).alias("event"), (F.col("id") % 5).alias("x")).repartition(7)
    made = W.epoch_batches(events, 9, 3, size=4, partitions=6)
    assert "SinglePartition" not in plan_of(made) and "CartesianProduct" not in plan_of(made)
    key = {r.event: r.k for r in events.select("event", W.shuffle_key(9, 3).alias("k")).collect()}
    want = {e: n for n, e in enumerate(sorted(key, key=lambda e: (key[e], e)))}
    assert {r.event: (r.number, r.batch) for r in made.collect()} == {e: (n, n // 4) for e, n in want.items()}
    W.write_epoch(made, str(tmp_path / "epoch"), partitions=3)
    lines = []
    for name in sorted(p for p in (tmp_path / "epoch").iterdir() if p.name.startswith("part-")):
        lines += re.findall(r'"event":"(e\d+)"', name.read_text())
    assert lines == sorted(want, key=want.get)
    assert W.epoch_batches(events.limit(0), 1, 1).collect() == []
    assert sorted(r.number for r in W.numbered(events, ["event"], partitions=50).collect()) == list(range(1000))


def test_states_merge_to_the_exact_statistics(spark):
    m = FX.fx_meta(spark, SF_SMALL)
    exact = {r.event: r.asDict() for r in A.event_features(m, default_year=2024).collect()}
    parts = [A.feature_state(m.where(F.pmod(F.xxhash64("pos"), F.lit(3)) == n), 2024) for n in range(3)]
    for state in (A.merge_states(*parts), A.merge_states(A.merge_states(parts[2], parts[0]), parts[1]), A.feature_state(m, 2024)):
        got = {r.event: r.asDict() for r in A.features_of_state(state).collect()}
        assert set(got) == set(exact)
        for event, want in exact.items():
            for name, value in want.items():
                if name in ("unique_users", "user_post_ratio"):
                    assert abs(got[event][name] - value) <= max(1, 5 * 1.04 / 64 * value)
                elif isinstance(value, float):
                    assert abs(got[event][name] - value) <= 1e-9 * max(1, abs(value)), (event, name)
                else:
                    assert got[event][name] == value, (event, name)
    lacking = m.drop("nickname", "location", "published_raw").withColumns({f"has_{c}": F.lit(False) for c in ("time", "nickname", "location")})
    a = {r.event: r.asDict() for r in A.features_of_state(A.feature_state(lacking, 2024)).collect()}
    assert a == {r.event: r.asDict() for r in A.event_features(lacking, default_year=2024).collect()}


def test_default_vectors_in_flows_are_sparse_up_to_the_pool(spark, posts):
    assert SP.is_sparse(E.embed(posts), "vec") and not SP.is_sparse(E.embed(posts, sparse=False), "vec")
    pooled = V.mean_pool(E.embed(posts).withColumn("valid", F.lit(True)))
    whole = V.mean_pool(E.embed(posts, sparse=False).withColumn("valid", F.lit(True)))
    a, b = ({r.event: r.vec for r in x.collect()} for x in (pooled, whole))
    assert set(a) == set(b) and all(np.allclose(a[e], b[e], atol=1e-12) for e in a)
    assert rows(pooled, "event", "n_valid") == [("a", 3), ("c", 3)]


def test_bigrams_of_parts_add_up(monkeypatch):
    """Long texts come in parts, short ones together; whatever the parts, the vectors are those of the whole."""
    import random
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abé中 \U0001F600") for _ in range(rnd.choice([1, 2, 3, 5, 20, 300]))) for _ in range(60)]
    whole = SP.bigram_rows(texts, 64, {})
    for chars, pairs in ((1, 0), (2, 3), (7, 10), (50, 1000), (10_000, 5)):
        monkeypatch.setattr(SP, "TOGETHER_CHARS", chars)
        monkeypatch.setattr(SP, "KNOWN_PAIRS", pairs)
        for a, b in zip(SP.bigram_rows(texts, 64, {}), whole, strict=True):
            assert (a == b).all()
    for parts, rows in SP.text_parts(texts, 50):
        assert sum(map(len, parts)) <= 51 and len(parts) == len(rows)


def test_bigram_memory_does_not_grow_with_the_batch():
    import tracemalloc
    peaks = []
    for count in (200, 2000):
        tracemalloc.start()
        SP.bigram_rows(["the words of a text " * 100] * count, 4096, {})
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] + 4_000_000  # 4 million characters: over 200 MB when taken at once


def test_batches_of_long_texts_are_cut_by_rows(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(SP, "TOGETHER_CHARS", 10)
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": ["abc", None, "x" * 30, "abcd", "efgh", "", "y" * 11]})
    cut = list(SP.pieces_of_batches(iter([batch, batch.slice(0, 0)]), 1))
    assert pa.Table.from_batches(cut).to_pydict() == batch.to_pydict()
    assert [b.num_rows for b in cut] == [2, 1, 3, 1]


def test_only_so_many_pairs_are_remembered(monkeypatch):
    monkeypatch.setattr(SP, "KNOWN_PAIRS", 20)
    monkeypatch.setattr(SP, "TOGETHER_CHARS", 10)
    known = {}
    SP.bigram_rows(["".join(map(chr, range(200, 1200)))], 64, known)
    assert len(known) <= 40


@pytest.mark.parametrize("pool", [V.mean_pool, V.max_pool, lambda p: V.max_pool(p, compat_inf=True)])
def test_posts_are_embedded_once_for_a_pool(spark, posts, pool):
    plan = plan_of(pool(E.embed(posts).withColumn("valid", F.lit(True))))
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_sparse_pools_of_odd_rows(spark):
    """Equal posts, posts without values or vector, invalid posts and an event that is null."""
    data = [("a", (4, [0, 2], [1.0, -2.0]), True)] * 2 + [("a", (4, [], []), True), ("a", (4, [1], [9.0]), False), ("a", (4, [1], [9.0]), None), ("a", None, True)]
    data += [("b", (4, [3], [5.0]), False), ("c", (4, [0, 1, 2, 3], [-1.0, -2.0, -3.0, 4.0]), True), ("d", (4, [], []), True), ("e", None, True), (None, (4, [1], [3.0]), True)]
    odd = spark.createDataFrame(data, f"event string, vec {SP.SPARSE}, valid boolean").repartition(5)
    zero = [0.0] * 4
    mean = {r.event: (r.n_valid, r.vec) for r in V.mean_pool(odd).collect()}
    assert {e: n for e, (n, _) in mean.items()} == {"a": 4, "b": 0, "c": 1, "d": 1, "e": 1, None: 1}
    assert mean["e"][1] is None and all(mean[e][1] == zero for e in ("b", "d", None))
    assert np.allclose(mean["a"][1], [0.5, 0.0, -1.0, 0.0]) and np.allclose(mean["c"][1], [-1.0, -2.0, -3.0, 4.0])
    top = {r.event: r.vec for r in V.max_pool(odd).collect()}
    assert top == {"a": [1.0, 0.0, 0.0, 0.0], "b": None, "c": [-1.0, -2.0, -3.0, 4.0], "d": zero, "e": None, None: zero}
    assert {r.event: r.vec for r in V.max_pool(odd, compat_inf=True).collect()}["b"] == [float("-inf")] * 4
