"""Keyed access to token shards: a lookup reads the buckets asked and no others."""

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tremor.llm import mph, token_shards
from tremor.llm.common import scratch

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def hashes(n, seed):
    rnd = np.random.default_rng(seed)
    return rnd.integers(-2**63, 2**63, n), rnd.integers(-2**63, 2**63, n)


@pytest.mark.parametrize("n", [1, 2, 63, 4096, 9000])
def test_slots_are_minimal_and_perfect(n):
    a, b = hashes(n, n)
    sizes, words, ranks = mph.build(a, b)
    assert sorted(mph.slots(sizes, words, ranks, a, b).tolist()) == list(range(n))
    flags = np.unpackbits(words.view(np.uint8), bitorder="little")
    at = np.arange(len(flags))
    assert mph.rank(words, ranks, at).tolist() == (np.cumsum(flags) - flags).tolist()


class Counted:
    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, size, offset):
        self.read += size
        return self.data[offset:offset + size]


def test_one_key_reads_bits_and_one_record():
    a, b = hashes(4096, 7)
    values = np.arange(4096)
    block = token_shards.bucket_block(a, b, values, values * 10, values * 2)
    blocks = [block if n == 5 else b"" for n in range(token_shards.FILE_BUCKETS)]
    places = np.cumsum([8 * (token_shards.FILE_BUCKETS + 1), *map(len, blocks)]).astype("<i8")
    source = Counted(places.tobytes() + b"".join(blocks))
    index = token_shards.IndexFile(source)
    for n in (0, 17, 4095):
        before = source.read
        which, found = index.find(64 * 3 + 5, a[n:n + 1], b[n:n + 1])
        assert which.tolist() == [0] and found[["shard", "offset", "n_tokens"]].tolist() == [(n, n * 10, n * 2)]
        assert source.read - before < 4096
    which, found = index.find(5, a, b)
    assert which.tolist() == list(range(4096)) and found["shard"].tolist() == values.tolist()
    c, d = hashes(50, 8)
    assert not len(index.find(5, c, d)[0]) and not len(index.find(6, a[:3], b[:3])[0])


def test_three_keys_open_their_files_only(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "BUCKET_KEYS", 4)
    path = scratch(spark, "test")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("number "), F.col("id").cast("string")).alias("text"))
    token_shards.write_token_shards(spark, docs, path, tokenizer=BYTES, end_id=2)
    about = token_shards.descriptor(spark, path)
    assert (about.dtype, about.end_id, about.buckets) == ("<u2", 2, 750) and len(about.tokenizer_sha256) == 64
    assert token_shards.lookup(spark, path, docs).count() == 3000
    asked = spark.createDataFrame([(5,), (1700,), (2999,), (3000,)], "doc_id long")
    want = {(r.key, r.shard, r.offset, r.n_tokens) for r in token_shards.lookup(spark, path, asked).collect()}
    assert {k for k, *_ in want} == {5, 1700, 2999}
    # all files but those of the keys' buckets are spoilt: nobody may read them
    h1, _ = token_shards.key_hashes("doc_id")
    kept = {r[0] // token_shards.FILE_BUCKETS for r in asked.select(F.pmod(h1, F.lit(750))).collect()}
    fs, root = token_shards.open_folder(f"{path}/index")
    names = [f for f in fs.get_file_info(pa.fs.FileSelector(root)) if f.path.endswith(".idx")]
    assert len(names) == 12
    for f in names:
        if int(f.base_name[:8]) not in kept:
            with fs.open_output_stream(f.path) as out:
                out.write(b"spoilt")
    assert {(r.key, r.shard, r.offset, r.n_tokens) for r in token_shards.lookup(spark, path, asked).collect()} == want
    plan = token_shards.lookup(spark, path, asked)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan and "parquet" not in plan.lower()


def test_ids_have_the_written_type(spark):
    path = scratch(spark, "test")
    docs = spark.createDataFrame([(1, "one"), (1, "one"), (2, None)], "doc_id long, text string")
    token_shards.write_token_shards(spark, docs, path, tokenizer=BYTES, end_id=None)
    assert sorted((r.doc_id, r.n_tokens > 0) for r in token_shards.digests(spark, path, docs).collect()) == [(1, True), (1, True), (2, False)]
    with pytest.raises(ValueError):
        token_shards.digests(spark, path, docs, "<u4")
