"""Every registered query of this subpackage against its plain version, over whole tables."""

import os
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF_MID
from llm import brute
from tremor.llm.queries import ORACLES, QUERIES

SF = SF_MID


def read(table, columns):
    path = f"{SF}/{table}.parquet" + ("/*.parquet" if os.path.isdir(f"{SF}/{table}.parquet") else "")
    return duckdb.sql(f"select {columns} from read_parquet('{path}')").fetchall()


@pytest.fixture(scope="module")
def docs():
    return read("documents", "doc_id, text")


def by_key(spark, name, *columns):
    rows = QUERIES[name](spark, SF).select(*columns).collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_token_shards(spark, docs):
    assert by_key(spark, "op1_token_shards", "doc_id", "start", "n_tokens", "ids_crc32") == brute.token_shards(docs)


def test_secret_scan(spark, docs):
    assert by_key(spark, "op2_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == brute.secrets(docs)


def test_decontaminate(spark, docs):
    found = by_key(spark, "op3_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == brute.contaminated(docs, read("benchmark", "item_id, text"))
    assert any(v[-1] for v in found.values())


def test_token_counts(spark, docs):
    total, start = defaultdict(int), defaultdict(int)
    for r in sorted(QUERIES["op4_token_counts"](spark, SF).collect(), key=lambda r: (r.doc_id, r.section)):
        assert r.start == start[r.doc_id]
        start[r.doc_id] += r.length
        total[r.doc_id] += r.n_tokens
    assert dict(total) == {k: n - 1 for k, (_, n, _) in brute.token_shards(docs).items()}
    assert dict(start) == {k: len(t or "") for k, t in docs}


def test_exact_dedup(spark, docs):
    found = by_key(spark, "op5_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found == brute.exact(docs)
    assert any(v[1] > 1 for v in found.values())


def check_pieces(rows, docs, length=4096):
    """Each id in exactly one piece, sequences without gaps, only the last one short."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for doc_id, text in docs:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), brute.crc(ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or number == len(by_sequence) - 1


def test_packing(spark, docs):
    rows = QUERIES["op6_packing"](spark, SF).collect()
    check_pieces(rows, docs)
    window, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in rows:
        window[r.sequence_id // 16][r.source] += r.length
        total[r.source] += r.length
    everything = sum(total.values())
    for number in list(sorted(window))[:-1]:  # every window near its target proportions
        for source, n in total.items():
            assert abs(window[number][source] - n / everything * 16 * 4096) < 16 * 64 + 64


def test_license_scan(spark, docs):
    rows = QUERIES["op7_license_scan"](spark, SF).collect()
    assert {d for d, t in docs if "icense" in t} == {r.doc_id for r in rows}
    fetched = {(r.doc_id, r.kind, r.unit, r.license, r.dice) for r in rows}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert fetched == set(con.execute(ORACLES["op7_license_scan"]).fetchall())


def test_quality_on_held_out_labels(spark):
    found = by_key(spark, "op8_quality", "doc_id", "score", "kept")
    labels = read("labels", "doc_id, quality")
    right = [found[d][1] == (q == 1) for d, q in labels]
    assert np.mean(right) >= 0.97
    assert np.mean([found[d][1] for d, q in labels if q]) >= 0.995


def test_simhash(spark, docs):
    found = by_key(spark, "op9_simhash", "doc_id", "fingerprint", "component_id")
    assert found == brute.simhash(docs)
    assert any(k != v[1] for k, v in found.items())


def test_chat_format(spark):
    said = "</s>[INST] ok [/INST]"
    rows = read("conversations", "conv_id, turn, role, text") + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert by_key(spark, "op10_chat_format", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == brute.conversations(rows)


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = frame.columns, {r.doc_id: r.text for r in frame.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            check_pieces(frame.collect(), list(before.items()))
            break
        assert frame.columns == columns
        rows = frame.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows)
        pairs = list(before.items())
        if number == 0:
            bad = {d for d, q in read("labels", "doc_id, quality") if not q}
            assert len(bad & set(after)) <= 0.05 * len(bad) and len(after) > 0.8 * len(before)
        elif number == 1:
            assert set(after) == {d for d, v in brute.exact(pairs).items() if v[2]}
        elif number == 2:
            assert set(after) == {d for d, v in brute.simhash(pairs).items() if v[1] == d}
        else:
            hit = brute.contaminated(pairs, read("benchmark", "item_id, text"))
            assert set(after) == {d for d, v in hit.items() if not v[-1]}
        before = after
