"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from llm import brute
from tremor.llm import chat, decontaminate, exact_dedup, licenses, packing, quality, secrets_scan, simhash, token_counts, token_shards
from tremor.llm.common import keep_rows, scratch
from tremor.llm.encoding import SpanEncoder, TextEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASHES = ["key", "row", "name", "space", "local", "block", "h1", "shard", "segment", "fp", "u", "v", "text_hash", "_row_key0", "ids", "part", "tie", "bucket", "kept", "unit", "score"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHES]])
LONG = "lorem ipsum dolor " * 20_000
TEXTS = [(1, None, "a"), (2, "", None), (None, "Some text, twice.", "b"), (None, "Some text, twice.", "b"), (3, "Some TEXT, twice.", "a"),
         (4, LONG, "a"), (5, LONG.upper(), "b"), (6, LONG + "x", "b"), (7, "été <|endoftext|> 漢字 \x00  é", "a"), (8, " ", "a"), (9, "\n\n", None), (9, "\n\n", None),
         (10, "A" * 5000 + "B" * 5000, "c"), (11, "a" * 5000 + "b" * 5000, "c"), (12, "a" * 5000 + "c" * 5000, "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, s, *CLASHES) for k, t, s in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_is_exact_on_odd_texts():
    rnd = random.Random(1)
    parts = [" ", " ", "  ", "\n", "\t", "a", "B", "é", "É", "'s", "'S", "'", "ll", "ß", "İ", "Σ", "σ", "ς", "1", "２", "²", "!", "...", "#", "<|endoftext|>", "<|", "漢", "😀",
             "́", "\xa0", "　", "\x1c", "\x85", "_", "ǅ", "ﬁ", "\r", "\x00", "the", "don't", "µ", "×", "÷", "﻿", "Ã"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(5000)] + [None, "", LONG]
    for path in (BYTES, WORDS):
        plain, encoder = Tokenizer.from_file(path), TextEncoder(path, max_pieces=100)
        for column in (pa.array(texts), pa.array(texts).slice(7, 900)):
            ids, bounds = encoder.encode(column)
            for n, text in enumerate(column.to_pylist()):
                assert ids[bounds[n]:bounds[n + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_token_spans_follow_the_library():
    texts = ["the cat's 12 <|endoftext|> naïve\n\ncafé 漢字 😀 x", "", None, "  two  spaces "]
    first, last, bounds = SpanEncoder(BYTES).spans(pa.array(texts))
    plain = Tokenizer.from_file(BYTES)
    for n, text in enumerate(texts):
        want = plain.encode(text or "", add_special_tokens=False).offsets
        got = list(zip(first[bounds[n]:bounds[n + 1]].tolist(), (last[bounds[n]:bounds[n + 1]] + 1).tolist(), strict=True))
        assert got == want


def test_shards_lookup_and_payloads(spark, docs, empty):
    path = scratch(spark, "test")
    token_shards.write_token_shards(spark, docs, path, tokenizer=BYTES, end_id=2)
    rows = token_shards.digests(spark, path, docs, "<u2").collect()
    assert len(rows) == len(TEXTS)
    plain = Tokenizer.from_file(BYTES)
    ids = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for k, t, _ in TEXTS}
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted((k is not None, k or 0, len(ids[k]), brute.crc(ids[k])) for k, _, _ in TEXTS)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted((k for k, _, _ in TEXTS), key=lambda k: (k is not None, k or 0))
    asked = spark.createDataFrame([(4,), (4,), (77,), (None,)], "doc_id long")
    found = token_shards.read_payloads(spark, path, token_shards.lookup(spark, path, asked), "<u2").collect()
    assert {r["key"]: len(r["ids"]) // 2 for r in found} == {4: len(ids[4]), None: len(ids[None])}
    path = scratch(spark, "test")
    token_shards.write_token_shards(spark, empty, path, tokenizer=BYTES, end_id=2)
    assert token_shards.digests(spark, path, empty, "<u2").collect() == []


def test_secrets_in_layers(spark, docs, empty):
    import base64
    import gzip
    from urllib.parse import quote
    packed = base64.b64encode(gzip.compress(b"password: 'hunter22'")).decode()
    twice = base64.b64encode(base64.b64encode(b"secret=abcdef123456").rstrip(b"=")).decode()
    hidden = "".join(f"\\u{ord(c):04x}" for c in "AKIA" + "Z9" * 9)
    text = f"é token = plainvalue1 {quote(packed, safe='')} {twice} {hidden} end"
    base, every = secrets_scan.scan(text)
    assert [text[a:b] for a, _, b in base] == ["token = plainvalue1"]
    found = {text[a:b]: secrets_scan.KINDS[k] for a, k, b in every}
    assert found["token = plainvalue1"] == "assign" and found[hidden] == "access" and set(base) <= set(every)
    assert any(k == "assign" and v.startswith(packed[:8]) for v, k in found.items())
    assert any(k == "assign" and v in twice for v, k in found.items())
    rows = secrets_scan.scan_secrets(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.spans == "" for r in rows if not r.n_hex)
    assert secrets_scan.scan_secrets(empty).collect() == []
    loop = base64.b64encode(b"nothing to see here, only text").decode()
    assert secrets_scan.scan(loop * 1)[1] == []  # ends


def test_secrets_match_plain_patterns():
    rnd = random.Random(2)
    parts = ["token", "API_KEY", "apikey", "ſecret", "Key", "=", ":", " ", '"', "'", "abc", "123456", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef" * 4, "deadbeef", "\n", "é"]
    docs = [(n, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for n in range(3000)]
    want = brute.secrets(docs)
    for n, text in docs:
        found = secrets_scan.find(text)
        assert want[n] == (*(sum(k == kind for _, k, _ in found) for kind in range(3)), brute.sha(secrets_scan.joined(found)))


def test_decontaminate_edges(spark, docs, empty):
    items = spark.createDataFrame([(1, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor lorem"), (2, "twice"), (None, "some text"), (3, ""), (4, None), (5, "text some")], "item_id long, text string")
    found, matches = decontaminate.decontaminate(spark, docs, items)
    rows = found.collect()
    want = brute.contaminated([(n, t) for n, (_, t, _) in enumerate(TEXTS)], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((r.n_words, r.n_hit, len(r["items"])) for r in rows) == sorted(v[:3] for v in want.values())
    assert sorted(brute.sha(",".join(r["items"])) for r in rows) == sorted(v[3] for v in want.values())
    assert any("5" in r.near_items for r in rows) and matches.count() > 0
    nothing, _ = decontaminate.decontaminate(spark, docs, items.limit(0))
    assert {r.n_hit for r in nothing.collect()} == {0}
    assert decontaminate.decontaminate(spark, empty, items)[0].collect() == []
    kept = decontaminate.remove_contaminated(spark, docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 7, 8, 9, 10, 11, 12}


def test_decontaminate_blocks_agree(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [(n, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 60)))) for n in range(60)]
    items = [(n, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 8)))) for n in range(12)]
    for limit, width, candidates in ((100_000, 10, 1 << 20), (3, 10, 7)):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", limit)
        monkeypatch.setattr(decontaminate, "CANDIDATES", candidates)
        found, _ = decontaminate.decontaminate(spark, spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=width)
        got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.n_hit > 0) for r in found.collect()}
        assert got == brute.contaminated(texts, items)


def test_token_counts_rules(spark, docs, empty):
    rows = token_counts.count_tokens(docs, tokenizer=BYTES).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(Tokenizer.from_file(BYTES).encode(t or "").ids) for _, t, _ in TEXTS)
    frame = spark.createDataFrame([(1, "internationalisation", "x"), (2, None, "y")], "doc_id long, text string, extra string")
    cut = F.array(F.lit(3), F.lit(17))
    for rule in token_counts.RULES:
        got = token_counts.count_tokens(frame, tokenizer=BYTES, lengths=cut, rule=rule).orderBy("doc_id", "section").collect()
        assert sum(r.n_tokens for r in got) == len(Tokenizer.from_file(BYTES).encode("internationalisation").ids)
        assert sum(r.n_crossing for r in got) == 1
        assert (got[0].n_tokens > 0) == (rule == "start")  # the first token is "international"
    text, lengths = token_counts.field_document(["text", "extra"])
    got = token_counts.count_tokens(frame, tokenizer=BYTES, text=text, lengths=lengths).collect()
    assert sorted((r.doc_id, r.section, r.length) for r in got) == [(1, 0, 21), (1, 1, 1), (2, 0, 1), (2, 1, 1)]
    assert token_counts.count_tokens(empty, tokenizer=BYTES).collect() == []


def test_exact_dedup_edges(spark, docs, empty):
    for block in (4096, 3):
        subset = docs if block == 4096 else docs.filter(F.length("text") < 100)
        rows = exact_dedup.exact_dedup(spark, subset, block_bytes=block).collect()
        want = [t for t in TEXTS if block == 4096 or t[1] is not None and len(t[1]) < 100]
        low = lambda t: (t or "").translate(brute.A_Z)
        sizes = {}
        for _, t, _ in want:
            sizes[low(t)] = sizes.get(low(t), 0) + 1
        assert sorted((brute.sha(low(t)), sizes[low(t)]) for _, t, _ in want) == sorted((r.text_sha256, r.group_size) for r in rows)
        kept = [r for r in rows if r.kept]
        assert len(kept) == len(sizes) == len({r.text_sha256 for r in kept})
        for r in rows:
            assert r.keep_id == max((k for k, t, _ in want if brute.sha(low(t)) == r.text_sha256 and k is not None), default=None)
    stays = exact_dedup.deduplicate(spark, docs)
    assert stays.columns == docs.columns
    assert sorted(r.doc_id for r in stays.collect()) == [2, 3, 5, 6, 7, 8, 9, 11, 12]
    assert exact_dedup.exact_dedup(spark, empty).collect() == [] and exact_dedup.deduplicate(spark, empty).collect() == []


def test_packing_edges(spark, docs, empty):
    plain = Tokenizer.from_file(WORDS)
    for shares in (None, {"a": 0.9, "b": 0.1}):
        rows = packing.pack(spark, docs, tokenizer=WORDS, end_id=2, length=64, window_sequences=4, granule=8, shares=shares, with_ids=True).collect()
        total = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in TEXTS)
        places = sorted((r.sequence_id * 64 + r.offset, r.length) for r in rows)
        at = 0
        for position, n in places:
            assert position == at
            at += n
        assert at == total
        assert all(len(r["ids"]) == 4 * r.length and r.length <= 64 for r in rows)
        four = sorted((r.start, r["ids"]) for r in rows if r.doc_id == 4)
        assert b"".join(i for _, i in four) == b"".join(i.to_bytes(4, "little") for i in [*plain.encode(LONG, add_special_tokens=False).ids, 2])
    assert packing.pack(spark, empty, tokenizer=WORDS, end_id=2).collect() == []


def test_mixture_follows_given_shares(spark):
    frame = spark.createDataFrame([(n, "word " * 99, "abc"[n % 3]) for n in range(600)], "doc_id long, text string, source string")
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = packing.pack(spark, frame, tokenizer=WORDS, end_id=2, length=256, window_sequences=8, granule=16, shares=shares).collect()
    first = [r for r in rows if r.sequence_id < 80]  # before the first queue runs dry
    for source, share in shares.items():
        assert abs(sum(r.length for r in first if r.source == source) / (80 * 256) - share) < 0.01


def test_licenses_edges(spark, docs, empty):
    assert licenses.license_lines(docs).collect() == [] and licenses.license_lines(empty).collect() == []
    mit = licenses.TEMPLATES["MIT"][1]
    half = mit[:len(mit) // 2] + "\n" + mit[len(mit) // 2:]
    texts = [(1, "Intro.\n" + mit.upper()), (2, half), (3, "Released under the MIT license"), (3, "Released under the MIT license"), (4, "released under")]
    rows = licenses.license_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.unit, r.license) for r in rows if r.kind != "window")
    assert got == [(1, -1, "MIT"), (1, 1, "MIT"), (2, -1, "MIT"), (3, 0, "MIT"), (3, 0, "MIT")]
    assert sorted((r.doc_id, r.license) for r in rows if r.kind == "window") == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (3, "MIT")]


def test_license_pruning_loses_nothing(spark, monkeypatch):
    rnd = random.Random(7)
    texts = [t for wordings in licenses.TEMPLATES.values() for t in wordings]
    docs = []
    for n in range(400):
        words = rnd.choice(texts).split(" ")
        for _ in range(rnd.randint(0, max(1, len(words) // 5))):  # around the threshold
            words[rnd.randrange(len(words))] = rnd.choice(["x", "of", "the", "license", ""])
        docs.append((n, rnd.choice(["", "Intro\n"]) + " ".join(words).swapcase()))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    pruned = sorted(tuple(r) for r in licenses.license_lines(frame).collect())
    assert 1 <= len(licenses.needed_words(licenses.template_bigrams(licenses.TEMPLATES), 0.8)) <= 2 * len(texts)
    monkeypatch.setattr(licenses, "needed_words", lambda *a: [""])
    assert pruned == sorted(tuple(r) for r in licenses.license_lines(frame).collect()) and len(pruned) > 100


def test_quality_edges(spark, docs, empty):
    rows = quality.classify(spark, docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(spark, empty).collect() == []
    kept = quality.keep_good(spark, docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.keep_good(spark, empty).collect() == []


def test_simhash_edges(spark, docs, empty):
    rows = simhash.near_duplicates(spark, docs).collect()
    keyed = {n: brute.fingerprint(t) for n, (_, t, _) in enumerate(TEXTS)}
    roots = brute.components(keyed)
    want = []
    for n, (k, _, _) in enumerate(TEXTS):
        least = min((TEXTS[m][0] for m in keyed if roots[m] == roots[n] and TEXTS[m][0] is not None), default=None)
        want.append((str(k), f"{keyed[n]:016x}", str(least)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == sorted(want)
    stays = simhash.deduplicate(spark, docs)
    assert stays.columns == docs.columns and stays.count() == len(set(roots.values()))
    assert simhash.near_duplicates(spark, empty).collect() == [] and simhash.deduplicate(spark, empty).collect() == []


def test_trie_join_finds_every_link(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    values = set()
    for _ in range(300):
        v = rnd.getrandbits(64)
        values.add(v)
        for _ in range(rnd.randint(0, 6)):  # chains within and just beyond the budget
            for _ in range(rnd.randint(1, 6)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    prints = {v: v for v in values}
    for chunk, rows in ((1 << 19, 32_768), (50, 8)):
        monkeypatch.setattr(simhash, "PAIR_CHUNK", chunk)
        monkeypatch.setattr(simhash, "SUBTRIE_ROWS", rows)
        frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
        roots = {r["node"] % (1 << 64): r["root"] for r in simhash.linked_components(spark, frame, f"{tmp_path}/{chunk}", 4).collect()}
        want = brute.components(prints)
        groups, found = {}, {}
        for v in values:
            groups.setdefault(want[v], set()).add(v)
            found.setdefault(roots.get(v, ("alone", v)), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_trie_join_of_a_dense_cluster(spark, tmp_path, monkeypatch):
    """All fingerprints share their first bits: the walk is dealt at deeper levels."""
    monkeypatch.setattr(simhash, "SUBTRIE_ROWS", 8)
    rnd = random.Random(6)
    values = {rnd.getrandbits(24) << 20 for _ in range(300)} | {5, 7}
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.linked_components(spark, frame, f"{tmp_path}/c", 4).collect()}
    want, groups, found = brute.components({v: v for v in values}), {}, {}
    for v in values:
        groups.setdefault(want[v], set()).add(v)
        found.setdefault(roots.get(v, ("alone", v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_chat_round_trip(spark):
    rnd = random.Random(5)
    parts = ["</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>", "<|row|>", "\\", "\n", "<", "|", ">", "[", "ok", "é", "<<SYS>>", "<|", "|>", "s>", "/", " "]
    rows = [(c, t, rnd.choice(["user", "assistant", "sys\ntem", "a\\n", None, "<|x|>"]), None if rnd.random() < 0.1 else "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))))
            for c in range(300) for t in range(rnd.randint(1, 7))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (5, 0, "user", rows[0][3]), (7, None, None, None)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(frame)
    got = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert len(got) == len(want)
    for g in got:
        turns = sorted(want[g.conv_id])
        assert [(t.role, t.text) for t in g.turns] == [x[2:] for x in turns]
        assert g.loss == "".join(x[3] for x in turns if x[2] == "assistant")
        runs = sum(n == 0 or turns[n][2] != turns[n - 1][2] for n in range(len(turns)))
        assert len(re.findall(r"(?<!\\)<\|im_start\|>", g.formatted)) == runs
    assert chat.format_conversations(frame.limit(0)).collect() == []


def test_long_documents_come_in_small_batches(spark):
    from tremor.llm.common import prepare
    prepare(spark)
    frame = spark.range(60, numPartitions=1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = frame.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) < 32 << 20 and sum(r.n for r in sizes) >= 60 << 20


def test_keep_rows(docs):
    want = docs.filter("doc_id is null or doc_id = 9").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    assert keep_rows(docs, want).count() == 4 and keep_rows(docs, want, once=True).count() == 2
    assert keep_rows(docs, want, how="left_anti").count() == len(TEXTS) - 4
