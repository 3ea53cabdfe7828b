"""Cases that earlier versions of the operators left out."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import duckdb
import pyarrow.parquet as pq

from tremor.llm import decontaminate, licenses, quality, secrets_scan
from tremor.llm.common import batch_rows, prepare
from tremor.llm.queries import ORACLES


def test_secrets_wrapped_wide_and_glued():
    said, noise = b"secret=abcdef123456", bytes(range(33, 126)) * 3
    random.seed(5)
    dull = bytes(random.randrange(256) for _ in range(400))
    plain = lambda data: base64.b64encode(data).decode()
    wrapped = lambda data, n, end: end.join(plain(data)[i:i + n] for i in range(0, len(plain(data)), n))
    cases = {f"{name}-{n}": "text before\n" + wrapped(pack(noise + dull + said), n, end) + "\nand after" for n, end in ((64, "\n"), (76, "\r\n"), (60, "\n  "))
             for name, pack in (("gzip", gzip.compress), ("zlib", zlib.compress), ("bz2", bz2.compress), ("xz", lzma.compress), ("none", bytes))}
    cases["straddles"] = wrapped(b"x" * 50 + said, 76, "\n")
    cases["url"] = "see " + base64.urlsafe_b64encode(b"\xff\xfe\xfd" * 30 + said).decode() + " there"
    for name in ("utf-16", "utf-16-le", "utf-16-be", "utf-32-le"):
        cases[name] = plain(("é " + said.decode() + " é").encode(name))
    cases["esc"], cases["bad byte"], cases["mixed"] = plain(b"\x1b[1m" + said + b" \x1b[0m"), plain(b"\xff" + said + b" \xfe"), plain(dull + said + b"\x00" + dull)
    cases["percent"] = "".join(f"%{c:02X}" for c in b"\xff" + said + b"\xff")
    for glue in ("a", "ab", "abc", "path/", "key_", "key-", "/", "ab/c_"):
        cases["glued " + glue] = glue + plain(said)
        cases["glued gzip " + glue] = glue + plain(gzip.compress(said))
    cases["members"] = plain(gzip.compress(b"first one ") + gzip.compress(said))
    cases["cut off"] = plain(gzip.compress(noise + said + b" and what follows " + dull)[:-120])
    cases["inside"] = plain(b"header " + zlib.compress(base64.b64encode(gzip.compress(said))) + dull)
    for name, text in cases.items():
        base, every = secrets_scan.scan(text)
        assert base == [] and any(kind == 0 for _, kind, _ in every), name
        assert all(0 <= a < b <= len(text) for a, _, b in every), name
    text = cases["straddles"]
    assert [text[a:b] for a, _, b in secrets_scan.scan(text)[1]][-1].endswith(text[-1])
    words = "\n".join(["wordlist"] * 2000)
    assert secrets_scan.scan(words) == ([], [])


def test_licenses_at_the_threshold(spark):
    """Units with a Dice coefficient of exactly 0.8, on either side of the template's size."""
    texts = ["Released under the MIT License - see file", "Released under the BSD 3-Clause License see the file"]
    for wordings in licenses.TEMPLATES.values():
        for t in wordings:
            words = t.split(" ")
            n = len(licenses.template_bigrams({"": [t]})[0][1])
            texts += [" ".join((t, *(f"x{i}" for i in range(more)))) for more in range(n // 2 - 1, n // 2 + 2)]
            texts += [" ".join(words[:len(words) - less]) for less in range(n // 3 - 1, n // 3 + 2) if less > 0]
    rows = list(enumerate(texts))
    found = {tuple(r) for r in licenses.license_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert found == set(con.execute(ORACLES["op7_license_scan"]).fetchall())
    assert sum(r[4] == 0.8 for r in found) > 10


def test_quality_sample_under_skew(spark, monkeypatch):
    """At most ``sample`` texts, the large group of copies among them once with its share as weight."""
    rows = [(n, f"Plain text number {n} says a few things. It goes on.") for n in range(3000)] + [(n, "BUY NOW !! | | $$$ BUY NOW !! | | $$$") for n in range(3000, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hashes = docs.select(quality.text_hash().alias("text_hash"))
    hot = docs.filter("doc_id = 3000").select(quality.text_hash()).first()[0]
    sampled, distinct = quality.priority_sample(hashes, 200)
    weights = dict(sampled)
    assert distinct == 3001 and len(sampled) == len(weights) == 200
    assert weights[hot] == 2000 and 0.8 * 3000 < sum(weights.values()) - 2000 < 1.2 * 3000
    assert quality.priority_sample(hashes, 3001)[0] != [] and set(dict(quality.priority_sample(hashes, 4000)[0]).values()) == {1.0, 2000.0}
    fitted = []

    class Seen(quality.LogisticRegression):
        def fit(self, table):
            fitted.extend(table.collect())
            return super().fit(table)

    monkeypatch.setattr(quality, "LogisticRegression", Seen)
    quality.fit(spark, docs, sample=200)
    assert len({r.features for r in fitted}) <= 200 and len(fitted) <= 2 * 200
    share = sum(r.weight for r in fitted if r.weight > 1000) / sum(r.weight for r in fitted)
    assert 0.3 < share < 0.5


def test_a_segment_of_the_index_is_read_alone(spark, tmp_path, monkeypatch):
    """What a task holds of the index does not grow with its number of segments: each is a row group."""
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 200)
    rows = [(n, f"some words of document {n} and the end of it " * (20 if n == 5 else 1)) for n in range(40)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    prepare(spark)
    with batch_rows(spark, 2000):
        index = decontaminate.build_index(docs, str(tmp_path / "index"))
    groups = [m.row_group(n).num_rows for f in (tmp_path / "index").glob("*.parquet") for m in [pq.read_metadata(f)] for n in range(m.num_row_groups)]
    assert index.count() == len(groups) > 5 and set(groups) == {1}
    found, _ = decontaminate.decontaminate(spark, docs, spark.createDataFrame([("a", "words of document 5 and the end of it some"), ("b", "document 7 and")], "item_id string, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in found.where("n_hit > 0").collect()} == {5: (200, 190, ["a"]), 7: (10, 3, ["b"])}
    assert found.count() == 41
