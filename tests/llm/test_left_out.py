"""Cases that the operators left out before: wrapped licences, further escapes, edges of documents, hot blocks, the label model."""

import base64
import gzip
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from llm import brute
from tremor.llm import decontaminate, exact_dedup, licenses, quality, secrets_scan
from tremor.llm.queries import ORACLES


def wrapped(text, mark="", width=72):
    lines, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join(mark + x for x in [*lines, line])


def license_cases():
    rnd = random.Random(9)
    code = "\n".join(f"v{rnd.randrange(999)} = f{rnd.randrange(999)}(x{rnd.randrange(999)}, y{rnd.randrange(999)})" for _ in range(120))
    said = {name: texts for name, texts in licenses.TEMPLATES.items()}
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped(licenses.MIT_GRANT) + "\n\n" + wrapped(licenses.MIT_REST) + "\n"
    return [("Apache-2.0", wrapped(said["Apache-2.0"][1], "# ") + "\n" + code), ("GPL-3.0", wrapped(said["GPL-3.0"][1], " * ") + "\n" + code),
            ("BSD-3-Clause", code + "\n" + wrapped(licenses.BSD_TERMS + " " + licenses.BSD_DISCLAIMER, "// ") + "\n" + code), ("MIT", mit), ("MIT", mit + code), ("MIT", code + mit),
            ("MIT", "This package is a tool. Released under the MIT License. It does many things and some more of them."),
            ("ISC", code + "\n" + wrapped(licenses.ISC_GRANT, "; ", 30) + "\n" + code), ("CC-BY-4.0", "All pictures are licensed under\nCC BY 4.0. Ask us for others, if you need them."),
            (None, code), (None, ""), (None, "Permission slips are here; the rights of the people. Under the bridge, a license plate."), (None, None)]


def test_licenses_across_lines_and_in_prose(spark):
    cases = list(enumerate(license_cases()))
    rows = [(n, text) for n, (_, text) in cases]
    found = [tuple(r) for r in licenses.license_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()]
    for n, (name, _) in cases:
        assert {r[3] for r in found if r[0] == n} == ({name} if name else set()), (n, name)
    assert any(r[1] == "paragraph" for r in found) and any(r[1] == "window" and r[2] > 0 for r in found)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert set(found) == set(con.execute(ORACLES["op7_license_scan"]).fetchall())


def test_every_match_holds_an_anchor():
    top, base = licenses.ratio(0.8)
    places = licenses.anchors(licenses.TEMPLATES, 0.8)
    for number, text in enumerate(t for _, texts in sorted(licenses.TEMPLATES.items()) for t in texts):
        words = licenses.template_words(text)
        chosen = {w for w, t, _, _ in places if t == number}
        pairs = set(zip(words, words[1:], strict=False))
        assert len([p for p in pairs if not chosen & set(p)]) * (2 * base - top) < top * len(pairs)


def test_secrets_behind_further_escapes():
    said, rnd = b"secret=abcdef123456", random.Random(3)
    packed = base64.b64encode(gzip.compress(b"some words before " * 3 + said + b" " + bytes(rnd.randrange(256) for _ in range(200)))).decode()
    lines = [packed[i:i + 76] for i in range(0, len(packed), 76)]
    assert len(lines) > 3
    cases = {"json string": '{"k": "' + "\\n".join(lines) + '"}', "slashes": packed.replace("/", "\\/"), "quoted": "> " + "\n> ".join(lines), "comment": "# " + "\n# ".join(lines),
             "concatenated": " +\n    ".join(f'"{x}"' for x in lines), "adjacent": "\n".join(f"  '{x}'" for x in lines), "plus": "q=password+%3D+abcdef123456&x=1",
             "octal": "".join(f"\\{c:03o}" for c in said), "entity": "password&equals;abcdef123456", "quote entity": "password&quot;: &quot;abcdef123456&quot;",
             "json in json": '{"a": "{\\"password\\": \\"abcdef123456\\"}"}', "crlf": "\r\n".join(lines), "percent lines": "%0A".join(lines)}
    for name, text in cases.items():
        base, every = secrets_scan.scan(text)
        assert any(kind == 0 for _, kind, _ in every), name
        assert all(0 <= a < b <= len(text) for a, _, b in every), name
        assert set(base) <= set(every)
    text = cases["plus"]
    assert [text[a:b] for a, _, b in secrets_scan.scan(text)[1]] == ["password+%3D+abcdef123456"]
    text = cases["entity"]
    assert [text[a:b] for a, _, b in secrets_scan.scan(text)[1]] == [text]


def test_spans_of_random_nestings():
    """Whatever wraps a secret, its span covers exactly the wrapping (or, inside base64, lies in it)."""
    rnd = random.Random(12)
    wraps = {"percent": lambda s: "".join(f"%{c:02X}" for c in s.encode()), "json": lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "hex": lambda s: "".join(f"\\x{c:02x}" for c in s.encode()),
             "entity": lambda s: "".join(f"&#{ord(c)};" for c in s), "base64": lambda s: base64.b64encode(s.encode()).decode(),
             "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode()}
    for _ in range(150):
        inner = f"password={rnd.randrange(10 ** 8, 10 ** 9)}"
        names = [rnd.choice(list(wraps)) for _ in range(rnd.randint(1, 3))]
        for name in names:
            inner = wraps[name](inner)
        before, after = rnd.choice(["see: ", "x\n", ""]), rnd.choice([" end", "\nend", ""])
        text = before + inner + after
        spans = {(a, b) for a, kind, b in secrets_scan.scan(text)[1] if kind == 0}
        lo, hi = len(before), len(before) + len(inner)
        assert any(a < hi and b > lo for a, b in spans), (names, text)
        if names[-1] in ("percent", "json", "hex", "entity") and not {"base64", "gzip", "zlib"} & set(names):
            assert (lo, hi) in spans, names


def matches(spark, docs, items):
    _, found = decontaminate.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item, r.exact) for r in found.collect()}


def test_proximity_stays_in_the_document(spark):
    words = [f"{c}2" for c in "abcdefghij"]
    docs = [(1, "zz yy"), (2, " ".join(words[:8] + words[9:])), (3, words[8] + " and more"), (4, "b c d e f g h k rare"), (5, " ".join(words))]
    found = matches(spark, docs, [(8, " ".join(words)), (9, "b b c d e f g h k rare")])
    assert (5, "8", True) in found and (2, "8", False) not in found and (2, "8", True) not in found
    assert (4, "9", False) in found and not any(d in (1, 3) for d, _, _ in found)


def near_plain(words, window, totals, slop):
    """Whether a document's words match a window within slop, as seen from the window's rarest word."""
    order = np.argsort([totals[w] for w in window], kind="stable")
    at = int(order[0])
    for p, w in enumerate(words):
        if w == window[at]:
            start = p - at
            if all(any(words[q] == window[k] for q in range(max(start + k - slop, 0), min(start + k + slop, len(words) - 1) + 1)) for k in range(len(window))):
                return True
    return False


def test_proximity_against_a_plain_version(spark):
    rnd = random.Random(21)
    vocabulary = [f"w{n}" for n in range(14)]
    docs = [(n, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 25)))) for n in range(150)]
    items = []
    for n in range(12):
        source = docs[rnd.randrange(len(docs))][1].split(" ")
        cut = source[:10] if len(source) >= 10 else [rnd.choice(vocabulary) for _ in range(10)]
        if n % 2:
            cut.insert(rnd.randrange(10), cut.pop(rnd.randrange(10)))
        items.append((n, " ".join(cut)))
    totals = {}
    for _, t in docs:
        for w in t.split():
            totals[w] = totals.get(w, 0) + 1
    found = {(d, i) for d, i, _ in matches(spark, docs, items)}
    want = {(d, str(i)) for d, t in docs for i, s in items if all(w in totals for w in s.split(" ")) and near_plain(t.split(), s.split(" "), totals, 2)}
    assert found == want and want


def test_block_in_every_space(spark, monkeypatch):
    """One block that all spaces share, next to blocks of their own."""
    monkeypatch.setattr(exact_dedup, "SPACE_ROWS", 2)
    docs = [(n, "HEAD" * 1024 + f"{n % 40}" * (n % 3)) for n in range(120)]
    found = exact_dedup.exact_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == brute.exact(docs)


def test_label_model_against_a_plain_version():
    rnd = np.random.default_rng(2)
    kinds = len(quality.LABELLERS)
    votes = np.ones((600, kinds), int)
    votes[rnd.random((600, kinds)) < 0.1] = -1
    for row in range(90):
        votes[row, row % kinds] = 0
    votes[rnd.random((600, kinds)) < 0.01] = 0
    ids, counts = np.unique(quality.pattern_of(votes.astype(np.int8)), return_counts=True)
    good, accuracy = quality.fit_labels(ids, counts)
    plain, right = brute.label_model([tuple((int(p) // 3 ** n) % 3 - 1 for n in range(kinds)) for p in ids], counts.tolist(),
                                     quality.PRIOR, quality.FALSE_ALARM, quality.FINDS, quality.FINDS_OTHERS, quality.ROUNDS)
    assert np.allclose(good, plain, atol=1e-9) and np.allclose(accuracy, right, atol=1e-9)
    of = dict(zip(ids.tolist(), good.tolist(), strict=True))
    assert np.mean([of[int(p)] < 0.5 for p in quality.pattern_of(votes[:90].astype(np.int8))]) > 0.9
    # the beliefs weigh a fixed number of documents: much data outweigh them
    many, _ = quality.fit_labels(ids, counts * 1000)
    assert np.all((many < 0.5) == (good < 0.5))


def test_scores_are_those_of_the_linear_model(spark):
    rnd = random.Random(4)
    words = ["der", "Die", "das", "und", "a", "été", "12", "x!", "###", "END."]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(40)] + ["", " ", "漢字 " * 5, "a" * 600]
    model = quality.Model({}, {}, np.random.default_rng(1).normal(size=quality.N_FEATURES), 0.25)
    _, got = quality.rate(pa.array([*texts, None]), model)
    for n, text in enumerate([*texts, ""]):
        row, feature, value = quality.features(quality.tables(pa.array([text])))
        assert set(row.tolist()) <= {0}
        words_seen = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        assert np.isclose(value[feature < quality.HASHES].sum(), 1.0 if words_seen else 0.0)
        linear = sum(model.weights[f] * v for f, v in zip(feature, value, strict=True)) + 0.25
        assert abs(got[n] - round(1 / (1 + np.exp(-linear)), 9)) < 1e-8


def test_scorer_is_a_minimum_and_learns_from_words(spark):
    rnd = random.Random(7)
    clean = [f"The {' '.join(rnd.choice(['house', 'tree', 'river', 'and', 'of', 'green', 'walks']) for _ in range(30))}. It is." for _ in range(150)]
    junk = [" ".join(rnd.choice(["BUY", "NOW", "CLICK", "WIN"]) for _ in range(30)) for _ in range(50)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(clean + junk)], "doc_id long, text string")
    model = quality.fit(spark, docs)
    assert set(model.accuracy) == set(quality.LABELLERS) and all(0 <= a <= 1 for a in model.accuracy.values())
    got = {r.doc_id: r.kept for r in quality.score(docs, model).collect()}
    assert all(got[n] == (n < 150) for n in got)
    # words alone decide: junk words in a shape that no labeller notices
    _, (said,) = quality.rate(pa.array(["BUY NOW CLICK WIN"]), model)
    _, (plain,) = quality.rate(pa.array(["house tree river green"]), model)
    assert said < plain
