"""Segmentation by a dictionary (P14) and emoji names by a table (T6) against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, plan_of, rows
from tremor.functions import text as T
from tremor.operators import lexicon as X
from tremor.operators import profile as PR
from tremor.operators.cleaning import clean_posts
from tremor.plans.registry import QUERIES
from tremor.sources import fixtures as FX

RND = random.Random(5)
WORDS = {"中国": 50, "中": 20, "国": 20, "国人": 30, "人": 60, "人民": 40, "中国人": 5, "中国人民": 2, "民": 8, "ab": 3, "abc": 2, "b": 1, "a1": 4, "的": 100}
TEXTS = [None, "", " ", "中国人民", "中国人民的人", "甲中国乙", "hello中国 abc abcd a1b2", "ab-abc,b", "　中\n国　", "x" * 300, "中国人" * 100,
         *["".join(RND.choice("中国人民的甲乙abc1 ,") for _ in range(RND.randint(1, 40))) for _ in range(200)]]


def all_paths(text, costs, unknown):
    """Best words of a run without blanks by trying every path (memoised from the front)."""
    known = {}

    def best(i):
        if i == len(text):
            return (0, ())
        if i not in known:
            run = i
            while run < len(text) and text[run].isascii() and text[run].isalnum():
                run += 1
            options = {i + 1: unknown, **({run: unknown} if run > i else {})}
            options |= {i + len(w): c for w, c in costs.items() if text.startswith(w, i)}
            known[i] = min((c + best(end)[0], (-end, *best(end)[1])) for end, c in options.items())
        return known[i]

    out, at = [], 0
    for end in (best(0)[1] if text else ()):
        out.append(text[at:-end])
        at = -end
    return out


def plain_words(text, costs, unknown):
    return None if text is None else [w for part in text.split() for w in all_paths(part, costs, unknown)]


@pytest.mark.parametrize("limit", [X.MAX_CHARS, 5])
def test_segment_takes_the_cheapest_path(spark, limit):
    words = spark.createDataFrame([(w, n) for w, n in WORDS.items()] + [("中", 5), ("two words", 9), ("", 3), (None, 3), ("zero", 0)], "word string, freq long")
    costs = {r.entry: r.value for r in X.word_costs(words).collect()}
    assert set(costs) == set(WORDS)
    posts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    got = {r.id: r.words for r in X.segment(posts, words, max_chars=limit).collect()}
    for n, text in enumerate(TEXTS):
        assert got[n] == plain_words(text, costs, X.unknown_cost(words)), text
    assert got[3] in (["中国", "人民"], ["中国人民"])


def test_ties_go_to_the_longer_first_word(spark):
    words = spark.createDataFrame([("ab", 1), ("a", 1), ("bc", 1), ("c", 1)], "word string, freq long")
    got = X.segment(spark.createDataFrame([("甲ab甲bc",), ("abc",)], "text string"), words).collect()
    assert got[0].words == ["甲", "ab", "甲", "bc"] and got[1].words == ["abc"]
    lower = spark.createDataFrame([("甲乙", 1), ("丙", 1), ("甲", 1), ("乙丙", 1)], "word string, freq long")
    assert X.segment(spark.createDataFrame([("甲乙丙",)], "text string"), lower).first().words == ["甲乙", "丙"]


def test_token_count_with_a_segmenter(spark):
    words = spark.createDataFrame(list(WORDS.items()), "word string, freq long")
    cut = X.dictionary_segmenter(words)
    posts = spark.createDataFrame([("e", "中国人民"), ("e", "hello world"), ("e", " ")], "event string, text string")
    assert [r[0] for r in posts.select(T.token_count("text", cut)).collect()] == [2, 2, 0]
    assert rows(PR.lengths(posts, segmenter=cut), "words", "chars") == [(2, 4), (2, 11)]
    with pytest.raises(ValueError):
        X.dictionary_segmenter(words, max_chars=3)


def test_segment_words_query(spark):
    import hashlib
    docs = {r.pos: r.text for r in FX.fx_unspaced(spark, SF_SMALL).collect()}
    freq = FX.word_frequencies(spark, SF_SMALL)
    costs, unknown = {r.entry: r.value for r in X.word_costs(freq).collect()}, X.unknown_cost(freq)
    by_first = {}
    for w, c in costs.items():
        by_first.setdefault(w[0], {})[w] = c
    got = {r.pos: (r.n_words, r.words_md5) for r in QUERIES["segment_words"](spark, SF_SMALL).collect()}
    assert set(got) == set(docs)
    known = X.Lexicon(list(costs.items()))
    for pos, text in sorted(docs.items()):
        want = [w for part in text.split() for w in X.cheapest_cut(part, known, unknown)]  # whole parts, not cut at unknown characters
        assert got[pos] == (len(want), hashlib.md5(" ".join(want).encode()).hexdigest())
    short = [t for t in docs.values() if len(t) < 150][:10]
    assert short
    for text in short:
        assert [w for p in text.split() for w in X.cheapest_cut(p, known, unknown)] == plain_words(text, costs, unknown)


@pytest.mark.parametrize("limit", [X.MAX_CHARS, 3])
def test_emoji_table_equals_the_dict_form(spark, limit):
    names = T.DEFAULT_EMOJI_NAMES
    family, heart = "\U0001F468‍\U0001F469‍\U0001F467", "❤️"
    texts = [None, "", "plain", f"a{family}b", f"{heart}❤", "\U0001F468‍\U0001F469", f"{family}{family}\U0001F602", "\U0001F602" * 50,
             *["".join(RND.choice([*names, "a", "‍", "️", "\U0001F468", " "]) for _ in range(30)) for _ in range(100)]]
    posts = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    table = spark.createDataFrame([*names.items(), ("", "x"), (None, "y"), ("\U0001F602", "笑哭了")], "seq string, name string")
    got = rows(X.demojize_table(posts, table, max_chars=limit), "id", "text")
    assert got == rows(posts.select("id", T.demojize("text", names).alias("text")), "id", "text")
    chain = rows(clean_posts(posts, "text", "text", partitions=2, emoji_table=table), "id", "text")
    assert chain == rows(posts.select("id", T.clean_text("text").alias("text")), "id", "text")


def test_emoji_table_of_the_query_is_large(spark):
    table = FX.emoji_table(spark)
    assert table.count() > 1500 and table.select("seq").distinct().count() == table.count()
    one = spark.createDataFrame([("\U0001F468‍\U0001F33E\U0001F1E6\U0001F1E7\U0001F1E8\U0001F44A\U0001F3FB1️⃣1",)], "text string")
    assert X.demojize_table(one, table).first().text == ":e1f468_200d_1f33e::e1f1e6_1f1e7:\U0001F1E8:e1f44a_1f3fb::e31_fe0f_20e3:1"
    assert X.demojize_table(one, table.limit(0)).first().text == one.first().text
    assert X.demojize_table(one.select(F.lit("z").alias("_named"), "text"), table, out="t").columns == ["_named", "text", "t"]


def test_many_texts_at_once_equal_one_run_at_a_time(monkeypatch):
    """Ties, entries over the ends of texts, parts of all lengths; entries of one hash are told apart."""
    monkeypatch.setattr(X, "TOGETHER_CHARS", 100)
    signs = "中国人ab1-é\U0001F600"
    for _ in range(150):
        entries = list({"".join(RND.choice(signs) for _ in range(RND.randint(1, 5))): RND.choice([0, 1, 2, 3, 5, 8]) for _ in range(RND.randint(0, 25))}.items())
        unknown = RND.choice([0, 3, 6, 9])
        texts = [None, "", *["".join(RND.choice(signs + " 　") for _ in range(RND.randint(0, 60))) for _ in range(8)]]
        known = X.Lexicon(entries)
        want = [None if t is None else [w for part in t.split() for w in X.cheapest_cut(part, known, unknown)] for t in texts]
        assert X.segmenter(X.Matcher(entries), unknown)(texts) == want


@pytest.mark.parametrize("bits", [X.FILTER_BITS, 6])
def test_pieces_let_through_hold_every_entry(monkeypatch, bits):
    """A crowded filter lets more pieces through, and none too few; pieces of equal hash all come."""
    monkeypatch.setattr(X, "TOGETHER_CHARS", 50)
    entries = ["中国", "国人民", "abc", "b", "\U0001F468‍\U0001F33E"]
    texts = [None, "", *["".join(RND.choice("中国人民abcd‍\U0001F468\U0001F33E") for _ in range(40)) for _ in range(30)]]
    lengths = X.np.array([len(e) for e in entries])
    bits = min(bits, 16)
    _, at = X.entry_hashes(X.code_points("".join(entries)), X.np.cumsum(lengths) - lengths, lengths, bits, 0)
    for hashing in (X.longer, lambda h, codes: h + X.np.uint64(1)):
        if hashing is not X.longer:
            monkeypatch.setattr(X, "longer", hashing)
            at = X.np.arange(1 << bits)
        found = {p for pieces in X.usable_pieces(texts, X.packed(at, bits), bits, 3) for p in pieces}
        assert {e for e in entries if any(e in (t or "") for t in texts)} <= found
        if hashing is not X.longer:
            assert {t[i:i + n] for t in texts if t for n in (1, 2, 3) for i in range(len(t) - n + 1)} <= found


def test_a_large_dictionary_is_cut_to_what_a_group_can_use(spark, monkeypatch):
    """A table over the limit: far fewer pieces than places times lengths meet it."""
    texts = ["".join(RND.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000)) for _ in range(4)]
    words = [t[i:i + n] for t in texts for i, n in ((RND.randrange(1900), RND.randint(1, 24)) for _ in range(300))]
    lengths = X.np.array([len(w) for w in words])
    _, at = X.entry_hashes(X.code_points("".join(words)), X.np.cumsum(lengths) - lengths, lengths, 20, 0)
    found = [p for pieces in X.usable_pieces(texts, X.packed(at, 20), 20, 24) for p in pieces]
    assert set(words) <= set(found) and len(found) < 3 * len(set(words))  # 24 pieces a place: 190,000
    posts = spark.createDataFrame([(n, t) for n, t in enumerate([*texts, None, ""])], "id long, text string").repartition(3)
    table = spark.createDataFrame([(w, 1) for w in words], "word string, freq long")
    monkeypatch.setattr(X, "GROUP_BYTES", 3000)
    assert rows(X.segment(posts, table, max_chars=10).where("id < 4")) == rows(X.segment(posts, table).where("id < 4"))


def test_first_signs_of_a_table_are_found_quickly():
    """The time for a text does not grow with the number of signs that entries begin with."""
    import time
    text = "the words of a text " * 20_000

    def seconds(signs):
        known = X.Lexicon([(chr(0x10000 + 2 * n), "x") for n in range(signs)])
        firsts = X.np.zeros(0x110000, bool)
        firsts[[ord(c) for c in known.firsts]] = True
        took = []
        for _ in range(3):
            begun = time.perf_counter()
            assert X.named(known, text + "\U00010000", firsts) == text + ":x:"
            took.append(time.perf_counter() - begun)
        return min(took)
    assert seconds(20_000) < 10 * seconds(10) + 0.05


def test_pieces_of_a_large_table_are_written_in_parts(spark, monkeypatch):
    """Disk: pieces and entries pass in compressed parts and once a group, not row by row."""
    texts = ["".join(RND.choice("abcdefgh") for _ in range(3000)) for _ in range(12)]
    table = spark.createDataFrame([(t[i:i + n], 1 + i % 3) for t in texts for i in range(0, 2900, 7) for n in (2, 5, 9)], "word string, freq long")
    posts = spark.createDataFrame([*enumerate(texts), (90, None), (91, "")], "id long, text string").repartition(3)
    monkeypatch.setattr(X, "GROUP_BYTES", 5000)
    monkeypatch.setattr(X, "SHARE_CHARS", 3000)
    made = X.segment(posts, table, max_chars=2000)
    assert not [line for line in plan_of(made).splitlines() if "Exchange" in line and "entry" in line]
    assert {r.id: r.words for r in made.collect()} == {r.id: r.words for r in X.segment(posts, table).collect()}
    pieces = list({t[i:i + n] for t in texts for i in range(2900) for n in (5, 6, 7, 8, 9)})
    parts = list(X.shared_out(X.pa.table({"entry": pieces}), 3, 7, True))
    assert sorted(e for p in parts for e in X.unpacked_entries(p.column("_entries")[0]).column("entry").to_pylist()) == sorted(pieces)
    assert sum(len(p.column("_entries")[0].as_py()) for p in parts) < 4 * len(pieces)  # a row of its own: 14 bytes


def test_entries_that_all_tasks_have_are_few(spark):
    costs = spark.createDataFrame([(f"w{n}", n % 50) for n in range(3000)], "entry string, value long")
    names = costs.select("entry", F.col("value").cast("string").alias("value"))
    for table in (costs, names):
        for most in (10, 500, 5000):
            rank, limit = X.rank_of(table), X.head_limit(table, most / 14000, most)
            assert (table.where(rank < F.lit(limit)).agg(F.sum(F.length("entry"))).first()[0] or 0) <= most
            assert table.where(rank < F.lit(limit)).count() + table.where(rank >= F.lit(limit)).count() == 3000
