"""Layers unpacked from small streams: one span each, memory in proportion to the text alone."""

import base64
import gzip
import tracemalloc

from tremor.llm import secrets_scan

LINE = "the order of the lines in this part is as it was, and nothing else is said here\n"


def wrapped(text):
    return base64.b64encode(gzip.compress(text.encode())).decode()


def test_unpacked_layers_have_one_span():
    inner = LINE * 50 + "api%5Fkey%3Dabcdef123 " + wrapped("PassWD: 'z9z9z9z9'") + "\n" + "token=\\u0061bcdefg"
    doc = "see " + wrapped(inner) + " end"
    for layer in secrets_scan.undo_base64((doc, secrets_scan.np.arange(len(doc)), secrets_scan.np.arange(len(doc)) + 1)):
        if LINE in layer[0]:
            assert secrets_scan.is_same(layer[1]) and secrets_scan.is_same(layer[2])
    base, every = secrets_scan.scan(doc)
    start, end = 4, len(doc) - 4
    assert not base and [(k, a) for a, k, _ in every] == [(0, start)] and end - 4 <= every[0][2] <= end
    for part, found in ((LINE * 50 + "api%5Fkey%3Dabcdef123", 1), (LINE * 50 + wrapped("PassWD: 'z9z9z9z9'"), 1), (LINE * 50 + "t\\u006fken=abcdefg", 1), (LINE * 50, 0)):
        assert len(secrets_scan.scan("see " + wrapped(part) + " end")[1]) == found


def test_memory_follows_the_text():
    size = 8 << 20
    doc = wrapped(LINE * (size // len(LINE)) + "password=hunter2secret")
    tracemalloc.start()
    try:
        assert len(secrets_scan.scan(doc)[1]) == 1
        assert tracemalloc.get_traced_memory()[1] < 8 * size
    finally:
        tracemalloc.stop()


def test_assign_words_in_any_case():
    texts = ["PASSWORD=abcdef1", "Api_Key: abcdef1", "APIKEY=abcdef1", "\u0130 Secret=abcdef1", "TOKEN=abcdef1", "tok\u0435n=abcdef1", "PassWd = 'abcdef1'"]
    assert [len(secrets_scan.find(t)) for t in texts] == [1, 1, 1, 1, 1, 0, 1]
