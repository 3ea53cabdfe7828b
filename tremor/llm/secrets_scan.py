"""Secret scan with recursive unwrapping of encoded layers.

The base layer is the text itself (null as empty). A worklist holds layers
still to be scanned: a layer with percent escapes (with plus signs as blanks too), or with
Unicode, backslash or entity escapes gives a layer with these undone, one with ASCII characters in units of two or four bytes
(UTF-16, UTF-32) a layer without the zero bytes. Every run of base64 characters
(standard or URL alphabet) gives layers of its own, line by line and with the
lines joined that only line breaks separate, or breaks with a mark at the next line's
beginning and quotes around the lines, in each of the four phases, so that
letters glued to a payload do not hide it; bytes that are no UTF-8 stay as
surrogates and hide nothing beside them. Compressed streams (gzip of any number of
members, zlib, bzip2, xz) anywhere in these bytes give layers of the unpacked
text; a stream that breaks off gives what came before. Every layer knows for each
of its characters the span of the original text that it came from, so findings
in any depth carry spans of the text as stored. A layer whose content has been
seen for the same origin is not opened again: cycles end, and the list runs
dry when nothing new unwraps.

Base findings stay as they are; a span found in several layers counts once.
Whole texts are scanned, without limits on length or depth. The text of an unpacked layer is held whole; as
all its characters come from one stream, it has one span, and so have the layers made from it.
Null and empty texts have no findings. Null keys are kept, repeated rows are scanned each, an
empty table gives no rows, other columns do not matter.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import text_slices

# The kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE = 6
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
FORM = re.compile(r"(?:%[0-9A-Fa-f]{2}|\+)+")  # plus signs as blanks, in texts with percent escapes
ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\+")
# What a letter or sign after a backslash stands for.
BACKSLASHED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "/": "/", '"': '"', "'": "'", "\\": "\\"}
UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|%u[0-9A-Fa-f]{4}"
                     r"""|&[A-Za-z]{2,8}[0-9]{0,2};|\\[0-3][0-7]{2}|\\[nrtbfva/"'\\]""")
WIDE = re.compile(r"(?:[\x01-\x7f]\x00){4,}[\x01-\x7f]?|(?:\x00[\x01-\x7f]){4,}|(?:[\x01-\x7f]\x00{3}){4,}|(?:\x00{3}[\x01-\x7f]){4,}")
HAS_ESCAPE = re.compile(r"""%[0-9A-Fa-fu]|\\[uUxnrtbfva/"'\\0-3]|&#|&[A-Za-z]{2,8}[0-9]{0,2};|\x00""")
# Runs of 16 characters (the shortest finding has 12 bytes), and shorter ones that go on in the next line.
LEAST = 16
BASE64 = tuple(re.compile(rf"(?<![{a}])(?=[{a}]{{{LEAST}}}|[{a}]++[ \t]*[\r\n])[{a}]++(?:[ \t]*+[\r\n][ \t\r\n]*+[{a}]++)*+") for a in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
LINE = re.compile(r"[^ \t\r\n]+")
# Marks that lines of wrapped base64 begin with, and quotes with a joining sign that they end with.
MARKED = re.compile(r"""[\r\n][ \t]*[>#*|;:%"']{1,3}[ \t]*[A-Za-z0-9+/_-]""")
EDGE = re.compile(r"""["'][ \t]*[+\\,;.]?[ \t]*(?=[\r\n])|[\r\n][ \t\r\n]*[>#*|;:%"']{1,3}[ \t]*""")
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|[\x08\x18\x28\x38\x48\x58\x68\x78](?=[^\x20-\x3f\x60-\x7f\xa0-\xbf\xe0-\xff])", re.S)
PIECE = 1 << 8  # bytes given to a decompressor at once: so much is lost before an error
Layer = tuple[str, np.ndarray, np.ndarray]


def same(value: int, size: int) -> np.ndarray:
    """One value for all characters, stored once."""
    return np.broadcast_to(np.int64(value), size)


def is_same(values: np.ndarray) -> bool:
    return values.strides == (0,)


def may_assign(text: str) -> bool:
    """Whether a word of the first kind is in the text (lower-casing loses none)."""
    low = text.lower()
    return any(word in low for word in ASSIGN_WORDS)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), leftmost non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE] if may_assign(text) else []
    # Greedy runs below the least length contain no shorter match, so the length stands in the pattern.
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all matches decoded; None if nothing changes."""
    text, begin, stop = layer
    parts, starts, ends, at, one = [], [], [], 0, is_same(begin) and is_same(stop)
    for m in pattern.finditer(text):
        got = decode(m[0])
        if got is None:
            continue
        parts += [text[at:m.start()], "".join(c for c, _, _ in got)]
        if not one:
            starts += [begin[at:m.start()], np.array([begin[m.start() + a] for _, a, _ in got], np.int64)]
            ends += [stop[at:m.start()], np.array([stop[m.start() + b - 1] for _, _, b in got], np.int64)]
        at = m.end()
    if not parts:
        return None
    if one:
        new = "".join((*parts, text[at:]))
        return new, same(begin[0], len(new)), same(stop[0], len(new))
    return "".join((*parts, text[at:])), np.concatenate((*starts, begin[at:])), np.concatenate((*ends, stop[at:]))


def decoded(data: bytes) -> tuple[str, np.ndarray]:
    """(text, bytes of each character); a byte that is no UTF-8 is a surrogate."""
    text = data.decode("utf-8", "surrogateescape")
    if text.isascii():
        return text, np.ones(len(text), np.int64)
    return text, np.fromiter((1 if "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text), np.int64, len(text))


def undo_percent(run: str) -> list[tuple[str, int, int]]:
    chars, sizes = decoded(bytes.fromhex(run.replace("%", "")))
    last = (3 * np.cumsum(sizes)).tolist()
    return list(zip(chars, [0, *last[:-1]], last, strict=True))


def undo_form(run: str) -> list[tuple[str, int, int]]:
    tokens = ESCAPED.findall(run)
    chars, sizes = decoded(bytes(0x20 if t == "+" else int(t[1:], 16) for t in tokens))
    ends = np.cumsum([len(t) for t in tokens])
    last = ends[np.cumsum(sizes) - 1].tolist()
    return list(zip(chars, [0, *last[:-1]], last, strict=True))


def undo_wide(run: str) -> list[tuple[str, int, int]]:
    return [(c, n, n + 1) for n, c in enumerate(run) if c != "\0"]


def undo_unicode(run: str) -> list[tuple[str, int, int]] | None:
    if run[0] == "&" and run[1] != "#":
        name = html.unescape(run)
        return None if name == run or len(name) != 1 else [(name, 0, len(run))]
    if run[0] == "\\" and run[1] in BACKSLASHED and len(run) == 2:
        return [(BACKSLASHED[run[1]], 0, 2)]
    if run[0] == "\\" and run[1] in "0123":
        return [(chr(int(run[1:], 8)), 0, len(run))]
    digits = run.strip("\\uUx{}&#;%")
    code = int(digits, 10 if run.startswith("&#") and not run.startswith("&#x") else 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else [(chr(code), 0, len(run))]


def stream(data: bytes, at: int) -> tuple[bytes, int]:
    """(unpacked bytes, end) of the compressed stream at a place, as far as it is whole."""
    kind, out, view = data[at:at + 2], [], memoryview(data)
    make = {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"BZ": bz2.BZ2Decompressor, b"\xfd7": lzma.LZMADecompressor}.get(kind, zlib.decompressobj)
    while True:
        unpacker, begin = make(), at
        try:
            while at < len(data) and not unpacker.eof:
                piece = view[at:at + PIECE]
                out.append(unpacker.decompress(piece))
                at += len(piece) - len(unpacker.unused_data)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return b"".join(out), begin
        if not unpacker.eof or kind not in (b"\x1f\x8b", b"BZ", b"\xfd7") or data[at:at + 2] != kind:
            return b"".join(out), at


def unpacked(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, start, end) of every compressed stream, and of those inside them with the outer place."""
    work: list[tuple[bytes, int, int]] = [(data, -1, -1)]
    seen = set()
    while work:
        outer, lo, hi = work.pop()
        at = 0
        while m := PACKED.search(outer, at):
            at = m.start() + 1
            if len(m[0]) == 1 and (outer[m.start()] << 8 | outer[m.start() + 1]) % 31:
                continue
            got, end = stream(outer, m.start())
            if not got:
                continue
            at = max(at, end)
            new = (got, m.start(), end if end > m.start() else len(outer)) if lo < 0 else (got, lo, hi)
            mark = (hashlib.blake2b(got, digest_size=16).digest(), *new[1:])
            if mark not in seen:
                seen.add(mark)
                work.append(new)
                yield new


def alphabets(text: str) -> tuple[re.Pattern, ...]:
    """The base64 patterns that matter: without a sign of the URL alphabet the standard one finds all runs."""
    return BASE64 if "-" in text or "_" in text else BASE64[:1]


def worth(text: str) -> bool:
    """Whether a layer holds a finding or anything to unwrap."""
    return any(p.search(text) for p in (HAS_ESCAPE, ACCESS, HEX, *alphabets(text))) or may_assign(text) and ASSIGN.search(text) is not None


def open_run(run: str, begin: np.ndarray, stop: np.ndarray, url: bool) -> Iterator[Layer]:
    """Layers of a run of base64 characters, in all four phases."""
    for phase in range(4):
        size = len(run) - phase
        size -= size % 4 == 1
        if size < LEAST:
            break
        data = base64.b64decode(run[phase:phase + size] + "=" * (-size % 4), altchars=b"-_" if url else None)
        got = data.decode("utf-8", "surrogateescape")
        good = worth(got)
        if good and is_same(begin) and is_same(stop):
            yield got, same(begin[0], len(got)), same(stop[0], len(got))
        elif good:
            got, sizes = decoded(data)
            last = np.cumsum(sizes)
            yield got, begin[phase + (last - sizes) * 8 // 6], stop[phase + np.minimum(-(-last * 8 // 6), size) - 1]
        for inner, a, b in unpacked(data):  # every unpacked character comes from the whole stream
            got = inner.decode("utf-8", "surrogateescape")
            if worth(got):
                lo, hi = begin[phase + a * 8 // 6], stop[phase + min(-(-b * 8 // 6), size) - 1]
                yield got, same(lo, len(got)), same(hi, len(got))


def undo_base64(layer: Layer) -> Iterator[Layer]:
    text, begin, stop = layer
    for number, pattern in enumerate(alphabets(text)):
        for m in pattern.finditer(text):
            if number and not ("-" in m[0] or "_" in m[0]):
                continue
            lines = [line.span() for line in LINE.finditer(text, *m.span())]
            for a, b in lines:
                if b - a >= LEAST and (not number or "-" in text[a:b] or "_" in text[a:b]):
                    yield from open_run(text[a:b], begin[a:b], stop[a:b], bool(number))
            if len(lines) > 1 and sum(b - a for a, b in lines) >= LEAST:
                run = "".join(text[a:b] for a, b in lines)
                if is_same(begin) and is_same(stop):
                    yield from open_run(run, begin[:len(run)], stop[:len(run)], bool(number))
                else:
                    at = np.concatenate([np.arange(a, b) for a, b in lines])
                    yield from open_run(run, begin[at], stop[at], bool(number))


def without_edges(layer: Layer) -> Layer | None:
    """The layer without marks at line beginnings and quotes at line ends, if base64 stands behind them."""
    if not MARKED.search(layer[0]):
        return None
    return replaced(layer, EDGE, lambda run: [("\n", 0, len(run))] if run[0] in "\r\n" else [])


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base findings, all findings) as (start, kind number, end) of the original text."""
    base = find(text)
    every = set(base)
    if not (HAS_ESCAPE.search(text) or any(p.search(text) for p in BASE64)):
        return base, base
    positions = np.arange(len(text), dtype=np.int64)
    work: list[Layer] = [(text, positions, positions + 1)]
    seen = set()
    while work:
        layer = work.pop()
        made = list(undo_base64(layer))
        if bare := without_edges(layer):
            made += undo_base64(bare)
        if HAS_ESCAPE.search(layer[0]):
            form = replaced(layer, FORM, undo_form) if "+" in layer[0] and PERCENT.search(layer[0]) else None
            made += [x for x in (form, replaced(layer, PERCENT, undo_percent), replaced(layer, UNICODE, undo_unicode), replaced(layer, WIDE, undo_wide)) if x]
        for new in made:
            mark = (hashlib.blake2b(new[0].encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(new[1][0]) if len(new[1]) else 0, int(new[2][-1]) if len(new[2]) else 0)
            if mark in seen:
                continue
            seen.add(mark)
            every.update((int(new[1][a]), kind, int(new[2][b - 1])) for a, kind, b in find(new[0]))
            work.append(new)
    return base, sorted(every)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, counts of base findings by kind, ``base`` and ``spans``
    (kind:start:end by start, then kind; code points, end exclusive)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                rows = []
                for t in batch.column(1).to_pylist():
                    base, every = scan(t) if t else ([], [])
                    rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), joined(base), joined(every)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                                 names=["key", "n_assign", "n_access", "n_hex", "base", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(run, f"key {kind}, n_assign long, n_access long, n_hex long, base string, spans string")
            .withColumnRenamed("key", key))
