"""Exact text encoding with the tokenizers library, remembering pieces.

Pre-tokenizers that never join a non-space character with a following space
cut every text in front of such a space, so the ids of a text are the ids of
its pieces one after another. Pieces recur; each is encoded by the library
once per worker and remembered (bounded). Texts are only cut after visible
ASCII characters and Latin-1 letters, and not at all for tokenizers of other
kinds; what lies between two cuts goes to the library as it stands.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tremor.llm.common import spread_ranges, text_bytes

# The patterns of the two public tokenizers, for the characters
# below only (ASCII without control characters, Latin-1 letters). Pieces with
# any other character are encoded by the library as they stand.
SIMPLE = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = re.compile(rf"{SHORT}| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"{SHORT}|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+")
# Kinds of bytes that a cut may stand between. The second byte of a Latin-1
# letter is set to ALPHA where it occurs.
OTHER, ALPHA, MARK, QUOTE, SPACE, BREAK = range(6)
KIND = np.zeros(256, dtype=np.int8)
KIND[0x21:0x7F] = MARK
KIND[0x30:0x3A] = OTHER  # digits
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = ALPHA
KIND[0x27], KIND[0x20], KIND[0x0A] = QUOTE, SPACE, BREAK


def byte_letters() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class TextEncoder:
    """Ids as little-endian ``dtype``; special strings in a text get their ids, as
    the library does by default. Null counts as empty."""

    def __init__(self, path: str, max_pieces: int = 120_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.special_bytes = re.compile(self.special.pattern.encode())
        self.special_starts = {t["content"][:2].encode() for t in spec["added_tokens"]}
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind, self.pattern = "bytes", BYTE_LEVEL
        elif (pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed"
              and pre["pretokenizers"][0].get("invert") and norm and norm.get("type") == "Sequence"
              and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]):
            self.kind, self.pattern = "words", WORD_LEVEL
        if self.kind != "whole" and any(s.isspace() for t in spec["added_tokens"] for s in t["content"]):
            self.kind = "whole"
        self.added = {t["content"] for t in spec["added_tokens"]}
        self.letters = dict(enumerate(byte_letters()))
        self.max_pieces = max_pieces
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one pre-token, by the library's model."""
        got = self.words.get(word)
        if got is None:
            shown = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letters)
            if len(self.words) >= self.max_pieces:
                self.words.clear()
            got = self.words[word] = array(self.code, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return got

    def piece(self, piece: str) -> bytes:
        bare = piece[1:] if piece[:1] == " " else piece
        if bare.isascii() and bare.isalpha():  # one pre-token
            shown = bare.lower() if self.kind == "words" else piece.replace(" ", "\u0120")
            return array(self.code, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        if not SIMPLE.fullmatch(piece) or self.special.search(piece):
            return self.whole(piece)
        word = self.word
        return b"".join([word(w) for w in self.pattern.findall(piece if self.kind == "bytes" else piece.lower())])

    def remembered(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.older.get(piece) or self.piece(piece)
            if len(piece) <= 64:
                if len(self.pieces) >= self.max_pieces:
                    self.older, self.pieces = self.pieces, {}
                self.pieces[piece] = got
        return got

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Piece starts: row starts and places where every such pre-tokenizer cuts."""
        cut = np.zeros(len(raw) + 1, dtype=bool)
        if self.kind != "whole" and len(raw):
            kind = KIND[raw]
            kind[1:][(raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)] = ALPHA
            before, after = kind[:-1], kind[1:]
            seen = (before == ALPHA) | (before == MARK) | (before == QUOTE)
            shown = (after == ALPHA) | (raw[1:] == 0xC3) | (after == MARK) | (after == QUOTE)
            cut[1:-1] = seen & ((after == SPACE) | (after == BREAK))
            cut[1:-1] |= (before == ALPHA) & ((after == MARK) | (after == QUOTE)) | (before == MARK) & ((after == ALPHA) | (raw[1:] == 0xC3) & (after != OTHER))
            # a single line break between visible characters
            cut[2:-1] |= seen[:-1] & (before[1:] == BREAK) & shown[1:]
            data = raw.tobytes()
            if any(start in data for start in self.special_starts):
                for m in self.special_bytes.finditer(data):
                    cut[m.start() + 1:m.end()] = False
        cut[offsets[:-1]] = True
        return np.flatnonzero(cut[:-1])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a string column (null as empty) and the row offsets into them."""
        raw, offsets = text_bytes(column)
        starts = self.cuts(raw, offsets)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        found = [self.remembered(p) for p in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(found), self.dtype)
        lengths = sizes[codes]
        ids = flat[spread_ranges((np.cumsum(sizes) - sizes)[codes], lengths)]
        before = np.concatenate(([0], np.cumsum(lengths)))
        return ids, before[np.searchsorted(starts, offsets)]


class SpanEncoder:
    """Tokens of whole texts with the characters they come from."""

    def __init__(self, path: str, max_pieces: int = 120_000):
        self.encoder = TextEncoder(path, max_pieces)
        self.sizes: dict[str, bytes] = {}
        self.max_pieces = max_pieces

    def token_bytes(self, piece: str) -> bytes:
        """Bytes of text that each token of a piece stands for; byte-level vocabularies
        write one character per byte."""
        got = self.sizes.get(piece)
        if got is None:
            enc = self.encoder
            if SIMPLE.fullmatch(piece) and not enc.special.search(piece):
                shown = (w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(enc.letters) for w in enc.pattern.findall(piece))
                sizes = [len(t.value) for w in shown for t in enc.tokenizer.model.tokenize(w)]
            else:
                sizes = [len(t) if t not in enc.added else len(t.encode()) for t in enc.tokenizer.encode(piece, add_special_tokens=False).tokens]
            got = array("I", sizes).tobytes()
            if len(piece) <= 64:
                if len(self.sizes) >= self.max_pieces:
                    self.sizes.clear()
                self.sizes[piece] = got
        return got

    def spans(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, last character, row bounds): characters are numbered within
        their row; a token of part of a character counts as that character."""
        if self.encoder.kind != "bytes":
            return self.whole_spans(column)
        raw, offsets = text_bytes(column)
        starts = self.encoder.cuts(raw, offsets)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(offsets), np.int64)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        found = [self.token_bytes(p) for p in coded.dictionary.to_pylist()]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        lengths = counts[codes]
        sizes = flat[spread_ranges((np.cumsum(counts) - counts)[codes], lengths)].astype(np.int64)
        ends = np.cumsum(sizes)
        number = np.cumsum((raw & 0xC0) != 0x80) - 1  # character number of each byte
        tokens = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, offsets)]
        base = np.zeros(len(offsets) - 1, np.int64)
        filled = np.diff(offsets) > 0
        base[filled] = number[offsets[:-1][filled]]
        base = np.repeat(base, np.diff(tokens))
        return number[ends - sizes] - base, number[ends - 1] - base, tokens

    def whole_spans(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, bounds = [], [0]
        for text in column.to_pylist():
            pairs += [(a, max(a, b - 1)) for a, b in self.encoder.tokenizer.encode(text or "", add_special_tokens=False).offsets]
            bounds.append(len(pairs))
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1], np.array(bounds)


_ENCODERS: dict[str, TextEncoder] = {}


def encoder_of(path: str) -> TextEncoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
