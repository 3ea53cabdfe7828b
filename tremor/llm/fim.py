"""Fill-in-middle transformation over seekable compressed frames.

A text is a sequence of units: runs of ASCII letters, and every other character
on its own. ``write_frames`` stores each text as independent zstandard frames of
a bounded size; beside them stand the units, characters and bytes before every
frame. A cut after any number of units is found by a search in these counts and
by opening the one frame that holds it; a unit belongs to the frame that it
begins in, so runs of letters may be longer than a frame.

Each document is cut twice. Form ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>``
middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` the text
itself. Cuts and form follow from a hash of the key. Outputs and digests are streamed
frame by frame: ``digests`` holds one open frame of a document at a time. The
restored text is read back from the output: its marks are searched there and the parts
between them put in order.

Null texts count as empty; empty texts and texts that hold a mark stay plain. A null
key is hashed as an empty string. Repeated rows are documents of their own with equal
results, an empty table gives no rows, other columns do not matter (a text column may
have any name). Texts may be of any length that a row holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import scratch, text_bytes, text_slices

FRAME_BYTES = 64 << 10  # of text in a frame
LEVEL = 3  # of compression
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # percent
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
LATER = np.zeros(256, dtype=bool)  # bytes of a character after its first
LATER[0x80:0xC0] = True

FRAMES = ("marked boolean, ends array<long>, units array<long>, chars array<long>, bytes array<long>, inside array<boolean>, payload binary")


def unit_starts(raw: np.ndarray, inside: bool = False) -> np.ndarray:
    """Flags of the bytes that units begin at; ``inside``: the byte before was a letter of the same text."""
    letter = LETTER[raw]
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = inside
        before[1:] = letter[:-1]
    return np.where(letter, ~before, ~LATER[raw])


def frame_cuts(raw: np.ndarray, size: int) -> list[int]:
    """Ends of the frames of a text: every ``size`` bytes, moved back to the beginning of a character."""
    cuts, at = [], 0
    while len(raw) - at > size:
        end = at + size
        while end > at and LATER[raw[end]]:
            end -= 1
        if end == at:  # a character longer than a frame
            end += 1
            while end < len(raw) and LATER[raw[end]]:
                end += 1
        cuts.append(end)
        at = end
    return cuts if cuts and at == len(raw) else [*cuts, len(raw)]


def frame_row(raw: np.ndarray, size: int, pack: zstandard.ZstdCompressor) -> tuple:
    """(marked, payload ends, units, characters and bytes before each frame and in all, inside flags, payload)."""
    data = raw.tobytes()
    ends, units, chars, sizes, inside, out = [], [0], [0], [0], [], []
    held, at = 0, 0
    for end in frame_cuts(raw, size):
        part = raw[at:end]
        going = at > 0 and bool(LETTER[raw[at - 1]])
        packed = pack.compress(data[at:end])
        held += len(packed)
        out.append(packed)
        ends.append(held)
        inside.append(going)
        units.append(units[-1] + int(unit_starts(part, going).sum()))
        chars.append(chars[-1] + len(part) - int(LATER[part].sum()))
        sizes.append(end)
        at = end
    return any(m in data for m in (PREFIX, SUFFIX, MIDDLE)), ends, units, chars, sizes, inside, b"".join(out)


def write_frames(spark: SparkSession, docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text",
                 frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per document under ``path``: key and its frames with their counts (``units`` and the like
    have one entry more than there are frames, the last one is the whole text's)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = [pa.bool_(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.bool_()), pa.binary()]
    names = ["key", "marked", "ends", "units", "chars", "bytes", "inside", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in text_slices(batch):
                raw, offsets = text_bytes(part.column(1))
                bounds = offsets.tolist()
                made = [frame_row(raw[a:b], frame_bytes, pack) for a, b in zip(bounds, bounds[1:], strict=False)]
                columns = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    kind = docs.schema[key].dataType.simpleString()
    frames = rows.mapInArrow(run, f"key {kind}, {FRAMES}")
    frames.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(frames.schema).parquet(path)


class Text:
    """A stored text; one frame is open at a time."""

    def __init__(self, ends, units, chars, sizes, inside, payload, unpack: zstandard.ZstdDecompressor):
        self.ends, self.units, self.chars, self.sizes, self.inside = ends, units, chars, sizes, inside
        self.payload, self.unpack, self.open = payload, unpack, (-1, b"")

    def frame(self, n: int) -> bytes:
        if self.open[0] != n:
            self.open = n, self.unpack.decompress(self.payload[self.ends[n - 1] if n else 0:self.ends[n]])
        return self.open[1]

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, characters) of the first ``unit`` units."""
        if unit >= self.units[-1]:
            return self.sizes[-1], self.chars[-1]
        n = int(np.searchsorted(self.units, unit, side="right")) - 1
        raw = np.frombuffer(self.frame(n), np.uint8)
        place = int(np.flatnonzero(unit_starts(raw, self.inside[n]))[unit - self.units[n]])
        return self.sizes[n] + place, self.chars[n] + place - int(LATER[raw[:place]].sum())

    def read(self, low: int, high: int) -> Iterator[bytes]:
        """The bytes from ``low`` to ``high``, frame by frame."""
        if low >= high:
            return
        for n in range(int(np.searchsorted(self.sizes, low, side="right")) - 1, len(self.ends)):
            first = self.sizes[n]
            if first >= high:
                return
            yield self.frame(n)[max(low - first, 0):high - first]


class Output:
    """The output of a document as marks and byte ranges of its text; nothing is copied."""

    def __init__(self, text: Text, form: str, first: int, second: int):
        end = text.sizes[-1]
        prefix, middle, suffix = (0, first), (first, second), (second, end)
        order = {"plain": ((b"", (0, end)),), "psm": ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)),
                 "spm": ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))}[form]
        self.text, self.pieces = text, order

    def read(self, low: int = 0, high: int | None = None) -> Iterator[bytes]:
        """The bytes of the output from ``low`` to ``high``."""
        at = 0
        for mark, (a, b) in self.pieces:
            for size, part in ((len(mark), None), (b - a, a)):
                lo, hi = max(low - at, 0), size if high is None else min(high - at, size)
                if lo < hi:
                    if part is None:
                        yield mark[lo:hi]
                    else:
                        yield from self.text.read(part + lo, part + hi)
                at += size


def marks_in(chunks: Iterator[bytes]) -> dict[bytes, int]:
    """Where each mark stands first in a stream."""
    found, tail, at = {}, b"", 0
    for chunk in chunks:
        joined = tail + chunk
        for mark in (PREFIX, SUFFIX, MIDDLE):
            if mark not in found and (place := joined.find(mark)) >= 0:
                found[mark] = at - len(tail) + place
        at += len(chunk)
        tail = joined[-2:]
    return found


def restored(output: Output, form: str) -> Iterator[bytes]:
    """The text from an output and its form: the parts between the marks, in order."""
    if form == "plain":
        yield from output.read()
        return
    place = marks_in(output.read())
    last = place[MIDDLE]
    prefix, suffix = ((place[PREFIX] + 3, place[SUFFIX]), (place[SUFFIX] + 3, last)) if form == "psm" else ((place[PREFIX] + 3, last), (place[SUFFIX] + 3, place[PREFIX]))
    yield from output.read(*prefix)
    yield from output.read(last + 3)
    yield from output.read(*suffix)


def restore(output: str, form: str) -> str:
    """The text of an output held in memory."""
    data = output.encode("utf-8", "surrogatepass")
    whole = Text([0], [0, 0], [0, 0], [0, len(data)], [False], b"", None)
    whole.open = 0, data
    return b"".join(restored(Output(whole, "plain", 0, 0), form)).decode("utf-8", "surrogatepass")


def digest(chunks: Iterator[bytes]) -> str:
    total = hashlib.sha256()
    for chunk in chunks:
        total.update(chunk)
    return total.hexdigest()


def planned(frames: DataFrame, salt: str) -> DataFrame:
    """The frames with ``n``, ``form`` and the two cuts (in units) of each document."""
    code = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    known = frames.withColumn("n", F.element_at("units", -1)).withColumn("code", code)
    part = lambda k: F.conv(F.substring("code", 8 * k + 1, 8), 16, 10).cast("long")
    a, b = part(0) % (F.col("n") + 1), part(1) % (F.col("n") + 1)
    plain: Column = (F.col("n") == 0) | F.col("marked") | (part(2) % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(part(3) % 100 < SPM_BELOW, "spm").otherwise("psm")
    return known.select("key", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"),
                        "ends", "units", "chars", "bytes", "inside", "payload")


def over_outputs(frames: DataFrame, salt: str, extra: str, kinds: list[pa.DataType], make) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars and what ``make`` (output, form) gives, for every document."""
    names = ["key", "n", "form", "prefix_chars", "middle_chars", *(c.split(" ")[0] for c in extra.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for at in range(batch.num_rows):  # one stored text at a time
                n, form, first, second, *stored_ = (batch.column(c)[at].as_py() for c in range(1, batch.num_columns))
                text = Text(*stored_, unpack)
                (a, chars), (b, later) = (text.cut(first), text.cut(second)) if form != "plain" else ((0, 0), (0, 0))
                sizes = (None, None) if form == "plain" else (chars, later - chars)
                out.append((n, form, *sizes, *make(Output(text, form, a, b), form)))
            columns = list(zip(*out, strict=True)) if out else [()] * (len(names) - 1)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names=names)

    kind = frames.schema["key"].dataType.simpleString()
    return planned(frames, salt).mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, {extra}")


def digests(frames: DataFrame, *, key: str = "doc_id", salt: str = "1") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, streamed from the frames."""
    made = over_outputs(frames, salt, "output_sha256 string, restored_sha256 string", [pa.string()] * 2,
                        lambda output, form: (digest(output.read()), digest(restored(output, form))))
    return made.withColumnRenamed("key", key)


def outputs(frames: DataFrame, *, key: str = "doc_id", salt: str = "1") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars and the whole ``output`` text."""
    made = over_outputs(frames, salt, "output string", [pa.string()], lambda output, form: (b"".join(output.read()).decode(),))
    return made.withColumnRenamed("key", key)


def fill_in_middle(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", salt: str = "1",
                   path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(digests, outputs) of every document; the frames are kept under ``path``."""
    path = path or scratch(spark, "fim")
    frames = write_frames(spark, docs, f"{path}/frames", key=key, text=text)
    return digests(frames, key=key, salt=salt), outputs(frames, key=key, salt=salt)
