"""Whether an image file can be decoded, from its container.

A PNG is walked chunk by chunk with its checksums, and its pixels are unpacked in
small steps and counted; a JPEG is walked marker by marker to the end mark. Nothing is
copied: both work on a view of the file's bytes.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# --- fixed values of the formats --------------------------------------------------
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by colour type
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))  # x, y, step x, step y
JPEG_START = b"\xff\xd8"
JPEG_ALONE = {0x01, *range(0xD0, 0xD8)}  # markers without a length
JPEG_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
# ----------------------------------------------------------------------------------
NEXT_MARKER = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
STEP = 1 << 16  # bytes unpacked at once


def png_bytes(width: int, height: int, bits: int, colour: int, interlaced: bool) -> int:
    """Bytes of the unpacked pixels, a filter byte for each line."""
    total = 0
    for x, y, dx, dy in PNG_PASSES if interlaced else ((0, 0, 1, 1),):
        columns, lines = -(-(width - x) // dx), -(-(height - y) // dy)
        if columns > 0 and lines > 0:
            total += lines * (1 + -(-columns * bits * PNG_CHANNELS[colour] // 8))
    return total


def png_fault(data: memoryview) -> str | None:
    """Why a PNG cannot be decoded, or None."""
    at, needed, unpacked, pixels = len(PNG_SIGNATURE), None, 0, zlib.decompressobj()
    while True:
        if at + 12 > len(data):
            return "truncated"
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            return "truncated"
        body = data[at + 8:at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            return "wrong checksum"
        at += 12 + size
        if needed is None:
            if kind != b"IHDR" or size != 13:
                return "no header"
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if not width or not height or colour not in PNG_CHANNELS:
                return "no header"
            needed = png_bytes(width, height, bits, colour, bool(interlaced))
        elif kind == b"IDAT":
            try:
                got = pixels.decompress(body, STEP)
                while got:
                    unpacked += len(got)
                    got = pixels.decompress(pixels.unconsumed_tail, STEP) if unpacked < needed else b""
            except zlib.error:
                return "bad pixels"
        elif kind == b"IEND":
            return None if unpacked >= needed else "pixels missing"


def jpeg_fault(data: memoryview) -> str | None:
    """Why a JPEG cannot be decoded, or None."""
    at, framed, scanned = 2, False, False
    while True:
        if at + 2 > len(data):
            return "truncated"
        if data[at] != 0xFF:
            return "bad marker"
        while at + 1 < len(data) and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if at + 2 > len(data):
            return "truncated"
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            return None if framed and scanned else "no picture"
        if marker in JPEG_ALONE:
            continue
        if at + 2 > len(data):
            return "truncated"
        size = struct.unpack_from(">H", data, at)[0]
        if size < 2 or at + size > len(data):
            return "truncated"
        if marker in JPEG_FRAMES:
            framed = size >= 8 and struct.unpack_from(">H", data, at + 5)[0] > 0
        at += size
        if marker == 0xDA:  # the picture's bytes go on to the next marker
            scanned = True
            found = NEXT_MARKER.search(data, at)
            if not found:
                return "truncated"
            at = found.end() - 2


def image_fault(content: bytes | None) -> tuple[str | None, str | None]:
    """(format, fault) of a file's bytes: ``png`` or ``jpeg``, and None if it can be decoded."""
    data = memoryview(content or b"")
    if data[:8] == PNG_SIGNATURE:
        return "png", png_fault(data)
    if data[:2] == JPEG_START:
        return "jpeg", jpeg_fault(data)
    return None, "unknown format" if len(data) else "empty"


def verify_images(files: DataFrame) -> DataFrame:
    """``files`` (..., content) without the content, with ``format`` and ``fault`` (null: the image can be decoded)."""
    kept = [c for c in files.columns if c != "content"]
    at = files.columns.index("content")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [image_fault(batch.column(at)[n].as_py()) for n in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([f for f, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())],
                                             names=[*kept, "format", "fault"])

    return files.mapInArrow(run, f"{kinds}, format string, fault string")
