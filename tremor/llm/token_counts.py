"""Token counts of fields and sections by offset-mapped attribution.

Each document is encoded once as a whole; its sections tile the text in order
and are joined to the token character spans by position. A token that crosses
a boundary is given whole to one section by ``rule``: ``start`` (the section
with its first character), ``end`` (its last character) or ``most`` (the
largest overlap, the earlier one on ties). So the counts of a document's
sections add up to its count.

Null texts count as empty. Empty texts have one section without tokens.
Null keys and repeated rows are counted like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import text_slices
from tremor.llm.encoding import SpanEncoder

RULES = ("start", "end", "most")
_SPANS: dict[str, SpanEncoder] = {}


def line_lengths(text: str | Column) -> Column:
    """Sections are lines; a line break belongs to the line that it ends."""
    lines = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda s, i: F.length(s) + F.when(i < F.size(lines) - 1, 1).otherwise(0))


def field_document(fields: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """(text, section lengths) of several fields put together; a separator belongs to the field before it."""
    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if n < len(fields) - 1 else "")) for n, f in enumerate(fields)]
    return F.concat(*parts), F.array(*[F.length(p) for p in parts])


def attribute(first: np.ndarray, last: np.ndarray, tokens: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) per section. ``ends``: where each section ends in its row;
    ``tokens``, ``sections``: bounds of each row in the two flat lists."""
    rows = np.repeat(np.arange(len(tokens) - 1), np.diff(tokens))
    section_rows = np.repeat(np.arange(len(sections) - 1), np.diff(sections))
    lift = int(max(ends.max(initial=0), last.max(initial=0))) + 2  # rows apart on one line
    line = ends + section_rows * lift
    find = lambda at: np.minimum(np.searchsorted(line, at + rows * lift, side="right"), sections[rows + 1] - 1)
    a, b = find(first), find(last)
    chosen = a if rule == "start" else b
    if rule == "most":
        chosen = a.copy()
        for n in np.flatnonzero(a != b):  # a token rarely crosses
            low = np.maximum(first[n], np.concatenate(([0], ends))[np.arange(a[n], b[n] + 1)] * (np.arange(a[n], b[n] + 1) > sections[rows[n]]))
            chosen[n] = a[n] + int(np.argmax(np.minimum(ends[a[n]:b[n] + 1], last[n] + 1) - low))
    return np.bincount(chosen, minlength=len(ends)), np.bincount(a[a != b], minlength=len(ends))


def count_tokens(docs: DataFrame, *, tokenizer: str, key: str = "doc_id", text: str | Column = "text",
                 lengths: Column | None = None, rule: str = "start") -> DataFrame:
    """One row per section: key, section (from 0), start, length (code points), n_tokens,
    n_crossing (tokens that begin in it and end beyond it)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    content = F.col(text) if isinstance(text, str) else text
    sections = line_lengths(content) if lengths is None else lengths
    rows = docs.select(F.col(key).alias("key"), F.coalesce(content, F.lit("")).alias("text"), sections.cast("array<long>").alias("lengths"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _SPANS.setdefault(tokenizer, SpanEncoder(tokenizer))
        for whole in batches:
            for batch in text_slices(whole, "text"):
                first, last, tokens = spans.spans(batch.column(1))
                listed = batch.column(2)
                bounds = np.asarray(listed.offsets.to_numpy(), np.int64)
                sizes = listed.values.to_numpy(zero_copy_only=False).astype(np.int64)[bounds[0]:bounds[-1]] if len(listed) else np.zeros(0, np.int64)
                bounds = bounds - bounds[0]
                total = np.concatenate(([0], np.cumsum(sizes)))
                starts = total[:-1] - np.repeat(total[bounds[:-1]], np.diff(bounds))
                n, crossing = attribute(first, last, tokens, starts + sizes, bounds, rule)
                offsets = pa.array(bounds.astype(np.int32))
                parts = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (starts, sizes, n, crossing)], names=["start", "length", "n_tokens", "n_crossing"])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, parts)], names=["key", "sections"])

    kind = docs.schema[key].dataType.simpleString()
    counted = rows.mapInArrow(count, f"key {kind}, sections array<struct<start:long,length:long,n_tokens:long,n_crossing:long>>")
    return counted.select(F.col("key").alias(key), F.posexplode("sections").alias("section", "s")).select(key, "section", "s.*")
