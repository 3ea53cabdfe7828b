"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of ASCII digits, a-z and non-ASCII characters after lower-casing
A-Z; null has none. The index is cut by documents: each segment (a few MB of
text) is one row with its terms, their postings (word positions in the segment)
and its documents. Test items are asked in blocks of bounded size, so what is
sent to the executors does not grow with either table.

A window is ``width`` consecutive words of an item; an item of fewer words, but
not none, is one window. Its terms are ordered by their number of postings in
the whole corpus. In each segment the postings of the rarest term, less its offset, are
the first candidates; the lists of the other terms, less theirs, are
intersected in that order. An exact match has all words in their places; a
proximity match has every word within ``slop`` words of its place as seen from
the rarest one. Windows never cross documents.

Ties and repeated rows are independent documents; null keys and item ids are
values like others (a null item id is written as an empty string). Empty tables give
no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm.common import LOWER_A_Z, batch_rows, keep_rows, packed_strings, scratch, spread_ranges, stored, text_bytes, text_hash, text_slices, words_of

WIDTH, SLOP = 10, 2
BLOCK_WINDOWS = 100_000  # test windows asked at once
SEGMENT_BYTES = 4 << 20  # text of a segment
# Rows of the index have MBs: Parquet looks at the size of a row group only every hundred rows, and Spark reads as
# many rows at once as the row group has (4,096 at most). So a segment is a row group of its own.
INDEX_FILES = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.row.count.limit": "1"}
CANDIDATES = 1 << 20  # candidates held at once in a task
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = True
WORD[0x61:0x7B] = True
WORD[0x80:] = True
INDEX = ("segment long, keys array<long>, hashes array<long>, sizes array<int>, term_ends binary, term_bytes binary, counts binary, steps binary")


def words_in(column: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All words of a string column and how many each row has."""
    raw, offsets = text_bytes(column)
    low = LOWER_A_Z[raw]
    starts, ends, rows = words_of(low, offsets, WORD)
    return packed_strings(low, starts, ends), np.bincount(rows, minlength=len(offsets) - 1)


def build_index(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of all documents, stored under ``path``."""
    rows = docs.select(F.col(key).cast("long").alias("key"), text_hash(text).alias("text_hash"), F.col(text).alias("text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, limit=SEGMENT_BYTES):
                words, sizes = words_in(part.column(2))
                coded = words.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                terms = coded.dictionary
                positions = np.argsort(codes, kind="stable").astype(np.int32)
                counts = np.bincount(codes, minlength=len(terms)).astype(np.int32)
                raw, ends = text_bytes(terms)
                steps = np.diff(positions, prepend=np.int32(0))
                row = {"segment": [number], "keys": [part.column(0).to_pylist()], "hashes": [part.column(1).to_pylist()], "sizes": [sizes.tolist()],
                       "term_ends": [ends.astype(np.int32).tobytes()], "term_bytes": [raw.tobytes()], "counts": [counts.tobytes()], "steps": [steps.tobytes()]}
                number += 1
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

    made = rows.mapInArrow(segments, INDEX)
    made.write.options(**INDEX_FILES).parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


class Block:
    """Distinct windows of some items: rows of term numbers by length, and the items of each."""

    def __init__(self, windows: dict[tuple[str, ...], set]):
        terms = sorted({w for window in windows for w in window})
        self.terms = pa.array(terms, pa.string())
        number = {t: i for i, t in enumerate(terms)}
        self.by_length: dict[int, tuple[np.ndarray, list[list]]] = {}
        for window, items in windows.items():
            rows, owners = self.by_length.setdefault(len(window), ([], []))
            rows.append([number[t] for t in window])
            owners.append(sorted(items, key=str))
        self.by_length = {n: (np.array(rows, np.int64), owners) for n, (rows, owners) in self.by_length.items()}

    def rarest_first(self, totals: np.ndarray) -> None:
        """Drop windows with a term the corpus lacks; order the places of the others by rarity."""
        self.plans = []
        for rows, owners in self.by_length.values():
            possible = (totals[rows] > 0).all(axis=1)
            rows, owners = rows[possible], [o for o, p in zip(owners, possible, strict=True) if p]
            if len(rows):
                self.plans.append((rows, np.argsort(totals[rows], axis=1, kind="stable"), owners))


def item_blocks(benchmark: DataFrame, item: str, text: str, width: int, limit: int) -> Iterator[Block]:
    """The windows of all items in blocks of at most ``limit`` (window, item) pairs; a window that
    many items share may come in several blocks."""
    windows: dict[tuple[str, ...], set] = {}
    held = 0
    for item_id, content in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        words = words_in(pa.array([content], pa.string()))[0].to_pylist()
        for at in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[at:at + width]), set()).add(item_id or "")
            held += 1
            if held >= limit:
                yield Block(windows)
                windows, held = {}, 0
    if windows:
        yield Block(windows)


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of the index, one at a time: only one is held as Python objects."""
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch.slice(n, 1).to_pylist()[0]


class Segment:
    """One row of the index."""

    def __init__(self, row: dict, asked: pa.Array):
        ends = np.frombuffer(row["term_ends"], np.int32)
        terms = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(row["term_ends"]), pa.py_buffer(row["term_bytes"]))
        self.counts = np.frombuffer(row["counts"], np.int32)
        # the segment's number of each asked term, -1 if it lacks it
        found = pc.index_in(terms, value_set=asked).to_numpy(zero_copy_only=False)
        here = np.flatnonzero(~np.isnan(found)) if found.dtype.kind == "f" else np.arange(len(found))
        self.code = np.full(len(asked), -1, np.int64)
        self.code[found[here].astype(np.int64)] = here

    def open(self, row: dict) -> None:
        """Unpack postings; ``places`` is (term, position) in one sorted array."""
        positions = np.cumsum(np.frombuffer(row["steps"], np.int32), dtype=np.int64)
        self.places = np.repeat(np.arange(len(self.counts), dtype=np.int64) << 32, self.counts) + positions
        self.first = np.cumsum(self.counts, dtype=np.int64) - self.counts
        self.bounds = np.concatenate(([0], np.cumsum(np.asarray(row["sizes"], np.int64))))

    def holds(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the postings of each term have a position from low to high."""
        at = np.searchsorted(self.places, (codes << 32) + np.maximum(low, 0))
        return (at < len(self.places)) & (self.places[np.minimum(at, len(self.places) - 1)] <= (codes << 32) + high)

    def matches(self, rows: np.ndarray, order: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, document, first word's position, exact) of all windows of one length.

        The document is that of the anchor; its words only count. A proximity match may begin before or
        end behind it where words of the window are missing there.
        """
        width = rows.shape[1]
        here = np.flatnonzero((self.code[rows] >= 0).all(axis=1))
        if not len(here):
            return
        codes = self.code[rows[here]]
        order = order[here]
        anchors = codes[np.arange(len(here)), order[:, 0]]
        sizes = self.counts[anchors].astype(np.int64)
        total = np.cumsum(sizes)
        starts = [0, *np.flatnonzero(np.diff(total // CANDIDATES)) + 1, len(here)]
        for a, b in zip(starts, starts[1:], strict=False):
            window = np.repeat(np.arange(a, b), sizes[a:b])
            taken = spread_ranges(self.first[anchors[a:b]], sizes[a:b])
            for c in range(0, len(window), CANDIDATES):
                w = window[c:c + CANDIDATES]
                at = self.places[taken[c:c + CANDIDATES]] & 0xFFFFFFFF
                doc = np.searchsorted(self.bounds, at, side="right") - 1
                low, high = self.bounds[doc], self.bounds[doc + 1]
                at = at - order[w, 0]
                exact = (at >= low) & (at + width <= high)
                if not slop:
                    w, at, doc, low, high, exact = (x[exact] for x in (w, at, doc, low, high, exact))
                for k in range(1, width):
                    place = order[w, k]
                    term = codes[w, place]
                    exact &= self.holds(term, at + place, at + place)
                    near = exact | self.holds(term, np.maximum(at + place - slop, low), np.minimum(at + place + slop, high - 1)) if slop else exact
                    w, at, doc, low, high, exact = (x[near] for x in (w, at, doc, low, high, exact))
                    if not len(w):
                        break
                if len(w):
                    yield here[w], doc, at, exact


def merged(doc: np.ndarray, item: np.ndarray, exact: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping word ranges of the same document and item joined into one."""
    order = np.lexsort((high, low, exact, item, doc))
    doc, item, exact, low, high = (x[order] for x in (doc, item, exact, low, high))
    group = np.concatenate(([0], np.cumsum((np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(exact) != 0))))
    lift = group * (int(high.max()) + 1)  # separates the groups, so one running maximum serves all
    reach = np.maximum.accumulate(high + lift)
    new = np.concatenate(([True], low[1:] + lift[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    return doc[first], item[first], exact[first], low[first], (reach - lift)[last]


def term_totals(index: DataFrame, asked: pa.Array) -> np.ndarray:
    """Postings of each asked term in the whole corpus."""
    terms = asked

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for row in single_rows(batches):
            segment = Segment(row, terms)
            has = segment.code >= 0
            total[has] += segment.counts[segment.code[has]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    found = index.select("term_ends", "term_bytes", "counts").mapInArrow(count, "term long, n long").groupBy("term").sum("n").collect()
    out = np.zeros(len(terms), np.int64)
    for term, n in found:  # no more rows than the block has terms
        out[term] = n
    return out


def find_items(index: DataFrame, block: Block, slop: int) -> DataFrame:
    """(segment, ord, item, exact, low, high): word ranges of documents covered by windows of an item."""
    names = sorted({o for _, _, owners in block.plans for list_ in owners for o in list_})
    number = {n: i for i, n in enumerate(names)}
    plans = []
    for rows, order, owners in block.plans:
        sizes = np.array([len(o) for o in owners], np.int64)
        plans.append((rows, order, np.array([number[o] for list_ in owners for o in list_], np.int64), np.cumsum(sizes) - sizes, sizes))
    shared = index.sparkSession.sparkContext.broadcast((block.terms, plans, names))  # bounded by the block

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, asked, named = shared.value
        for row in single_rows(batches):
            segment, opened, hits = Segment(row, terms), False, []
            for rows, order, owner, first, sizes in asked:
                if not opened and (segment.code[rows] >= 0).all(axis=1).any():
                    segment.open(row)
                    opened = True
                if not opened:
                    continue
                for window, doc, at, exact in segment.matches(rows, order, slop):
                    n = sizes[window]
                    item = owner[spread_ranges(first[window], n)]
                    doc, at, exact = np.repeat(doc, n), np.repeat(at, n), np.repeat(exact, n)
                    begin, end = segment.bounds[doc], segment.bounds[doc + 1]
                    hits.append(merged(doc, item, exact.astype(np.int8), np.maximum(at, begin) - begin, np.minimum(at + rows.shape[1], end) - begin))
            if hits:
                doc, item, exact, low, high = merged(*(np.concatenate(x) for x in zip(*hits, strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), row["segment"])), pa.array(doc.astype(np.int32)), pa.array([named[i] for i in item], pa.string()),
                     pa.array(exact.astype(bool)), pa.array(low), pa.array(high)], names=["segment", "ord", "item", "exact", "low", "high"])

    return index.select("segment", "sizes", "term_ends", "term_bytes", "counts", "steps").mapInArrow(find, "segment long, ord int, item string, exact boolean, low long, high long")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", width: int = WIDTH, slop: int = SLOP, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per document, matches).

    Documents: key, text_hash, n_words, n_hit (words inside any exact occurrence), items (sorted
    ids with exact occurrences), near_items (with proximity matches only). Matches: key, item,
    exact, low, high (word range).
    """
    path = path or scratch(spark, "decontaminate")
    with batch_rows(spark, 8):
        index = build_index_rows(spark, docs, path, key, text)
        found = None
        for n, block in enumerate(item_blocks(benchmark, item, item_text, width, BLOCK_WINDOWS)):
            block.rarest_first(term_totals(index, block.terms))
            if block.plans:
                part = stored(find_items(index, block, slop), f"{path}/hits{n}")
                found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "segment long, ord int, item string, exact boolean, low long, high long")
    listed = index.select("segment", F.posexplode(F.arrays_zip("keys", "hashes", "sizes")).alias("ord", "d"))
    everyone = listed.select("segment", "ord", F.col("d.keys").alias("key"), F.col("d.hashes").alias("text_hash"), F.col("d.sizes").cast("long").alias("n_words"))
    before = F.max("high").over(W.partitionBy("segment", "ord").orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1))
    covered = (found.filter("exact").select("segment", "ord", "low", "high", before.alias("before"))
               .groupBy("segment", "ord").agg(F.sum(F.greatest(F.col("high") - F.greatest("low", F.coalesce("before", "low")), F.lit(0))).alias("n_hit")))
    items = found.groupBy("segment", "ord").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"),
                                                F.array_sort(F.collect_set("item")).alias("every"))
    none = F.array().cast("array<string>")
    result = (everyone.join(items, ["segment", "ord"], "left").join(covered, ["segment", "ord"], "left")
              .select(F.col("key").alias(key), "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", none).alias("items"), F.coalesce(F.array_except("every", "items"), none).alias("near_items")))
    matches = found.join(everyone, ["segment", "ord"]).select(F.col("key").alias(key), "item", "exact", "low", "high")
    return result, matches


def build_index_rows(spark: SparkSession, docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    with batch_rows(spark, 2000):
        return build_index(docs, f"{path}/index", key=key, text=text)


def remove_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any exact occurrence of a test window, with all their columns."""
    found, _ = decontaminate(spark, docs, benchmark, key=key, text=text)
    return keep_rows(docs, found.filter("n_hit > 0").select(key, "text_hash"), key, text, "left_anti")
