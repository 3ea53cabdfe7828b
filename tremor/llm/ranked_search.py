"""Ranked lexical search by the Best Position Algorithm.

Terms are runs of ASCII digits, a-z and non-ASCII characters after lower-casing A-Z;
null has none. The index is cut by documents: a segment (an Arrow batch of some MB of
text) is one row with its documents' sizes, its terms and their postings. All items
are asked of all segments, in blocks of bounded size.

In a segment each term asked for has an impact list: its documents by falling impact.
For an item the lists are read in parallel, a few entries past the best position of each. A
document met for the first time is looked up in all lists of the item at once (direct
access by a table of list positions); that gives its score and marks its places as seen. The
best position of a list is the end of its unbroken seen beginning. No document yet unseen
can score more than the weighted impacts just behind the best positions; reading stops when
this sum is strictly below the k-th best score so far, so ties are complete. The k-th score goes
along from segment to segment of a task, and a segment whose first impacts stay below it
is not read at all. The tasks' answers, k at most for each item, are ranked by Spark.

Scores are whole numbers of 64 bits; counts for the weights cover all documents with a
term. Ties go to the smaller key (null keys last); repeated documents are ranked each, repeated
items are answered each. Null and empty items have no answers, nor has an empty table. Extra
columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm.common import LOWER_A_Z, batch_rows, packed_strings, scratch, spread_ranges, stored, text_bytes, text_slices, words_of

TOP = 10
SEGMENT_BYTES = 8 << 20  # text of a segment
BLOCK_TERMS = 20_000  # (item, term) pairs asked at once; an item of more is a block of its own
READ_FIRST = 16  # entries of each list read in the first round, doubled each round
B = 75  # percent of the length norm
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = True
WORD[0x80:] = True


def terms_in(column: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of a string column and the row of each."""
    raw, offsets = text_bytes(column)
    low = LOWER_A_Z[raw]
    starts, ends, rows = words_of(low, offsets, WORD)
    return packed_strings(low, starts, ends), rows


def counted(column: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, term, row and number of each posting by term and row, terms of each row)."""
    words, rows = terms_in(column)
    coded = words.dictionary_encode()
    pairs, times = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(column), 1) + rows, return_counts=True)
    return coded.dictionary, pairs // max(len(column), 1), pairs % max(len(column), 1), times, np.bincount(rows, minlength=len(column))


def build_index(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents with a term or without, stored under ``path``."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, limit=SEGMENT_BYTES):
                terms, term, row, times, sizes = counted(part.column(1))
                raw, ends = text_bytes(terms)
                column = part.column(0)
                keys = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                binary = [ends.astype(np.int32), raw, np.bincount(term, minlength=len(terms)).astype(np.int32), row.astype(np.int32), times.astype(np.int32), sizes.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), keys, pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), *(pa.array([x.tobytes()], pa.binary()) for x in binary)],
                    names=["segment", "keys", "n_docs", "n_terms", "term_ends", "term_bytes", "counts", "docs", "times", "sizes"])
                number += 1

    made = rows.mapInArrow(segments, f"segment long, keys array<{kind}>, n_docs long, n_terms long, term_ends binary, term_bytes binary, counts binary, docs binary, times binary, sizes binary")
    made.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item_row, item, terms, times): the distinct terms of every item and how often it has them."""
    kind = items.schema[item].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SEGMENT_BYTES):
                terms, term, row, times, _ = counted(part.column(1))
                order = np.lexsort((term, row))
                bounds = pa.array(np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(bounds, terms.take(pa.array(term[order]))),
                                                  pa.ListArray.from_arrays(bounds, pa.array(times[order].astype(np.int64)))], names=["item", "terms", "times"])

    made = items.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(cut, f"item {kind}, terms array<string>, times array<long>")
    return made.select(F.monotonically_increasing_id().alias("item_row"), "item", "terms", "times")


class Block:
    """Some items: terms by number, and each item's terms with their weights."""

    def __init__(self, rows: list[tuple]):
        self.items = np.array([r[0] for r in rows], np.int64)
        coded = pa.array([t for r in rows for t in r[1]], pa.string()).dictionary_encode()
        self.terms = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.times = np.array([n for r in rows for n in r[2]], np.int64)
        self.bounds = np.cumsum([0, *(len(r[1]) for r in rows)])

    def weigh(self, totals: np.ndarray, n_docs: int) -> None:
        """The weight of a term, floor(1000 ln((2 N + 2) / (2 df + 1))), times its repeats in the item."""
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in totals.tolist()], np.int64)
        self.weights = weight[self.codes] * self.times if len(weight) else self.times


def item_blocks(items: DataFrame, limit: int) -> Iterator[Block]:
    """All items in blocks of about ``limit`` (item, term) pairs, one block at a time on the driver."""
    held: list[tuple] = []
    size = 0
    for row in items.filter(F.size("terms") > 0).select("item_row", "terms", "times").toLocalIterator():
        if held and size + len(row[1]) > limit:
            yield Block(held)
            held, size = [], 0
        held.append(tuple(row))
        size += len(row[1])
    if held:
        yield Block(held)


def terms_of(row: dict) -> pa.StringArray:
    ends = np.frombuffer(row["term_ends"], np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(row["term_ends"]), pa.py_buffer(row["term_bytes"]))


def codes_in(row: dict, asked: pa.StringArray) -> np.ndarray:
    """The segment's number of each asked term, -1 if it lacks it."""
    found = pc.fill_null(pc.index_in(asked, value_set=terms_of(row)), -1)
    return found.to_numpy(zero_copy_only=False).astype(np.int64)


def document_counts(index: DataFrame, asked: pa.StringArray) -> np.ndarray:
    """Documents that hold each asked term, over the whole corpus."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                codes = codes_in(row, asked)
                total[codes >= 0] += np.frombuffer(row["counts"], np.int32)[codes[codes >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(asked), np.int64)
    for term, n in index.select("term_ends", "term_bytes", "counts").mapInArrow(count, "term long, n long").groupBy("term").sum("n").collect():
        out[term] = n  # no more rows than the block has terms
    return out


class Lists:
    """The impact lists of a segment for the terms of a block."""

    def __init__(self, row: dict, asked: pa.StringArray, n_docs: int, n_terms: int):
        codes = codes_in(row, asked)
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        first = np.cumsum(counts) - counts
        here = np.flatnonzero(codes >= 0)
        self.sizes = np.zeros(len(asked), np.int64)  # of each asked term's list
        self.sizes[here] = counts[codes[here]]
        self.first = np.cumsum(self.sizes) - self.sizes
        at = spread_ranges(first[codes[here]], counts[codes[here]])
        term = np.repeat(here, counts[codes[here]])
        doc, times = np.frombuffer(row["docs"], np.int32)[at].astype(np.int64), np.frombuffer(row["times"], np.int32)[at].astype(np.int64)
        sizes, place = np.unique(np.frombuffer(row["sizes"], np.int32), return_inverse=True)
        norm = np.array([100 - B + (B * n * n_docs) // max(n_terms, 1) for n in sizes.tolist()], np.int64)[place]
        impact = (1_000_000_000 * times) // (1000 * times + 8 * norm[doc])
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        # Position of each document in each list, -1 where it is not: asked terms found here by documents.
        self.line = np.full(len(asked), -1, np.int64)
        self.line[here] = np.arange(len(here))
        self.place = np.full((len(here), len(place)), -1, np.int32)
        self.place[self.line[term[order]], self.doc] = np.arange(len(order)) - self.first[term[order]]

    def tops(self) -> np.ndarray:
        """The first impact of each list, 0 for an empty one."""
        out = np.zeros(len(self.sizes), np.int64)
        some = self.sizes > 0
        out[some] = self.impact[self.first[some]]
        return out


class Best:
    """The best answers of an item so far in a task."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """What a document has to reach: the k-th score, or any score above 0."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray, keys: pa.Array) -> None:
        able = np.flatnonzero(scores >= self.least)
        if len(able) > self.k:  # those of the k best and their ties
            able = able[scores[able] >= np.partition(scores[able], len(able) - self.k)[len(able) - self.k]]
        if len(able):
            new = [(s, keys[d].as_py()) for s, d in zip(scores[able].tolist(), docs[able].tolist(), strict=True)]
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1]))[:self.k]


def best_positions(lists: Lists, codes: np.ndarray, weights: np.ndarray, best: Best, keys: pa.Array) -> None:
    """Run the Best Position Algorithm for one item over one segment."""
    some = (lists.sizes[codes] > 0) & (weights > 0)
    codes, weights = codes[some], weights[some]
    first, sizes = lists.first[codes], lists.sizes[codes]
    table = lists.place[lists.line[codes]]
    flat = np.cumsum(sizes) - sizes  # of each list in the flags
    seen = np.zeros(int(sizes.sum()), dtype=bool)
    met = np.zeros(lists.place.shape[1], dtype=bool)
    position, read = np.zeros(len(codes), np.int64), READ_FIRST
    while True:
        going = position < sizes
        bound = int((weights[going] * lists.impact[(first + position)[going]]).sum())
        if bound < best.least:
            return
        upto = np.minimum(position + read, sizes)
        found = lists.doc[spread_ranges(first + position, upto - position)]
        fresh = np.unique(found[~met[found]])
        met[fresh] = True
        places = table[:, fresh]
        line, column = np.nonzero(places >= 0)
        at = places[line, column].astype(np.int64)
        seen[flat[line] + at] = True
        scores = np.zeros(len(fresh), np.int64)
        np.add.at(scores, column, weights[line] * lists.impact[first[line] + at])
        best.add(scores, fresh, keys)
        for n in range(len(codes)):  # to the first entry unseen
            rest = seen[flat[n] + position[n]:flat[n] + sizes[n]]
            gap = int(rest.argmin()) if len(rest) else 0
            position[n] += len(rest) if len(rest) and rest[gap] else gap
        read *= 2


def search_block(index: DataFrame, block: Block, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """(item_row, key, score): at most k rows for each item and task."""
    shared = index.sparkSession.sparkContext.broadcast(block)  # bounded by the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = [Best(k) for _ in asked.items]
        key_type = pa.null()
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in ("term_ends", "term_bytes", "counts", "docs", "times", "sizes")}
                keys = batch.column("keys")[n].values
                key_type = keys.type
                lists = Lists(row, asked.terms, n_docs, n_terms)
                bounds = np.add.reduceat(asked.weights * lists.tops()[asked.codes], asked.bounds[:-1])
                least = np.array([b.least for b in best])
                for i in np.flatnonzero(bounds >= least).tolist():
                    a, b = asked.bounds[i], asked.bounds[i + 1]
                    best_positions(lists, asked.codes[a:b], asked.weights[a:b], best[i], keys)
        rows = [(item, key, score) for item, b in zip(asked.items.tolist(), best, strict=True) for score, key in b.rows]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), key_type, pa.int64()), strict=True)], names=["item_row", "key", "score"])

    return index.select("keys", "term_ends", "term_bytes", "counts", "docs", "times", "sizes").mapInArrow(run, f"item_row long, key {kind}, score long")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = TOP, path: str | None = None) -> DataFrame:
    """(item, rank, key, score): the k documents of the highest scores for every item."""
    path = path or scratch(spark, "search")
    kind = docs.schema[key].dataType.simpleString()
    index = build_index(docs, f"{path}/index", key=key, text=text)
    asked = stored(item_terms(items, item, item_text), f"{path}/items")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    found = None
    with batch_rows(spark, 8):  # rows of the index are wide
        for n, block in enumerate(item_blocks(asked, BLOCK_TERMS)):
            block.weigh(document_counts(index, block.terms), n_docs)
            part = stored(search_block(index, block, n_docs, n_terms, k, kind), f"{path}/found{n}")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"item_row long, key {kind}, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("item_row").orderBy(F.desc("score"), F.col("key").asc_nulls_last()))).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item_row", "item"), "item_row").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
