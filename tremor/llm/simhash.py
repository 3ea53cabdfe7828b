"""SimHash near-duplicates by a binary-trie self-join.

Fingerprint: words are maximal runs of bytes other than space and tab to
carriage return, after lower-casing A-Z; shingles of ``width`` words, repeats
included, joined by one space, are hashed with XXH64 (seed 42); a bit is 1 if
more than half of the hashes have it. A text of fewer words is one shingle; a
text without words has fingerprint zero. Null counts as empty.

Join: two fingerprints within ``max_bits`` differ in at most half of these
bits in one of their 32-bit halves. So the distinct fingerprints form two binary tries, one
with either half on top. Pairs of nodes are walked down together; the bits
they differ in are added up, and a pair is dropped as soon as they exceed
``max_bits // 2`` within the top half or ``max_bits`` below it. The top levels of the walk
deal the node pairs out as units of work; each unit walks its two subtries in
arrays and returns a spanning forest of the links it found, never all pairs.
Components are then contracted over the whole graph.

Repeated rows have equal fingerprints and one component; an empty table gives no rows;
other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import LOWER_A_Z, keep_rows, scratch, spread_ranges, stored, text_bytes, text_hash, text_slices, words_of
from tremor.llm.components import connected_components

SEED = 42
SUBTRIE_ROWS = 32_768  # fingerprints aimed at below one top-level node
PAIR_CHUNK = 1 << 19  # node pairs walked at once
SLICE = 1 << 20  # bytes of text fingerprinted at once
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def fingerprint_column(column: pa.Array, width: int) -> np.ndarray:
    """Fingerprints (uint64) of the texts of an Arrow string column."""
    raw, offsets = text_bytes(column)
    low = LOWER_A_Z[raw]
    starts, ends, rows = words_of(low, offsets, NOT_SPACE)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    places = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    joined[spread_ranges(places, lengths)] = low[spread_ranges(starts, lengths)]
    counts = np.bincount(rows, minlength=len(out))
    firsts = np.cumsum(counts) - counts
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = spread_ranges(firsts, shingles)
    span = np.repeat(np.minimum(counts, width), shingles)
    stop = begin + span - 1
    lo, hi = places[begin].tolist(), (places[stop] + lengths[stop]).tolist()
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(lo, hi, strict=True)), np.uint64, len(lo))
    filled = np.flatnonzero(shingles)
    sizes = shingles[filled]
    edges = np.concatenate(([0], np.cumsum(sizes)))
    step = 1 << 16
    ones = np.zeros((len(filled), 64), np.int64)
    for at in range(0, len(hashes), step):  # bits of a bounded number of hashes at a time
        bits = np.unpackbits(hashes[at:at + step].astype(">u8").view(np.uint8)).reshape(-1, 64)
        a = int(np.searchsorted(edges, at, side="right")) - 1
        b = int(np.searchsorted(edges, min(at + step, len(hashes)), side="left"))
        cuts = np.maximum(edges[a:b] - at, 0)
        ones[a:b] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    out[filled] = np.packbits(ones * 2 > sizes[:, None], axis=1).copy().view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, *, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, fp): fp is the unsigned fingerprint kept in a signed long."""
    rows = docs.select(F.col(key).cast("long").alias("key"), text_hash(text).alias("text_hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                fp = fingerprint_column(part.column(2), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], names=["key", "text_hash", "fp"])

    return rows.mapInArrow(run, "key long, text_hash long, fp long")


class Side:
    """A sorted array seen as a binary trie: the ones of each bit, summed up."""

    def __init__(self, values: np.ndarray):
        self.values, self.sums = values, {}

    def ones(self, level: int) -> np.ndarray:
        if level not in self.sums:
            bit = (self.values >> np.uint64(63 - level)) & np.uint64(1)
            self.sums = {level: np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))}
        return self.sums[level]

    def split(self, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
        """Where the children with a one begin."""
        sums = self.ones(level)
        return hi - (sums[hi] - sums[lo])


def trie_links(a: np.ndarray, b: np.ndarray, same: bool, depth: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked values of two sorted arrays whose members share their first ``depth`` bits.

    ``same``: both arrays are one; each unordered pair comes once.
    """
    left, right = Side(a), Side(b)
    first = np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)])
    distance = int(a[0] >> np.uint64(64 - depth) ^ b[0] >> np.uint64(64 - depth)).bit_count() if depth else 0
    stack = [(depth, *first, np.array([distance]))]
    while stack:
        level, alo, ahi, blo, bhi, err = stack.pop()
        small = (ahi - alo) * (bhi - blo) <= 16
        if level >= 64:
            small[:] = True
        if small.any():  # few members are left: compare them directly
            pairs = (ahi - alo)[small] * (bhi - blo)[small]
            within = spread_ranges(np.zeros(len(pairs), np.int64), pairs)
            wide = np.repeat((bhi - blo)[small], pairs)
            i, j = np.repeat(alo[small], pairs) + within // wide, np.repeat(blo[small], pairs) + within % wide
            ok = np.bitwise_count(a[i] ^ b[j]) <= max_bits
            if same:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok]
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if len(alo) > PAIR_CHUNK:
            half = len(alo) // 2
            stack.append((level, *(x[half:] for x in (alo, ahi, blo, bhi, err))))
            stack.append((level, *(x[:half] for x in (alo, ahi, blo, bhi, err))))
            continue
        am, bm = left.split(alo, ahi, level), right.split(blo, bhi, level)
        budget = max_bits // 2 if level < 32 else max_bits
        twin = same & (alo == blo) & (ahi == bhi)
        kids = [(alo, am, blo, bm, err, None), (am, ahi, bm, bhi, err, None), (alo, am, bm, bhi, err + 1, None), (am, ahi, blo, bm, err + 1, ~twin)]
        parts = []
        for al, ah, bl, bh, e, also in kids:
            ok = (ah > al) & (bh > bl) & (e <= budget)
            if also is not None:
                ok &= also
            parts.append(tuple(x[ok] for x in (al, ah, bl, bh, e)))
        merged = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        if len(merged[0]):
            stack.append((level + 1, *merged))


def join_roots(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member by union of the given index pairs."""
    while True:
        x, y = roots[i], roots[j]
        differ = x != y
        if not differ.any():
            return roots
        i, j = i[differ], j[differ]
        np.minimum.at(roots, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up


def unit_forest(pdf: pd.DataFrame, max_bits: int, depth: int) -> pd.DataFrame:
    """Links of one pair of subtries as a spanning forest (u, v)."""
    half, p, q = (int(pdf[c].iloc[0]) for c in ("half", "a", "b"))
    values = pdf["fp"].to_numpy().view(np.uint64)
    turned = (values << np.uint64(32)) | (values >> np.uint64(32)) if half else values
    turned = np.sort(turned)
    top = (turned >> np.uint64(64 - depth)).astype(np.int64)
    if p == q:
        a = b = turned
        shift = 0
    else:
        a, b = turned[top == p], turned[top == q]
        shift = len(a)
    everything = turned if p == q else np.concatenate((a, b))
    roots = np.arange(len(everything))
    if len(a) and len(b):
        for i, j in trie_links(a, b, p == q, depth, max_bits):
            roots = join_roots(roots, i, j + shift)
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    back = (everything << np.uint64(32)) | (everything >> np.uint64(32)) if half else everything
    return pd.DataFrame({"u": back[moved].view(np.int64), "v": back[roots[moved]].view(np.int64)})


def top_bits(half: str, fp: str, depth: int) -> Column:
    """The first ``depth`` bits of a fingerprint with the given half on top."""
    return F.shiftrightunsigned(F.when(F.col(half) == 0, F.col(fp)).otherwise(F.shiftleft(fp, 32)), 64 - depth)


def top_depth(halves: DataFrame, total: int) -> int:
    """Levels walked by dealing: enough for cells of about SUBTRIE_ROWS, and more while one
    top-level node holds several times that many."""
    depth = min(30, max(4, math.ceil(math.log2(max(2, total) / SUBTRIE_ROWS))))
    while depth < 30:
        largest = halves.groupBy("half", top_bits("half", "fp", depth).alias("p")).count().agg(F.max("count")).first()[0]
        if (largest or 0) <= 4 * SUBTRIE_ROWS:
            break
        depth += 2
    return min(depth, 30)


def linked_components(spark: SparkSession, distinct: DataFrame, path: str, max_bits: int) -> DataFrame:
    """(node, root) of the distinct fingerprints ``fp`` that have a link."""
    total = distinct.count()
    halves = distinct.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    depth = top_depth(halves, total)
    flips = [sum(1 << bit for bit in bits) for k in range(max_bits // 2 + 1) for bits in combinations(range(depth), k)]
    masks = F.array(*[F.lit(m) for m in flips])
    near = halves.withColumn("p", top_bits("half", "fp", depth)).select("fp", "half", "p", F.explode(F.transform(masks, lambda m: F.col("p").bitwiseXOR(m.cast("long")))).alias("q"))
    units = near.select("half", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "fp")
    edges = units.groupBy("half", "a", "b").applyInPandas(lambda pdf: unit_forest(pdf, max_bits, depth), "u long, v long")
    return connected_components(spark, edges, path)


def near_duplicates(spark: SparkSession, docs: DataFrame, *, width: int = 4, max_bits: int = 4, key: str = "doc_id",
                    text: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: key, text_hash, fingerprint, component_id (smallest key of its
    component, null only if all are null), component (a fingerprint that names it)."""
    path = path or scratch(spark, "simhash")
    rows = stored(fingerprints(docs, width=width, key=key, text=text), f"{path}/fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("key").alias("least")), f"{path}/distinct")
    roots = linked_components(spark, distinct.select("fp"), f"{path}/graph", max_bits)
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("component"))
    member = stored(member, f"{path}/members")
    # Written, so that a component of many fingerprints meets it in a join that AQE can split.
    smallest = stored(member.groupBy("component").agg(F.min("least").alias("component_id")), f"{path}/smallest")
    named = member.join(smallest, "component").select("fp", "component", "component_id")
    return (rows.join(named, "fp")
            .select(F.col("key").alias(key), "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component"))


def deduplicate(spark: SparkSession, docs: DataFrame, *, width: int = 4, max_bits: int = 4, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One document of each component stays: the one with the smallest key."""
    found = near_duplicates(spark, docs, width=width, max_bits=max_bits, key=key, text=text)
    kept = found.filter(F.col(key).eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct(key, "text_hash")).alias("one"))
    return keep_rows(docs, kept.select(f"one.{key}", "one.text_hash"), key, text, once=True)
