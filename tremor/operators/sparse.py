"""Sparse post vectors: hashed character bigrams (E14) and pooling over (event, index, value) rows (V1-V4).

A sparse vector is STRUCT<size INT, indices ARRAY<INT>, values ARRAY<DOUBLE>>, indices ascending. It
stays so up to the pool: values of one (event, index) are added up by partial
aggregation, and only the pooled vector, one per event, is a whole array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"
SEED = 42  # of the hash, as in Spark ML's HashingTF
TOGETHER_CHARS = 1 << 18  # characters worked on at once; a longer text comes in parts
KNOWN_PAIRS = 200_000  # pairs of characters whose hash a task remembers


def murmur3(data: bytes, seed: int = SEED) -> int:
    """MurmurHash3 (x86, 32 bits), signed."""
    full = 0xFFFFFFFF

    def turn(x: int, n: int) -> int:
        return (x << n | x >> (32 - n)) & full

    h = seed
    for at in range(0, len(data), 4):
        word = data[at:at + 4]
        k = turn(int.from_bytes(word, "little") * 0xCC9E2D51 & full, 15) * 0x1B873593 & full
        h ^= k
        if len(word) == 4:
            h = (turn(h, 13) * 5 + 0xE6546B64) & full
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def distinct(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, ascending, place of each value among them) of numbers below ``bound``."""
    if bound > 8 * len(values) + 1024:  # a table of all numbers would be mostly empty
        return np.unique(values, return_inverse=True)
    seen = np.zeros(bound, dtype=bool)
    seen[values] = True
    found = np.flatnonzero(seen)
    place = np.zeros(bound, np.int32)
    place[found] = np.arange(len(found))
    return found, place[values]


def text_parts(texts: list[str], chars: int) -> Iterator[tuple[list[str], list[int]]]:
    """(stretches of the texts, number of each one's text), at most ``chars`` characters at a time and one in
    common between stretches of a text, so that every pair of neighbours is in one of them."""
    parts, rows, held = [], [], 0
    for n, text in enumerate(texts):
        at = 0
        while True:
            part = text[at:at + max(2, chars - held)]
            parts.append(part)
            rows.append(n)
            held += len(part)
            if held >= chars:
                yield parts, rows
                parts, rows, held = [], [], 0
            at += len(part) - 1
            if at + 1 >= len(text):
                break
    if parts:
        yield parts, rows


def bigram_counts(parts: list[str], rows: list[int], texts: int, size: int, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row * size + index, count) of the bigrams in some parts of texts, cells ascending."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter((len(t) for t in parts), np.int64, len(parts))
    part = np.repeat(np.arange(len(parts)), lengths)
    inside = np.flatnonzero(part[1:] == part[:-1])
    chars = np.flatnonzero(np.bincount(codes))  # numbered, so that a pair is a small number
    number = np.zeros(int(chars[-1]) + 1 if len(chars) else 1, np.int64)
    number[chars] = np.arange(len(chars))
    small = number[codes]
    pairs, which = distinct(small[inside] * len(chars) + small[inside + 1], len(chars) ** 2)
    buckets = np.zeros(len(pairs), np.int64)
    if len(known) > KNOWN_PAIRS:
        known.clear()
    for n, pair in enumerate((chars[pairs // max(len(chars), 1)] << 32 | chars[pairs % max(len(chars), 1)]).tolist()):
        if pair not in known:
            known[pair] = murmur3(f"{chr(pair >> 32)} {chr(pair & 0xFFFFFFFF)}".encode("utf-8", "surrogatepass")) % size
        buckets[n] = known[pair]
    first = rows[0] if rows else 0
    cell, which = distinct((np.array(rows, np.int64)[part[inside]] - first) * size + buckets[which], texts * size)
    return cell + first * size, np.bincount(which, minlength=len(cell))


def bigram_rows(texts: list[str], size: int, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of the rows, index, value) of the texts' bigram vectors of unit length."""
    cells, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for parts, rows in text_parts(texts, TOGETHER_CHARS):
        cell, count = bigram_counts(parts, rows, rows[-1] - rows[0] + 1, size, known)
        shared = int(len(cells[-1]) and np.searchsorted(cell, (rows[0] + 1) * size))  # of a text that begins before these parts
        if shared and cells[-1][-1] >= rows[0] * size:
            begun = int(np.searchsorted(cells[-1], rows[0] * size))
            both, which = np.unique(np.concatenate([cells[-1][begun:], cell[:shared]]), return_inverse=True)
            added = np.bincount(which, np.concatenate([counts[-1][begun:], count[:shared]]), minlength=len(both)).astype(np.int64)
            cell, count = np.concatenate([both, cell[shared:]]), np.concatenate([added, count[shared:]])
            cells[-1], counts[-1] = cells[-1][:begun], counts[-1][:begun]
        cells.append(cell)
        counts.append(count)
    cell, count = np.concatenate(cells), np.concatenate(counts)
    owner = cell // size
    norm = np.sqrt(np.bincount(owner, count.astype(float) ** 2, minlength=len(texts)))
    return np.searchsorted(owner, np.arange(len(texts) + 1)), cell % size, count / norm[owner]


def pieces_of_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches of few enough rows that their texts have about ``TOGETHER_CHARS`` bytes (or one row)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + TOGETHER_CHARS, "right")))
            yield batch.slice(first, end - first)
            first = end


def bigram_vectors(posts: DataFrame, text_col: str = "text", size: int = 1 << 12, max_len: int | None = None, out: str = "vec") -> DataFrame:
    """E14 default: hashed character bigrams of non-blank posts as sparse unit vectors (``max_len``: of their first characters, P6).

    The same vectors as character bigrams through Spark ML's ``HashingTF`` and
    ``Normalizer``, without an array of characters or of all buckets for a post.
    """
    at = posts.columns.index(text_col)
    kept = [c for c in posts.columns if c != out]
    schema = StructType([f for f in posts.schema.fields if f.name != out] + [StructField(out, posts.sparkSession.createDataFrame([], f"v {SPARSE}").schema["v"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in pieces_of_batches(batches, at):
            # Blank posts go here: a filter before this step would compute the text of the plan below twice.
            texts = [t[:max_len] if t and t.strip() else None for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array([t is not None for t in texts], pa.bool_()))
            bounds, index, value = bigram_rows([t for t in texts if t is not None], size, known)
            lists = pa.array(bounds.astype(np.int32))
            vec = pa.StructArray.from_arrays([pa.array(np.full(batch.num_rows, size, np.int32)), pa.ListArray.from_arrays(lists, pa.array(index.astype(np.int32))),
                                              pa.ListArray.from_arrays(lists, pa.array(value))], names=["size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), vec], names=[*kept, out])

    return posts.mapInArrow(run, schema)


def is_sparse(df: DataFrame, vec: str) -> bool:
    """Whether a column holds sparse structs or Spark ML vectors."""
    kind = df.schema[vec].dataType
    return isinstance(kind, VectorUDT) or isinstance(kind, StructType) and {"size", "indices", "values"} <= set(kind.names)


def as_struct(df: DataFrame, vec: str) -> DataFrame:
    """Spark ML vectors as sparse structs (a dense one has all indices); structs stay."""
    if not isinstance(df.schema[vec].dataType, VectorUDT):
        return df
    raw = F.unwrap_udt(F.col(vec))
    sparse = raw["type"] == 0
    size = F.when(sparse, raw["size"]).otherwise(F.size(raw["values"]))
    every = F.filter(F.sequence(F.lit(0), size), lambda i: i < size)
    return df.withColumn(vec, F.when(F.col(vec).isNotNull(), F.struct(size.alias("size"), F.when(sparse, raw["indices"]).otherwise(every).alias("indices"), raw["values"].alias("values"))))


def whole(entries: Column, size: Column) -> Column:
    """An array of ``size`` doubles from entries (i, v) with ascending i."""
    def filled(e: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(-1)).otherwise(F.get(entries, k - 1)["i"])
        return F.concat(F.array_repeat(F.lit(0.0), e["i"] - before - 1), F.array(e["v"]))
    last = F.coalesce(F.try_element_at(entries, F.lit(-1))["i"], F.lit(-1))
    return F.concat(F.flatten(F.transform(entries, filled)), F.array_repeat(F.lit(0.0), size - last - 1))


def dense(vec: str) -> Column:
    """A sparse struct as an array."""
    pairs = F.transform(F.arrays_zip(F.col(f"{vec}.indices"), F.col(f"{vec}.values")), lambda p: F.struct(p["indices"].alias("i"), p["values"].alias("v")))
    return whole(pairs, F.col(f"{vec}.size"))


def entries_of(posts: DataFrame, vec: str, *keep: str | Column) -> DataFrame:
    """(kept columns, i, v): a row for each stored value."""
    return posts.select(*keep, F.inline(F.arrays_zip(F.col(f"{vec}.indices"), F.col(f"{vec}.values")))).withColumnsRenamed({"indices": "i", "values": "v"})


def pooled_entries(posts: DataFrame, vec: str, valid: str, *pooled: Column) -> DataFrame:
    """(event, n_valid, dim, entries): of every event the valid posts, the size, and (i, pooled...) by
    ascending index of the values ``v`` that its valid posts store.

    The posts are gone through once, however dear their vectors are: a post is counted at its first value, one
    without values has a row of its own. An event that is null has no entries.
    """
    stored = F.when(F.col(valid) & F.col("event").isNotNull(), F.arrays_zip(F.col(f"{vec}.indices"), F.col(f"{vec}.values")))
    rows = posts.select("event", F.col(valid).alias("_valid"), F.col(f"{vec}.size").alias("_size"), F.posexplode_outer(stored).alias("_k", "_e"))
    first = F.col("_valid") & (F.coalesce("_k", F.lit(0)) == 0)
    cells = (rows.select("event", F.when(first, F.lit(1)).alias("_post"), "_size", F.col("_e.indices").alias("i"), F.col("_e.values").alias("v"))
             .groupBy("event", "i").agg(*pooled, F.count("_post").alias("_posts"), F.max("_size").alias("_size")))
    entry = F.struct(*(c for c in cells.columns if c not in ("event", "_posts", "_size")))
    return cells.groupBy("event").agg(F.sum("_posts").alias("n_valid"), F.max("_size").alias("dim"),
                                      F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), entry))).alias("entries"))


def event_vectors(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """(event, ..., vec) from values (event, i, v) and one row per event with ``dim``; events without values are zero."""
    lists = values.groupBy("event").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_entries"))
    both = sizes.join(lists, "event", "left").withColumn("_entries", F.coalesce("_entries", F.array().cast("array<struct<i:int,v:double>>")))
    return both.withColumn("vec", whole(F.col("_entries"), F.col("dim"))).drop("_entries")


def sizes_of(posts: DataFrame, vec: str, valid: str) -> DataFrame:
    """(event, n_valid, dim)."""
    return posts.groupBy("event").agg(F.count(F.when(F.col(valid), F.lit(1))).alias("n_valid"), F.max(F.col(f"{vec}.size")).alias("dim"))
