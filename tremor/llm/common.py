"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import ensure_checkpoint_dir, fill_unset

# Size of an Arrow batch sent to Python where the session sets none: whole documents
# travel in these batches, so one is kept to a few MB of text, long documents included.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
# Bytes of text handled at once inside a batch.
SLICE_BYTES = 4 << 20
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    fill_unset(spark, BATCH_LIMITS)
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Let the workers import this package where neither PYTHONPATH nor submit options do."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    sc = spark.sparkContext
    local = sc.master.startswith("local[") or sc.master == "local"
    if not os.path.isdir(root) or root in paths or local and os.getcwd() == root or sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    # The driver serves this archive to the executors as long as it lives.
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='tremor-code-')}/tremor", "zip", root, "tremor"))


_SHIPPED: set[str] = set()


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside, for tables of wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    prepare(spark)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet and read back: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str = "text") -> Column:
    """Hash of the raw text, null as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def temp_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not use."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def keep_rows(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text",
              how: str = "left_semi", once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose (key, text hash) is (not) in ``wanted(key, text_hash)``.

    Null keys match null keys. With ``once``, rows that agree in key and text
    are reduced to one of them (partial aggregation before the shuffle).
    """
    own = [temp_name(docs, f"_row_key{n}") for n in range(3)]
    found = F.col(key)
    left = docs.withColumns(dict(zip(own, (F.coalesce(found, F.lit(0)), found.isNull(), text_hash(text)), strict=True)))
    right = wanted.select(F.coalesce(found, F.lit(0)).alias(own[0]), found.isNull().alias(own[1]), F.col("text_hash").alias(own[2])).distinct()
    kept = left.join(right, own, how)  # plain equality, so that what follows reuses the partitioning
    return (kept.dropDuplicates(own) if once else kept).select(*docs.columns)


def text_slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of text (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    if isinstance(column, pa.LargeStringArray):
        column = column.cast(pa.string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(column))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null as empty) and its row offsets, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def words_of(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes per row: (start, end, row) arrays.

    ``is_word`` has 256 flags. A run never crosses a row boundary; bytes of
    multi-byte characters are all 0x80 or more, so byte classes are exact for
    classes that take all or none of them.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    begins = inside & first
    begins[1:] |= inside[1:] & ~inside[:-1]
    begins[0] = inside[0]
    starts = np.flatnonzero(begins)
    stops = np.empty(len(raw), dtype=bool)
    stops[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    stops[-1] = inside[-1]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def packed_strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The byte ranges as an Arrow string array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    data = raw[spread_ranges(starts, lengths)] if len(starts) else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


LOWER_A_Z = np.arange(256, dtype=np.uint8)
LOWER_A_Z[65:91] += 32
