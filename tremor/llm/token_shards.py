"""Token-ID binary output with keyed access.

Layout under ``path``: ``bin/shard-NNNNNN.bin`` raw little-endian ids of the
documents in ascending key order (nulls first, equal keys by text hash);
``entries`` (Parquet) one row per document with shard and byte offset;
``shards`` the ids before each shard; ``index/NNNNNNNN.idx`` minimal perfect hash
buckets; ``descriptor`` one row: type of an id, end id, SHA-256 of the tokenizer
file, distinct buckets of the index.

An index file holds ``FILE_BUCKETS`` neighbouring buckets of about ``BUCKET_KEYS`` keys:
the place of each bucket, then per bucket the level bits with a count for every 512 bits
and one record per slot: key fingerprint, shard, offset, length. A key's bucket is a hash
of it, so a lookup reads a few KB of bits and one record, whatever the number of
documents; no other bucket is opened.

Keys are whole numbers. Null and empty texts hold only the end id. A repeated key keeps all its rows
in the files; the index points to the first one. An empty table gives no shard and an empty index.
Further columns are not read. The shared folder's scheme must be one that ``pyarrow.fs`` opens
(local or mounted, s3, gs, hdfs).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm import mph
from tremor.llm.common import prepare, scratch, stored, text_hash, text_slices
from tremor.llm.encoding import encoder_of

BUCKET_KEYS, FILE_BUCKETS = 4096, 64
RECORD = np.dtype([("mark", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("n_tokens", "<i8")])
FOUND = "key long, h1 long, h2 long, shard int, offset long, n_tokens long"
ENTRY = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        scheme, rest = path.split(":", 1)
        return pafs.FileSystem.from_uri(f"{scheme}://" + "/" + rest.lstrip("/") if scheme == "file" else path)
    return pafs.LocalFileSystem(), path


def key_hashes(key: str) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key; null is a key of its own."""
    c, null = F.col(key), F.col(key).isNull()
    return F.xxhash64(null, c), F.xxhash64(F.lit("second"), c, null)


def write_token_shards(spark: SparkSession, docs: DataFrame, path: str, *, tokenizer: str, end_id: int | None,
                       key: str = "doc_id", text: str = "text") -> None:
    """Encode, write the shard files, and build the index (all jobs run here)."""
    prepare(spark)
    h1, h2 = key_hashes(key)
    rows = docs.select(h1.alias("h1"), h2.alias("h2"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
                       text_hash(text).alias("tie"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, encoder = task.partitionId(), encoder_of(tokenizer)
        end = np.array([] if end_id is None else [end_id], encoder.dtype)
        fs, root = open_folder(f"{path}/bin")
        out, temp, at = None, f"{root}/_writing-{shard}-{task.taskAttemptId()}", 0
        for batch in batches:
            for part in text_slices(batch):
                ids, bounds = encoder.encode(part.column(3))
                sizes = np.diff(bounds) + len(end)
                ids = np.insert(ids, np.repeat(bounds[1:], len(end)), np.tile(end, len(bounds) - 1))
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temp)
                out.write(ids.tobytes())
                starts = at + (np.cumsum(sizes) - sizes) * encoder.dtype.itemsize
                at += len(ids) * encoder.dtype.itemsize
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(starts), pa.array(sizes)], schema=ENTRY)
        if out is not None:
            out.close()
            fs.move(temp, f"{root}/shard-{shard:06d}.bin")

    entries = stored(ordered.mapInArrow(write, "h1 long, h2 long, key long, shard int, offset long, n_tokens long"), f"{path}/entries")
    totals = entries.groupBy("shard").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("documents"))
    # One row per shard file: small by construction.
    totals.withColumn("base", F.sum("ids").over(W.orderBy("shard")) - F.col("ids")).write.parquet(f"{path}/shards")
    with open(tokenizer, "rb") as vocabulary:
        digest = hashlib.file_digest(vocabulary, "sha256").hexdigest()
    buckets = build_index(entries, path)
    row = [(encoder_of(tokenizer).dtype.str, end_id, digest, buckets)]
    spark.createDataFrame(row, "dtype string, end_id long, tokenizer_sha256 string, buckets long").coalesce(1).write.parquet(f"{path}/descriptor")


def descriptor(spark: SparkSession, path: str) -> Row:
    return spark.read.parquet(f"{path}/descriptor").first()


def build_index(entries: DataFrame, path: str) -> int:
    """Writes the index files; returns the number of buckets."""
    first = entries.groupBy("h1", "h2").agg(F.min(F.struct("shard", "offset", "n_tokens")).alias("at"))
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))
    bucket = F.pmod(F.col("h1"), F.lit(buckets))
    rows = first.select((bucket / FILE_BUCKETS).cast("long").alias("file"), bucket.alias("bucket"), "h1", "h2", "at.*")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        number, task = int(group["file"].iloc[0]), TaskContext.get()
        blocks = [b""] * FILE_BUCKETS
        for n, keys in group.groupby("bucket"):
            blocks[int(n) % FILE_BUCKETS] = bucket_block(*(keys[c].to_numpy() for c in ("h1", "h2", "shard", "offset", "n_tokens")))
        places = np.cumsum([8 * (FILE_BUCKETS + 1), *map(len, blocks)]).astype("<i8")
        fs, root = open_folder(f"{path}/index")
        fs.create_dir(root, recursive=True)
        temp = f"{root}/_writing-{number}-{task.taskAttemptId()}"
        with fs.open_output_stream(temp) as out:
            out.write(places.tobytes())
            for block in blocks:
                out.write(block)
        fs.move(temp, f"{root}/{number:08d}.idx")
        return pd.DataFrame({"file": [number], "keys": [len(group)], "bytes": [int(places[-1])]})

    rows.groupBy("file").applyInPandas(build, "file long, keys long, bytes long").write.parquet(f"{path}/index_files")
    return buckets


def bucket_block(h1: np.ndarray, h2: np.ndarray, shard: np.ndarray, offset: np.ndarray, n_tokens: np.ndarray) -> bytes:
    """One bucket: counts of levels, words and keys, level sizes, words, counts by block of words, records by slot."""
    sizes, words, ranks = mph.build(h1, h2)
    records = np.empty(len(h1), RECORD)
    at = mph.slots(sizes, words, ranks, h1, h2)
    for name, values in (("mark", mph.fingerprint(h1, h2)), ("shard", shard), ("offset", offset), ("n_tokens", n_tokens)):
        records[name][at] = values
    head = np.array([len(sizes), len(words), len(h1)], "<i4")
    return b"".join(part.tobytes() for part in (head, sizes, words, ranks, records))


class IndexFile:
    """One index file, opened for reading by position."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        self.places = np.frombuffer(source.read_at(8 * (FILE_BUCKETS + 1), 0), "<i8")

    def find(self, bucket: int, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys are there, their records). Reads the bits of one bucket and the records from
        the first to the last slot asked."""
        start, stop = self.places[bucket % FILE_BUCKETS:bucket % FILE_BUCKETS + 2].tolist()
        nothing = np.zeros(0, np.int64), np.zeros(0, RECORD)
        if start == stop:
            return nothing
        levels, n_words, keys = np.frombuffer(self.source.read_at(12, start), "<i4").tolist()
        size, blocks = 4 * levels, n_words // mph.BLOCK_WORDS
        bits = self.source.read_at(size + 8 * n_words + 4 * blocks, start + 12)
        words = np.frombuffer(bits, "<u8", n_words, size)
        slot = mph.slots(np.frombuffer(bits, "<i4", levels), words, np.frombuffer(bits, "<u4", blocks, size + 8 * n_words), h1, h2)
        which = np.flatnonzero(slot >= 0)
        if not len(which):
            return nothing
        low, high = int(slot[which].min()), int(slot.max())
        raw = self.source.read_at((high - low + 1) * RECORD.itemsize, stop - (keys - low) * RECORD.itemsize)
        records = np.frombuffer(raw, RECORD)[slot[which] - low]
        good = records["mark"] == mph.fingerprint(h1[which], h2[which])
        return which[good], records[good]


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, h1, h2, shard, offset, n_tokens) of each distinct key found through the index.

    The keys are sorted by bucket; each task opens the files of its buckets only. The index is
    neither scanned nor shuffled.
    """
    buckets = descriptor(spark, path)["buckets"]
    h1, h2 = key_hashes(key)
    asked = (keys.select(F.col(key).cast("long").alias("key"), h1.alias("h1"), h2.alias("h2")).distinct()
             .withColumn("bucket", F.pmod(F.col("h1"), F.lit(buckets))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(f"{path}/index")
        number, index = None, None
        for batch in batches:
            a, b, bucket = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            bounds = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
            rows, records = [], []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                asked_bucket = int(bucket[low])
                if asked_bucket // FILE_BUCKETS != number:
                    if index is not None:
                        index.source.close()
                    number, name = asked_bucket // FILE_BUCKETS, f"{root}/{asked_bucket // FILE_BUCKETS:08d}.idx"
                    index = IndexFile(fs.open_input_file(name)) if fs.get_file_info(name).is_file else None
                if index is not None:
                    which, found = index.find(asked_bucket, a[low:high], b[low:high])
                    rows.append(low + which)
                    records.append(found)
            if rows:
                at, found = pa.array(np.concatenate(rows)), np.concatenate(records)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *(pa.array(np.ascontiguousarray(found[c])) for c in ("shard", "offset", "n_tokens"))],
                                                 names=["key", "h1", "h2", "shard", "offset", "n_tokens"])
        if index is not None:
            index.source.close()

    return asked.repartitionByRange("bucket", "h1").sortWithinPartitions("bucket").mapInArrow(find, FOUND)


def read_payloads(spark: SparkSession, path: str, places: DataFrame, dtype: str | None = None) -> DataFrame:
    """Adds ``ids`` (little-endian payload bytes) to rows with shard, offset and n_tokens.

    Ids have the type of the descriptor.
    """
    dtype = stated_type(spark, path, dtype)
    schema = places.schema
    kept = [f.name for f in schema]
    i, j, k = kept.index("shard"), kept.index("offset"), kept.index("n_tokens")
    size = np.dtype(dtype).itemsize

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(f"{path}/bin")
        shard, source = None, None
        for whole in batches:
            for batch in (whole.slice(n, 256) for n in range(0, len(whole), 256)):
                payloads = []
                for s, o, n in zip(*(batch.column(c).to_pylist() for c in (i, j, k)), strict=True):
                    if s != shard:
                        if source is not None:
                            source.close()
                        shard, source = s, fs.open_input_file(f"{root}/shard-{s:06d}.bin")
                    payloads.append(source.read_at(n * size, o))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary())], names=[*kept, "ids"])
        if source is not None:
            source.close()

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", ids binary"
    # Ranges of (shard, offset): neighbouring documents are read one after another.
    return places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(read, out)


def stated_type(spark: SparkSession, path: str, dtype: str | None) -> str:
    """The type of an id in these files; a caller who names another one is wrong."""
    written = descriptor(spark, path)["dtype"]
    if dtype is not None and np.dtype(dtype) != np.dtype(written):
        raise ValueError(f"ids are {written} in {path}, not {dtype}")
    return written


def crc32_of(column: pa.Array, dtype: str) -> list[int]:
    return [zlib.crc32(np.frombuffer(p, dtype).astype("<u4").tobytes()) for p in column.to_pylist()]


def digests(spark: SparkSession, path: str, keys: DataFrame, dtype: str | None = None, key: str = "doc_id") -> DataFrame:
    """One row per document in the files: key, ids before it, length, crc32 of its ids.

    Documents are found through the index; further rows of a repeated key are
    taken from the entries.
    """
    dtype = stated_type(spark, path, dtype)
    # Read twice below: the places are written, so that the index is read once.
    found = stored(lookup(spark, path, keys, key).select("key", "shard", "offset", "n_tokens"), scratch(spark, "places"))
    repeats = (spark.read.parquet(f"{path}/entries").select("key", "shard", "offset", "n_tokens")
               .join(found.select("shard", "offset"), ["shard", "offset"], "left_anti").select(*found.columns))
    bases = spark.read.parquet(f"{path}/shards").select("shard", "base")
    size = np.dtype(dtype).itemsize

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = crc32_of(b.column(4), dtype)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sums, pa.int64())], names=["key", "shard", "offset", "n_tokens", "ids_crc32"])

    read = read_payloads(spark, path, found.unionByName(repeats), dtype).mapInArrow(digest, "key long, shard int, offset long, n_tokens long, ids_crc32 long")
    return read.join(bases, "shard").select(F.col("key").alias(key), (F.col("base") + (F.col("offset") / size).cast("long")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset")
