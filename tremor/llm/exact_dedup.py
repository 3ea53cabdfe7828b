"""Exact deduplication by deterministic block naming.

A normalised text (A-Z lower-cased, null as empty) is cut into blocks of a
fixed size. Distinct blocks are sorted inside hash buckets and numbered, so
equal blocks, and only these, share an integer name; digests tie rows to names
and are checked to be as distinct as the blocks. Then the names of adjacent blocks are paired, the distinct pairs
sorted and named alike, until each document has one name. Two texts are equal
exactly when they finish in the same round with the same name.

Each task first names blocks within a bounded space of its own, so a block
shared by a third of all rows is shuffled once per space, not once per row;
rows are tied to names by (space, local name), which no content makes hot.

Ties: of equal texts the row with the largest key stays (null keys lowest; of
rows equal in key too, the one read last in its space). Extra columns do not
matter; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm.common import keep_rows, scratch, stored, text_bytes, text_hash, text_slices

BLOCK_BYTES = 4096
BUCKET_ROWS = 1024  # rows sorted together when names are given
SPACE_BYTES, SPACE_ROWS = 16 << 20, 1 << 20  # of one space of local names
NAMED = pa.schema([("space", pa.int64()), ("local", pa.int32()), ("block", pa.binary()), ("row", pa.int64()), ("key", pa.int64()),
                   ("text_hash", pa.int64()), ("sha", pa.binary()), ("locals", pa.list_(pa.int32()))])


def local_names(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """Rows of two kinds: one per distinct block of a space, one per document."""
    rows = docs.select(F.col(key).cast("long").alias("key"), text_hash(text).alias("text_hash"), F.col(text).alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        space, names, held, used = (part << 16), {}, 0, 0
        for batch in batches:
            for piece in text_slices(batch):
                raw, offsets = text_bytes(piece.column(2))
                low, bounds = raw.tobytes().lower(), offsets.tolist()  # bytes.lower() changes A-Z only
                out: list[tuple] = []
                for key_, hash_, lo, hi in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    if held >= SPACE_BYTES or used >= SPACE_ROWS:
                        space, names, held, used = space + 1, {}, 0, 0
                    mine = []
                    for at in range(lo, hi, block_bytes) if hi > lo else (lo,):
                        block = low[at:min(at + block_bytes, hi)]
                        got = names.get(block)
                        if got is None:
                            got = names[block] = len(names)
                            held += len(block) + 100
                            out.append((space, got, block, None, None, None, None, None))
                        mine.append(got)
                    out.append((space, None, None, (space << 20) | used, key_, hash_, hashlib.sha256(low[lo:hi]).digest(), mine))
                    used += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), NAMED.types, strict=True)], schema=NAMED)

    return rows.mapInArrow(name, "space long, local int, block binary, row long, key long, text_hash long, sha binary, locals array<int>")


def sorted_names(rows: DataFrame, keys: list[str | Column], buckets: int) -> Column:
    """Integer names of key tuples: rank of the tuple among the sorted ones of its hash bucket."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    rank = F.dense_rank().over(W.partitionBy(bucket).orderBy(*keys))
    return F.shiftleft(bucket, 32).bitwiseOR(rank.cast("long"))


def block_names(blocks: DataFrame, path: str) -> DataFrame:
    """(digest, name): distinct blocks, sorted where hashing deals them to, get integers.

    A block that many spaces hold is one row of each task before the shuffle. Blocks are told apart by
    their content; their digest only ties a space's block to its name, and two blocks of one digest are an error.
    """
    distinct = blocks.select("digest", "block").distinct()
    names = stored(distinct.sortWithinPartitions("block").select("digest", F.monotonically_increasing_id().alias("name")), path)
    if names.groupBy("digest").count().filter("count > 1").take(1):
        raise ValueError("two blocks have one SHA-256 digest")
    return names


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def name_documents(spark: SparkSession, docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, key, text_hash, sha, round, name): equal (round, name) means equal text."""
    named = local_names(docs, key, text, block_bytes)
    named.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(f"{path}/local")
    named = spark.read.schema(named.schema).parquet(f"{path}/local")
    found = named.filter("row is not null")
    longest = named.agg(F.max(F.size("locals"))).first()[0]
    blocks = named.filter("block is not null").withColumn("digest", F.unhex(F.sha2("block", 256)))
    names = blocks.select("space", "local", "digest").join(block_names(blocks, f"{path}/names"), "digest").select("space", "local", "name")
    parts = found.select("space", "row", F.size("locals").alias("n"), F.posexplode("locals").alias("at", "local"))
    level = stored(parts.join(names, ["space", "local"]).select("row", "n", F.col("at").cast("long").alias("at"), "name"), f"{path}/round0")
    done, left, turn = [level.filter("n = 1").select("row", F.lit(0).alias("round"), "name")], longest or 0, 0
    while left > 1:
        turn += 1
        half = F.shiftright("at", 1)
        pairs = (level.filter("n > 1").groupBy("row", "n", half.alias("at"))
                 .agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")))
        pairs = stored(pairs, f"{path}/pairs{turn}")
        distinct = pairs.select("a", "b").distinct()
        numbers = distinct.select("a", "b", sorted_names(distinct, ["a", "b"], buckets_for(pairs.count())).alias("name"))
        level = stored(pairs.join(numbers, ["a", "b"]).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "at", "name"), f"{path}/round{turn}")
        done.append(level.filter("n = 1").select("row", F.lit(turn).alias("round"), "name"))
        left = -(-left // 2)
    identities = done[0]
    for more in done[1:]:
        identities = identities.unionByName(more)
    return found.select("row", "key", "text_hash", "sha").join(identities, "row")


def exact_dedup(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                block_bytes: int = BLOCK_BYTES, path: str | None = None) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256, text_hash, round, name."""
    path = path or scratch(spark, "dedup")
    rows = stored(name_documents(spark, docs, path, key=key, text=text, block_bytes=block_bytes), f"{path}/identities")
    # A text shared by many rows makes (round, name) hot. Written on its own, the table of groups
    # meets the rows in a join of two exchanges, which AQE splits where it is skewed.
    groups = stored(rows.groupBy("round", "name").agg(F.max(F.struct("key", "row")).alias("best"), F.count("*").alias("group_size")), f"{path}/groups")
    return (rows.join(groups, ["round", "name"])
            .select(F.col("key").alias(key), F.col("best.key").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
                    "text_hash", "round", "name"))


def deduplicate(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(spark, docs, key=key, text=text).filter("kept").select(key, "text_hash")
    return keep_rows(docs, kept, key, text, once=True)
