"""Mixture-controlled packing of documents into fixed-length sequences.

Every source is a queue of its documents in key order (nulls first). A window
gives each queue a quantum of tokens, its target share of the window. What the
queue may have received is its quanta so far; it is served in whole granules and the
deficit left over is carried to the next window, so after any number of
windows a queue is less than one granule short of its target. A queue that
has run dry is passed over; the others keep their proportions.

As quanta are fixed, what a queue has received before a window is a
closed expression of the window's number. Each document therefore finds its
own place from the tokens before it in its queue, in whatever partition it is.
Windows follow one another without gaps and are cut every ``length`` tokens:
all sequences but the last are full.

Documents are encoded once, in (source, key) order, and kept with their ids.
Null texts hold only the end id. A null source is a queue of its own. The
order of rows equal in source and key follows their text hash. The mixture is
configuration: more than ``MAX_QUEUES`` sources raise an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm.common import scratch, spread_ranges, stored, text_hash, text_slices
from tremor.llm.encoding import encoder_of

LENGTH, WINDOW_SEQUENCES, GRANULE = 4096, 16, 64
SHIFT = 12  # quanta are kept in units of 2**-12 tokens
MAX_QUEUES = 10_000


class Schedule:
    """What each queue has been served before each window."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, window: int, granule: int):
        self.totals, self.granule = totals.astype(np.int64), granule
        self.quanta = np.maximum(1, np.round(shares / shares.sum() * window * (1 << SHIFT))).astype(np.int64)

    def served(self, queue: np.ndarray, window: np.ndarray) -> np.ndarray:
        due = (window * self.quanta[queue]) >> SHIFT
        return np.minimum(due // self.granule * self.granule, self.totals[queue])

    def window_of(self, queue: np.ndarray, granule: np.ndarray) -> np.ndarray:
        """The window in which a queue's granule is served."""
        return (((granule + 1) * self.granule << SHIFT) - 1) // self.quanta[queue]

    def place(self, queue: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Global position at which a queue's part of a window begins."""
        out = np.empty(len(window), np.int64)
        distinct, at = np.unique(window, return_inverse=True)
        everyone = np.arange(len(self.totals))
        step = max(1, (1 << 22) // len(everyone))
        for a in range(0, len(distinct), step):
            some = distinct[a:a + step, None]
            before, after = self.served(everyone[None, :], some), self.served(everyone[None, :], some + 1)
            starts = before.sum(axis=1)[:, None] + np.cumsum(after - before, axis=1) - (after - before)
            mine = (at >= a) & (at < a + step)
            out[mine] = starts[at[mine] - a, queue[mine]]
        return out

    def cut(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """(row, start in its row, tokens, global position) of all pieces of ranges of queue tokens."""
        stop = start + size
        low = start // self.granule
        n = np.where(size > 0, (stop - 1) // self.granule - low + 1, 0)
        row = np.repeat(np.arange(len(queue)), n)
        window = self.window_of(queue[row], spread_ranges(low, n))
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1])
        row, window = row[new], window[new]
        begin = np.maximum(start[row], self.served(queue[row], window))
        end = np.minimum(stop[row], self.served(queue[row], window + 1))
        position = self.place(queue[row], window) + begin - self.served(queue[row], window)
        pieces = np.where(end > begin, (position + end - begin - 1) // length - position // length + 1, 0)
        which = np.repeat(np.arange(len(row)), pieces)
        sequence = spread_ranges(position // length, pieces)
        a = np.maximum(position[which], sequence * length)
        b = np.minimum((position + end - begin)[which], (sequence + 1) * length)
        return row[which], begin[which] + a - position[which] - start[row[which]], b - a, a


def encoded_queues(docs: DataFrame, path: str, *, tokenizer: str, end_id: int | None, key: str, text: str, source: str) -> DataFrame:
    """Documents in (source, key) order with their ids and the tokens before them in their part of the queue."""
    rows = docs.select(F.col(source).cast("string").alias("source"), F.col(key).cast("long").alias("key"), text_hash(text).alias("tie"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("source", "key", "tie").sortWithinPartitions("source", "key", "tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer)
        end = np.array([] if end_id is None else [end_id], encoder.dtype)
        served: dict[str | None, int] = {}
        for batch in batches:
            for piece in text_slices(batch):
                ids, bounds = encoder.encode(piece.column(3))
                before, sizes, payloads = [], [], []
                for name, a, b in zip(piece.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    payloads.append(ids[a:b].tobytes() + end.tobytes())
                    sizes.append(b - a + len(end))
                    before.append(served.get(name, 0))
                    served[name] = before[-1] + sizes[-1]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), piece.column(0), piece.column(1), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary())],
                                                 names=["part", "source", "key", "before", "n_tokens", "ids"])

    made = ordered.mapInArrow(encode, "part int, source string, key long, before long, n_tokens long, ids binary")
    made.write.option("compression", "zstd").option("parquet.enable.dictionary#ids", "false").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def pack(spark: SparkSession, docs: DataFrame, *, tokenizer: str, end_id: int | None = None, length: int = LENGTH,
         window_sequences: int = WINDOW_SEQUENCES, granule: int = GRANULE, shares: dict[str | None, float] | None = None,
         key: str = "doc_id", text: str = "text", source: str = "source", with_ids: bool = False, path: str | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    source, window-independent; ``ids`` too with ``with_ids``.

    ``shares``: target token proportions by source; without it, each source's share of all tokens.
    Sources not named get the smallest share given.
    """
    path = path or scratch(spark, "pack")
    queues = encoded_queues(docs, f"{path}/queues", tokenizer=tokenizer, end_id=end_id, key=key, text=text, source=source)
    parts = queues.groupBy("part", "source").agg(F.sum("n_tokens").alias("n"))
    # One row per source and partition that holds some of it.
    order = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = stored(parts.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long"))), f"{path}/bases")
    totals = bases.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_first()).limit(MAX_QUEUES + 1).collect()
    if len(totals) > MAX_QUEUES:
        raise ValueError(f"more than {MAX_QUEUES} sources: give a coarser mixture column")
    names, sums = [t[0] for t in totals], np.array([t[1] for t in totals], np.int64)
    weights = sums.astype(float) if shares is None else np.array([shares.get(n, min(shares.values())) for n in names], float)
    schedule = Schedule(sums, weights, length * window_sequences, granule) if len(names) else None
    number = {n: i for i, n in enumerate(names)}
    dtype = encoder_of(tokenizer).dtype

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(n, 500) for n in range(0, len(whole), 500)):
                names_, keys, starts, sizes, payloads = (batch.column(c) for c in range(5))
                queue = np.array([number[s] for s in names_.to_pylist()], np.int64)
                size = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
                row, start, tokens, position = schedule.cut(queue, starts.to_numpy(zero_copy_only=False).astype(np.int64), size, length)
                ids = [np.frombuffer(p, dtype).astype("<u4") for p in payloads.to_pylist()]
                taken = [ids[r][a:a + n] for r, a, n in zip(row.tolist(), start.tolist(), tokens.tolist(), strict=True)]
                out = [keys.take(pa.array(row)), pa.array(start), pa.array(tokens), pa.array([zlib.crc32(t) for t in taken], pa.int64()), pa.array(size[row]),
                       pa.array(position // length), pa.array(position % length), names_.take(pa.array(row))]
                names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
                if with_ids:
                    out.append(pa.array([t.tobytes() for t in taken], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[*names, "ids"][:len(out)])

    placed = queues.join(bases.select("part", F.col("source").alias("queue"), "base"), (queues["part"] == bases["part"]) & queues["source"].eqNullSafe(F.col("queue")))
    rows = placed.select(queues["source"], "key", (F.col("base") + F.col("before")).alias("at"), "n_tokens", "ids")
    schema = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids
    return rows.mapInArrow(cut, schema).withColumnRenamed("key", key)
