"""Partitioning helpers."""

from __future__ import annotations

import math

# Input bytes per shuffle partition when sizing from the input: shuffles see
# less than the input (pruned columns, map-side pre-aggregation), and AQE
# coalesces partitions that come out small.
INPUT_BYTES_PER_SHUFFLE_PARTITION = 512 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, cores: int) -> int:
    """ceil(input / 512 MB), at least one wave of tasks and at most twenty
    (bounds the reducer x mapper block count of one shuffle)."""
    wanted = math.ceil(max(input_bytes, 0) / INPUT_BYTES_PER_SHUFFLE_PARTITION)
    return int(min(max(wanted, cores), 20 * cores))


def suggested_shuffle_partitions(spark, catalogue) -> int:
    """A value for ``spark.sql.shuffle.partitions`` from the listed bytes of a
    catalogue (event, path, length); the caller decides whether to set it."""
    from pyspark.sql import functions as F
    return shuffle_partitions_for(catalogue.agg(F.sum("length")).first()[0] or 0, spark.sparkContext.defaultParallelism)
