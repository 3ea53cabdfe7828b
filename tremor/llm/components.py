"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import stored


FILE_ROWS = 100_000


def connected_components(spark: SparkSession, edges: DataFrame, path: str) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node reachable.

    Alternating star contraction: neighbours larger than a node are tied to
    the smallest node it knows, then smaller ones are, until nothing changes.
    Each round is a partial ``min`` per node and one join, written out; the
    edge table never grows beyond its nodes and edges.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # u > v in every edge
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, turn = stored(edges, f"{path}/edges0"), 0
    last = state(current)
    while last[0]:
        turn += 1
        parts = -(-last[0] // FILE_ROWS)  # files of a size, however many shuffle partitions there are
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = stored(least.coalesce(parts), f"{path}/least{turn}")  # so that AQE can split the join where a node has many neighbours
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.coalesce(parts), f"{path}/large{turn}")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), f"{path}/next{turn}")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = stored(small.coalesce(parts), f"{path}/edges{turn}")
        now = state(current)
        if now == last:
            break
        last = now
    roots = current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
