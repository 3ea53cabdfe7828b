"""Severity labels, event joins and the stratified split (S6 dedupe, P8, J1-J3,
J7, R1, U2, A13, A14, A17).

Label and split tables have one row per event. They are never forced into a
broadcast: AQE turns the join into a broadcast only when the runtime size is
under ``spark.sql.autoBroadcastJoinThreshold``, and uses skew-join splitting
otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity_level

# Hash-prefix buckets used to rank events inside a level without funnelling a
# whole level through one task: 16^4 buckets per level.
SPLIT_BUCKET_HEX = 4


def dedupe_labels(labels: DataFrame) -> DataFrame:
    """One label per event, the last in file order wins.

    labels(event, severity[, reason][, position]) -> (event, reason, severity).
    """
    pos = F.col("position") if "position" in labels.columns else F.lit(0)
    reason = F.col("reason") if "reason" in labels.columns else F.lit(None).cast("string")
    latest = F.max_by(F.struct(reason.alias("reason"), F.col("severity").alias("severity")), pos)
    return labels.groupBy("event").agg(latest.alias("x")).select("event", "x.reason", "x.severity")


def encode_labels(labels: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``level`` (0/1/2); unknown severities raise when ``strict``."""
    return labels.withColumn("level", severity_level("severity", strict))


def join_labels(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events left-join labels; unlabelled events get level 0 and a flag."""
    lab = labels.select("event", F.col("level").alias("_level"))
    return (events.join(lab, "event", "left")
            .withColumn("label_defaulted", F.col("_level").isNull())
            .withColumn("level", F.coalesce(F.col("_level"), F.lit(0)).cast("int"))
            .drop("_level"))


def missing_events(requested: DataFrame, available: DataFrame, strict: bool = False) -> DataFrame:
    """Requested events without a file. ``strict`` raises listing up to 20 of them."""
    missing = requested.select("event").distinct().join(available.select("event"), "event", "left_anti")
    if strict:
        sample = [r.event for r in missing.limit(20).collect()]
        if sample:
            raise FileNotFoundError(f"event files not found: {sample}")
    return missing


def stratified_split(catalogue: DataFrame, labels: DataFrame, train_ratio: float = 0.8,
                     seed: int = 42) -> DataFrame:
    """R1 (+J3, F6): per level, the first ``floor(ratio*n)`` events by
    ``md5(seed || event)`` go to train, the rest to val. A level with a single
    event goes to train (the reference raises there).

    Ranking is distributed: events are bucketed by a hash prefix, bucket sizes
    give per-bucket offsets (a table of at most 3 * 16^4 rows), and the rank
    inside a bucket is a window over a few rows. No level is ranked by one task.
    """
    events = catalogue.select("event").distinct().join(labels.select("event", "level"), "event")
    h = F.md5(F.concat(F.lit(str(seed)), F.col("event")))
    keyed = events.select("event", "level", h.alias("h"),
                          F.substring(h, 1, SPLIT_BUCKET_HEX).alias("bucket"))
    buckets = keyed.groupBy("level", "bucket").agg(F.count(F.lit(1)).alias("bn"))
    by_level = Window.partitionBy("level")
    offsets = buckets.select(
        "level", "bucket",
        (F.sum("bn").over(by_level.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("offset"),
        F.sum("bn").over(by_level).alias("n"),
    ).fillna({"offset": 0})
    local = Window.partitionBy("level", "bucket").orderBy("h", "event")
    ranked = (keyed.join(offsets, ["level", "bucket"])
              .withColumn("rank", F.col("offset") + F.row_number().over(local)))
    n_train = F.greatest(F.floor(F.col("n") * F.lit(float(train_ratio))), F.least(F.col("n"), F.lit(1)))
    return ranked.select("event", "level",
                         F.when(F.col("rank") <= n_train, "train").otherwise("val").alias("part"))


def split_overlap(split: DataFrame) -> DataFrame:
    """Events present in both parts (must be empty)."""
    train = split.where(F.col("part") == "train").select("event")
    val = split.where(F.col("part") == "val").select("event")
    return train.intersect(val)


def level_distribution(split: DataFrame) -> DataFrame:
    """Events per (part, level)."""
    return split.groupBy("part", "level").agg(F.count(F.lit(1)).alias("n"))


def level_rollup(split: DataFrame) -> DataFrame:
    """A13 with totals: (part, level, n, totals) for each part and level (totals 0), each part
    (1, level null) and all (3, part and level null)."""
    return split.rollup("part", "level").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("totals"))


def class_count(labels: DataFrame) -> DataFrame:
    """A14."""
    return labels.agg(F.count_distinct("level").alias("n_classes"))


def class_weights(labels: DataFrame, counts: list[int] | None = None) -> DataFrame:
    """w_c = (1/n_c) / sum_k(1/n_k) * C, from the data or from fixed counts."""
    if counts is not None:
        spark = labels.sparkSession
        per = spark.createDataFrame([(i, int(n)) for i, n in enumerate(counts)], "level int, n long")
    else:
        per = labels.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    all_rows = Window.partitionBy(F.lit(0))  # at most #classes rows
    inv = 1.0 / F.col("n")
    return per.select("level", "n", (inv / F.sum(inv).over(all_rows) * F.count(F.lit(1)).over(all_rows)).alias("weight"))


def split_posts(posts: DataFrame, split: DataFrame, part: str) -> DataFrame:
    """Posts of the events in one split part."""
    return posts.join(split.where(F.col("part") == part).select("event"), "event", "left_semi")
