"""Per-event caps, list views, sampling and epoch windows (W1-W3, P6, P7,
R2, O4, O5).

Caps run in two stages: the first ``n`` rows per (event, hash bucket of pos),
then the first ``n`` per event. Each of an event's first ``n`` rows is among its
bucket's first ``n``, so the result is exact, and no task sees a whole hot event.
Spark plans a partial ``WindowGroupLimit`` before each shuffle. List views run
only after the cap, so a list holds at most ``n`` entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MAX_TWEETS, topic_sentence, truncate
from ..functions.text import is_valid


BATCH_EVENTS = 4  # fixed value: events in a training batch
CAP_BUCKETS = 64  # hash buckets of an event in the first stage of a cap


def first_n(df: DataFrame, n: int, key: str = "event", order: str = "pos", buckets: int = CAP_BUCKETS) -> DataFrame:
    """The first ``n`` rows per ``key`` by ``order``, with their rank ``_rn``."""
    def ranked(src: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(order)
        return src.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)

    dealt = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    return ranked(ranked(dealt, [key, "_b"]).drop("_rn", "_b"), [key])


def cap_posts(posts: DataFrame, n: int = MAX_TWEETS, text_col: str = "text",
              count_blank: bool = False, buckets: int = CAP_BUCKETS) -> DataFrame:
    """First ``n`` posts per event in file order (``pos``), with ``slot``.

    By default blank posts neither use up the cap nor appear (Q7);
    ``count_blank=True`` keeps them and counts them like a first run.
    """
    src = posts if count_blank else posts.where(is_valid(text_col))
    return (first_n(src, n, buckets=buckets)
            .withColumn("slot", (F.col("_rn") - 1).cast("int")).drop("_rn"))


def post_lists(capped: DataFrame, n: int = MAX_TWEETS, text_col: str = "text",
               add_topic: bool = False) -> DataFrame:
    """W2 (+P7): per event, the capped posts as an ordered list padded to ``n``
    slots with ``""`` text and null id. Only for list consumers; bounded by ``n``."""
    entry = F.struct(F.col("pos").alias("pos"), F.col("id").alias("id"), F.col(text_col).alias("text"))
    pad = F.struct(F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit("").alias("text"))
    lists = capped.groupBy("event").agg(F.array_sort(F.collect_list(entry)).alias("posts"))
    padded = F.concat(F.col("posts"), F.array_repeat(pad, F.greatest(F.lit(n) - F.size("posts"), F.lit(0))))
    out = lists.select("event", padded.alias("posts"))
    if add_topic:
        head = F.array(F.struct(F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("id"),
                                topic_sentence("event").alias("text")))
        out = out.select("event", F.concat(head, F.col("posts")).alias("posts"))
    return out


def explode_lists(lists: DataFrame) -> DataFrame:
    """Long form of W2 lists: (event, slot, pos, id, text)."""
    return lists.select("event", F.posexplode("posts").alias("slot", "p")).select(
        "event", F.col("slot").cast("int").alias("slot"), "p.pos", "p.id", "p.text")


def truncate_posts(posts: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """P6."""
    return posts.withColumn(text_col, truncate(text_col, n))


def with_topic_sentence(posts: DataFrame, text_col: str = "text") -> DataFrame:
    """P7 in long form: a slot -1 row `Topic: {event}` per event, no list needed."""
    topics = posts.select("event").distinct().select(
        "event", F.lit(-1).cast("int").alias("slot"), topic_sentence("event").alias(text_col))
    return posts.select("event", "slot", text_col).unionByName(topics)


def uniform(seed: int, *cols) -> F.Column:
    """Deterministic U[0,1) from md5(seed:cols...): 52 bits of the digest."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def drop_posts(posts: DataFrame, p: float, seed: int = 42, epoch: int = 0) -> DataFrame:
    """R2: drop each post with probability ``p``, keeping at least one per event.

    Kept = ``u > p``; an event where nothing survives keeps its highest-``u``
    post. Which post that is comes from a fixed-width hash aggregate per event
    (``max_by(pos, u)``); the rescued rows are found with a semi-join on
    (event, pos) against that one-row-per-event table, so posts are never
    sorted or shuffled by event.
    """
    if p <= 0:
        return posts
    u = uniform(seed, F.lit(str(epoch)), "event", "pos")
    scored = posts.withColumn("_u", u)
    kept = scored.where(F.col("_u") > p).drop("_u")
    rescue_keys = (scored.groupBy("event")
                   .agg(F.max("_u").alias("_m"), F.max_by("pos", "_u").alias("pos"))
                   .where(F.col("_m") <= p).select("event", "pos"))
    rescued = posts.join(rescue_keys, ["event", "pos"], "left_semi")
    return kept.unionByName(rescued)


def sample_events(events: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """``k`` events chosen by a seeded hash order (a top-k, the feature itself)."""
    key = F.md5(F.concat(F.lit(str(seed)), F.col("event")))
    return events.select("event").distinct().orderBy(key, "event").limit(k)


def shuffle_key(seed: int, epoch: int) -> F.Column:
    """Sort key for a seeded per-epoch event order (use with orderBy)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("event")))


def numbered(rows: DataFrame, order: list[Column | str], out: str = "number", partitions: int | None = None) -> DataFrame:
    """``rows`` with their 0-based place in the order of ``order`` (which tells all rows apart).

    Rows are dealt to ranges of the order and written; the sizes of the ranges before a row's own
    and its place in that range make its number. No task sees all rows.
    """
    from ..sources.files import land
    spark = rows.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = land(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dict(ranged.groupBy("_range").count().collect())  # a row for each range
    before, total = [], 0
    for n in range(parts):
        before.append((n, total))
        total += sizes.get(n, 0)
    starts = spark.createDataFrame(before, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn(out, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")


def epoch_batches(events: DataFrame, seed: int = 42, epoch: int = 0, size: int = BATCH_EVENTS, partitions: int | None = None) -> DataFrame:
    """O5 + E9: events in the shuffled order of an epoch, with ``number`` from 0 and ``batch``
    (``size`` events each, the last one what is left). One row per event."""
    keyed = events.withColumn("_key", shuffle_key(seed, epoch))
    out = numbered(keyed, ["_key", "event"], "number", partitions).drop("_key")
    return out.withColumn("batch", F.floor(F.col("number") / size).cast("long"))


def write_epoch(batches: DataFrame, path: str, partitions: int | None = None) -> None:
    """An epoch's events as JSON lines, in order: the part files by name, the lines inside them by number."""
    parts = partitions or int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches.repartitionByRange(parts, "number").sortWithinPartitions("number").write.mode("overwrite").json(path)


def best_epoch(history: DataFrame, metric: str = "val_f1") -> DataFrame:
    """Running best (strict improvement, best starts at 0) per epoch.

    The history has one row per epoch (bounded by the epoch count), so the
    unpartitioned window runs on a tiny input.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("epoch")
    prev = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = history.select("epoch", metric, F.coalesce(prev, F.lit(0.0)).alias("prev_best"))
    out = out.withColumn("improved", F.col(metric) > F.col("prev_best"))
    best = F.max(metric).over(Window.partitionBy(F.lit(0)))
    first_best = F.min(F.when(F.col(metric) == best, F.col("epoch"))).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("is_best", F.col("epoch") == first_best)
