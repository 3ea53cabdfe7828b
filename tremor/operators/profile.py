"""Corpus profiles and image coverage (A12, A15, A16, E15, F5, J5, S12 pick).

Global statistics are partial aggregates; histograms take the range first and
then count per bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import modality
from ..functions.text import char_length, is_valid, token_count
from .cleaning import spread

N_BINS = 50  # reference histogram bins


def corpus_summary(posts: DataFrame, text_col: str = "text", cached: DataFrame | None = None) -> DataFrame:
    """Events, real posts (not padded slots), valid posts; with a list of
    cached events also how many came from the cache and how many are new."""
    per_event = posts.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_valid(text_col), F.lit(1))).alias("v"))
    aggs = [F.count(F.lit(1)).alias("n_events"), F.sum("n").cast("long").alias("n_posts"),
            F.sum("v").cast("long").alias("n_valid_posts")]
    if cached is not None:
        flags = cached.select("event").distinct().withColumn("_cached", F.lit(1))
        per_event = per_event.join(flags, "event", "left")
        aggs += [F.count("_cached").alias("n_cached_events"),
                 (F.count(F.lit(1)) - F.count("_cached")).alias("n_new_events")]
    return per_event.agg(*aggs)


def lengths(posts: DataFrame, text_col: str = "text", segmenter: Callable[[Column], Column] | None = None,
            partitions: int | None = None) -> DataFrame:
    """Per valid post: word and character lengths (P14); words are whitespace tokens, or those of ``segmenter``."""
    return spread(posts, partitions).where(is_valid(text_col)).select(
        "event", token_count(text_col, segmenter).cast("long").alias("words"), char_length(text_col).cast("long").alias("chars"))


def length_stats(posts: DataFrame, text_col: str = "text", segmenter: Callable[[Column], Column] | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Mean, median, min, max and population std of words and chars.

    The exact median keeps one counter per distinct length, so its buffer is
    bounded by the length range.
    """
    ln = lengths(posts, text_col, segmenter, partitions)
    aggs = []
    for c in ("words", "chars"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.stddev_pop(c).alias(f"{c}_std")]
    return ln.agg(*aggs)


def histogram(values: DataFrame, col: str, bins: int = N_BINS) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed: (bin, min, max, n).

    The range is one aggregate (two numbers), the bins a second partial aggregate.
    """
    x = F.col(col).cast("double")
    lo, hi = values.agg(F.min(x), F.max(x)).first()
    lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
    b = F.lit(0) if hi == lo else F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return (values.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", F.lit(lo).alias("min"), F.lit(hi).alias("max"), "n"))


def length_histogram(posts: DataFrame, text_col: str = "text", bins: int = N_BINS, segmenter: Callable[[Column], Column] | None = None,
                     partitions: int | None = None) -> DataFrame:
    """A16 over word and char lengths: (measure, bin, n).

    One pass over the texts: both measures are stacked and reduced to one row
    per (measure, distinct value) before the per-measure range and binning.
    """
    ln = lengths(posts, text_col, segmenter, partitions)
    stacked = ln.select(F.inline(F.array(
        F.struct(F.lit("words").alias("measure"), F.col("words").cast("double").alias("x")),
        F.struct(F.lit("chars").alias("measure"), F.col("chars").cast("double").alias("x")))))
    per_value = stacked.groupBy("measure", "x").agg(F.count(F.lit(1)).alias("n"))
    by_measure = Window.partitionBy("measure")  # one row per distinct value of a measure
    ranged = per_value.select("measure", "x", "n", F.min("x").over(by_measure).alias("lo"),
                              F.max("x").over(by_measure).alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width * bins), F.lit(bins - 1))).cast("int")
    return ranged.groupBy("measure", b.alias("bin")).agg(F.sum("n").cast("long").alias("n"))


def pick_images(manifest: DataFrame) -> DataFrame:
    """Per (event, id) the first readable file in jpg -> png -> jpeg order.

    manifest(event, id, path, ext_rank, length[, readable]) -> (event, id, path, ext).
    A min_by aggregate (partial, no sort) instead of a window.
    """
    ok = F.col("length") > 0
    if "readable" in manifest.columns:
        ok = ok & F.col("readable")
    return (manifest.where(ok).groupBy("event", "id")
            .agg(F.min_by(F.struct("path", "ext"), F.col("ext_rank")).alias("x"))
            .select("event", "id", "x.path", "x.ext"))


def attach_images(posts: DataFrame, images: DataFrame) -> DataFrame:
    """Posts ⟕ picked image on (event, id) -> has_image."""
    im = images.select("event", "id", F.col("path").alias("image_path"))
    return (posts.join(im, ["event", "id"], "left")
            .withColumn("has_image", F.col("image_path").isNotNull()))


def modality_mix(posts_with_images: DataFrame, text_col: str = "text") -> DataFrame:
    """E15 (+F5): per event, posts that are multimodal / text only / neither."""
    m = modality(is_valid(text_col), F.col("has_image"))
    return posts_with_images.groupBy("event").agg(
        F.count(F.when(m == "multimodal", 1)).alias("multimodal"),
        F.count(F.when(m == "text_only", 1)).alias("text_only"),
        F.count(F.when(m == "none", 1)).alias("none"),
    )
