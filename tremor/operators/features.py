"""The twelve per-event statistics.

Main branch: each post is expanded into three facet rows (all, user, hour)
and aggregated at (event, facet, key) grain first, so a hot event is spread
over its users and hours and reduced map-side before the per-event shuffle;
the per-event step has fixed-width buffers only (HashAggregate). Location
branch: an (event, location) pre-aggregate over three pruned columns gives
the location diversity and the top location. No count-distinct Expand, no
collect_list, no driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# --- fixed values that must equal the reference: feature names in its dict order,
# which becomes the model vector.
FEATURES = [
    "post_count", "timespan_hours", "peak_hour", "night_ratio",
    "avg_reposts", "avg_comments", "avg_likes", "engagement_ratio",
    "unique_users", "user_post_ratio", "location_diversity", "top_location_ratio",
]

_FLAGS = ("has_time", "has_counts", "has_nickname", "has_location")


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(True)


def typed_posts(posts: DataFrame, default_year: int | None = None) -> DataFrame:
    """P1-P4 + S2 on the raw all-string post columns that features need.

    The normalised time string is its own projection: the parse references it
    several times, and a separate (non-collapsed) projection computes it once.
    """
    def opt(name):
        return S.na_to_null(F.col(name)) if name in posts.columns else F.lit(None).cast("string")
    staged = posts.select(
        "event",
        F.col("pos").cast("long").alias("pos"),
        S.normalize_time(opt("published_raw"), default_year).alias("_norm"),
        S.to_number(opt("reposts")).alias("reposts"),
        S.to_number(opt("comments")).alias("comments"),
        S.to_number(opt("likes")).alias("likes"),
        opt("nickname").alias("nickname"),
        S.location_or_unknown(opt("location")).alias("location"),
        *[_flag(posts, f).alias(f) for f in _FLAGS],
    )
    return staged.select("event", "pos", S.parse_time("_norm").alias("ts"), "reposts", "comments", "likes",
                         "nickname", "location", *_FLAGS)


def facet_counts(typed: DataFrame) -> DataFrame:
    """(event, facet, key) pre-aggregate carrying the per-post measures once."""
    hour = F.hour("ts")
    loc_measures = [
        F.col("reposts"), F.col("comments"), F.col("likes"), F.col("ts"),
        S.is_night("ts").cast("int"),
    ]
    names = ["reposts", "comments", "likes", "ts", "night"]
    null_measures = [F.lit(None).cast(t) for t in ("double", "double", "double", "timestamp_ntz", "int")]

    def facet(kind, key, measures):
        return F.struct(F.lit(kind).alias("facet"), key.cast("string").alias("key"),
                        *[m.alias(n) for m, n in zip(measures, names)])

    expanded = typed.select(
        "event", "pos", *_FLAGS,
        F.inline(F.array(
            facet("all", F.lit(""), loc_measures),
            facet("user", F.col("nickname"), null_measures),
            facet("hour", F.when(F.col("ts").isNotNull(), hour), null_measures),
        )),
    ).where(F.col("key").isNotNull())
    return expanded.groupBy("event", "facet", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pos").alias("first_pos"),
        F.sum("reposts").alias("s_reposts"),
        F.sum("comments").alias("s_comments"),
        F.sum("likes").alias("s_likes"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
        F.count("ts").alias("n_ts"),
        F.sum("night").alias("n_night"),
        *[F.max(F.col(f).cast("int")).alias(f) for f in _FLAGS],
    )


def event_features(posts: DataFrame, default_year: int | None = None,
                   catalogue: DataFrame | None = None) -> DataFrame:
    """posts(event, pos, published_raw, reposts, comments, likes, nickname,
    location[, has_*]) -> one row per event with the 12 features + top_location.

    ``catalogue`` (event) adds events whose file had no rows, with zeros (Q19).
    """
    typed = typed_posts(posts, default_year)
    fc = facet_counts(typed)
    is_all, is_user, is_hour = (F.col("facet") == k for k in ("all", "user", "hour"))
    # most frequent hour, smallest on ties, as one long: n * 32 + (31 - hour)
    hour_code = F.col("n") * 32 + (31 - F.col("key").cast("long"))
    agg = fc.groupBy("event").agg(
        F.sum(F.when(is_all, F.col("n"))).alias("post_count"),
        F.sum("s_reposts").alias("s_reposts"),
        F.sum("s_comments").alias("s_comments"),
        F.sum("s_likes").alias("s_likes"),
        F.min("ts_min").alias("ts_min"),
        F.max("ts_max").alias("ts_max"),
        F.sum(F.when(is_all, F.col("n_ts"))).alias("n_ts"),
        F.sum("n_night").alias("n_night"),
        (31 - F.max(F.when(is_hour, hour_code)) % 32).alias("peak"),
        F.count(F.when(is_user, F.lit(1))).alias("n_users"),
        *[(F.max(f) == 1).alias(f) for f in _FLAGS],
    )
    agg = agg.join(location_stats(typed), "event", "left")
    return _finish(agg, catalogue)


STATE_SUMS = ("n", "s_reposts", "s_comments", "s_likes", "n_ts", "n_night")
USER_SKETCH = 12  # log2 of the sketch's buckets: a relative standard error of about 1.6 %


def feature_state(posts: DataFrame, default_year: int | None = None, sketch: int = USER_SKETCH) -> DataFrame:
    """A mergeable state of the statistics A1-A11 of these posts.

    (event, facet, key, n, first_pos, sums, ts_min, ts_max, flags, users): one row for all posts of an
    event, one for each hour and one for each location. ``users`` is a HyperLogLog sketch of the
    nicknames on the first; all else is exact. States of disjoint sets of posts merge.
    """
    typed = typed_posts(posts, default_year)
    measures = [F.col("reposts"), F.col("comments"), F.col("likes"), F.col("ts"), S.is_night("ts").cast("int"), F.col("nickname")]
    names = ["reposts", "comments", "likes", "ts", "night", "user"]
    nothing = [F.lit(None).cast(t) for t in ("double", "double", "double", "timestamp_ntz", "int", "string")]

    def facet(kind, key, values):
        return F.struct(F.lit(kind).alias("facet"), key.cast("string").alias("key"), *[v.alias(n) for v, n in zip(values, names)])

    rows = typed.select("event", "pos", *_FLAGS, F.inline(F.array(
        facet("all", F.lit(""), measures), facet("hour", F.when(F.col("ts").isNotNull(), F.hour("ts")), nothing),
        facet("location", F.col("location"), nothing)))).where(F.col("key").isNotNull())
    state = rows.groupBy("event", "facet", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"),
        F.sum("reposts").alias("s_reposts"), F.sum("comments").alias("s_comments"), F.sum("likes").alias("s_likes"),
        F.count("ts").alias("n_ts"), F.sum("night").alias("n_night"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"),
        *[F.max(F.col(f).cast("int")).alias(f) for f in _FLAGS], F.hll_sketch_agg("user", F.lit(sketch)).alias("users"))
    return state.withColumn("users", F.when(F.col("facet") == "all", F.col("users")))


def merge_states(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One state of the posts of several states."""
    rows = first
    for other in others:
        rows = rows.unionByName(other)
    merged = rows.groupBy("event", "facet", "key").agg(
        *[F.sum(c).alias(c) for c in STATE_SUMS], F.min("first_pos").alias("first_pos"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"),
        *[F.max(f).alias(f) for f in _FLAGS], F.hll_union_agg("users").alias("users"))
    return merged.withColumn("users", F.when(F.col("facet") == "all", F.col("users"))).select(*first.columns)


def features_of_state(state: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """The statistics of ``event_features`` from a state; ``unique_users`` and ``user_post_ratio`` are estimates."""
    is_all, is_hour, is_place = (F.col("facet") == k for k in ("all", "hour", "location"))
    hour_code = F.col("n") * 32 + (31 - F.when(is_hour, F.col("key")).cast("long"))
    agg = state.groupBy("event").agg(
        F.sum(F.when(is_all, F.col("n"))).alias("post_count"),
        *[F.sum(c).alias(c) for c in ("s_reposts", "s_comments", "s_likes", "n_night")],
        F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"), F.sum(F.when(is_all, F.col("n_ts"))).alias("n_ts"),
        (31 - F.max(hour_code) % 32).alias("peak"),
        F.max(F.when(is_all, F.hll_sketch_estimate("users"))).alias("n_users"),
        F.count(F.when(is_place, F.lit(1))).alias("n_locations"), F.max(F.when(is_place, F.col("n"))).alias("top_n"),
        F.max_by(F.when(is_place, F.col("key")), F.when(is_place, F.struct(F.col("n"), -F.col("first_pos")))).alias("top_loc"),
        *[(F.max(f) == 1).alias(f) for f in _FLAGS])
    return _finish(agg, catalogue)


def location_stats(typed: DataFrame) -> DataFrame:
    """A9-A11 inputs: number of locations, count of the most frequent one and
    its name (first seen on ties), from an (event, location) pre-aggregate."""
    per_loc = typed.groupBy("event", "location").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("fp"))
    return per_loc.groupBy("event").agg(
        F.count(F.lit(1)).alias("n_locations"),
        F.max("n").alias("top_n"),
        F.max_by("location", F.struct(F.col("n"), -F.col("fp"))).alias("top_loc"))


def _finish(agg: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    n = F.col("post_count").cast("double")
    has_time, has_counts, has_nick, has_loc = (F.col(f) for f in _FLAGS)
    timed = has_time & (F.col("n_ts") > 0)
    # zone-independent: both ends are TIMESTAMP_NTZ
    span = F.timestamp_diff("MICROSECOND", F.col("ts_min"), F.col("ts_max")) / 3.6e9
    out = agg.select(
        "event",
        F.col("post_count").cast("long").alias("post_count"),
        F.when(timed, span).otherwise(0.0).alias("timespan_hours"),
        F.when(timed, F.col("peak")).otherwise(0).cast("long").alias("peak_hour"),
        F.when(timed, F.col("n_night") / F.col("n_ts")).otherwise(0.0).alias("night_ratio"),
        F.when(has_counts, F.col("s_reposts") / n).otherwise(0.0).alias("avg_reposts"),
        F.when(has_counts, F.col("s_comments") / n).otherwise(0.0).alias("avg_comments"),
        F.when(has_counts, F.col("s_likes") / n).otherwise(0.0).alias("avg_likes"),
        F.when(has_counts, (F.col("s_reposts") + F.col("s_comments")) / (F.col("s_likes") + 1.0))
        .otherwise(0.0).alias("engagement_ratio"),
        F.when(has_nick, F.col("n_users")).otherwise(0).cast("long").alias("unique_users"),
        F.when(has_nick, F.col("n_users") / n).otherwise(0.0).alias("user_post_ratio"),
        F.when(has_loc, F.col("n_locations") / n).otherwise(0.0).alias("location_diversity"),
        F.when(has_loc, F.col("top_n") / n).otherwise(0.0).alias("top_location_ratio"),
        F.when(has_loc, F.col("top_loc")).otherwise(F.lit(S.UNKNOWN_LOCATION)).alias("top_location"),
    )
    if catalogue is None:
        return out
    zeros = {f: 0 for f in FEATURES}
    return (catalogue.select("event").distinct().join(out, "event", "left")
            .fillna(zeros).fillna({"top_location": S.UNKNOWN_LOCATION}))


def feature_vector(features: DataFrame, output_col: str = "stats") -> DataFrame:
    """The 12 features as an ML vector in reference order."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=FEATURES, outputCol=output_col).transform(
        features.select("event", *[F.col(f).cast("double") for f in FEATURES], *[c for c in features.columns if c not in FEATURES and c != "event"])
    )


def check_features(features: DataFrame) -> DataFrame:
    """Rows that break the 12-feature invariant (missing or null value).

    Empty result = valid. Schema problems raise immediately.
    """
    missing = [f for f in FEATURES if f not in features.columns]
    if missing:
        raise ValueError(f"feature columns missing: {missing}")
    bad = None
    for f in FEATURES:
        cond = F.col(f).isNull()
        bad = cond if bad is None else bad | cond
    return features.where(bad).select(
        "event", F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FEATURES])).alias("null_features"))


def hour_histogram(posts: DataFrame, default_year: int | None = None) -> DataFrame:
    """O2: per-event post count by hour of valid timestamps.

    The null-hour group is exactly the one with ``count(ts) = 0``; filtering on
    the aggregate (not on ``ts``) keeps Catalyst from pushing a predicate that
    inlines the whole parse chain below the projections (a >64 KB method)."""
    typed = typed_posts(posts, default_year)
    return (typed.groupBy("event", F.hour("ts").cast("long").alias("hour"))
            .agg(F.count("ts").alias("n")).where(F.col("n") > 0))


def location_counts(posts: DataFrame) -> DataFrame:
    """O1: descending value counts of location (missing -> 未知) per event, with rank."""
    from pyspark.sql import Window
    loc = S.location_or_unknown(S.na_to_null(F.col("location")))
    counts = posts.groupBy("event", loc.alias("location")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("pos").cast("long")).alias("first_pos"))
    w = Window.partitionBy("event").orderBy(F.desc("n"), F.asc("first_pos"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).drop("first_pos")
