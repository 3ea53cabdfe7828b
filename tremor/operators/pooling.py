"""Pooling post vectors into event vectors.

Input: posts(event, pos, vec ARRAY<DOUBLE>, valid BOOLEAN[, score DOUBLE]).
Arrays are summed element-wise by an ML ``Summarizer`` (one vector buffer per
event and map partition, partial aggregation before the shuffle); softmax sums
go by (event, salt) first. So a hot event never lands as raw rows on one task.

``vec`` may also be a sparse struct (``sparse.SPARSE``) or a Spark ML vector: mean,
max, cls and attentive pooling then add up (event, index, value) rows with partial
aggregation and give the same arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sparse as SP

# --- fixed values that must equal the reference --------------------------------
EPS = 1e-10          # mean-pool denominator guard
MASK_SCORE = -1e9    # score given to invalid posts before the softmax
# -------------------------------------------------------------------------------
SALTS = 64           # parts of an event in the softmax sums
SCORED_ROWS = 256    # posts multiplied with the score network's weights at once


def _vsum(vec_col: F.Column, weight: F.Column | None = None) -> F.Column:
    v = array_to_vector(vec_col)
    metric = Summarizer.metrics("sum")
    out = metric.summary(v, weight) if weight is not None else metric.summary(v)
    return vector_to_array(out.getField("sum"))


def _dim(vec: str) -> F.Column:
    return F.max(F.size(vec))


def _zeros(dim: F.Column) -> F.Column:
    return F.array_repeat(F.lit(0.0), dim.cast("int"))


def mean_pool(posts: DataFrame, vec: str = "vec", valid: str = "valid") -> DataFrame:
    """V1: sum over valid posts / (n_valid + 1e-10); zero vector when none."""
    if SP.is_sparse(posts, vec):
        posts = SP.as_struct(posts, vec)
        events = SP.pooled_entries(posts, vec, valid, F.sum("v").alias("s"))
        mean = F.transform("entries", lambda e: F.struct(e["i"].alias("i"), (e["s"] / (F.col("n_valid") + EPS)).alias("v")))
        return events.withColumn("entries", mean).select("event", SP.whole(F.col("entries"), F.col("dim")).alias("vec"), "n_valid")
    ok = F.col(valid)
    zero = F.array_repeat(F.lit(0.0), F.size(vec))
    agg = posts.groupBy("event").agg(
        _vsum(F.when(ok, F.col(vec)).otherwise(zero)).alias("s"),
        F.count(F.when(ok, F.lit(1))).alias("n_valid"),
        _dim(vec).alias("dim"),
    )
    pooled = F.transform(F.col("s"), lambda x: x / (F.col("n_valid") + EPS))
    return agg.select("event", F.when(F.col("n_valid") > 0, pooled).otherwise(_zeros(F.col("dim"))).alias("vec"),
                      "n_valid")


def max_pool(posts: DataFrame, vec: str = "vec", valid: str = "valid", compat_inf: bool = False) -> DataFrame:
    """V2: element-wise max over valid posts. No valid post -> null vector
    (``compat_inf=True`` gives the reference's -inf vector)."""
    if SP.is_sparse(posts, vec):
        posts = SP.as_struct(posts, vec)
        events = SP.pooled_entries(posts, vec, valid, F.max("v").alias("m"), F.count(F.lit(1)).alias("c"))
        # a post that does not store an index has a zero there
        tops = F.transform("entries", lambda e: F.struct(
            e["i"].alias("i"), F.when(e["c"] < F.col("n_valid"), F.greatest(e["m"], F.lit(0.0))).otherwise(e["m"]).alias("v")))
        none = F.array_repeat(F.lit(float("-inf")), F.col("dim")) if compat_inf else F.lit(None).cast("array<double>")
        filled = SP.whole(F.col("entries"), F.col("dim"))
        return events.withColumn("entries", tops).select("event", F.when(F.col("n_valid") > 0, filled).otherwise(none).alias("vec"), "n_valid")
    ok = F.col(valid)
    floor = F.array_repeat(F.lit(float("-inf")), F.size(vec))
    agg = posts.groupBy("event").agg(
        vector_to_array(Summarizer.max(array_to_vector(F.when(ok, F.col(vec)).otherwise(floor)))).alias("m"),
        F.count(F.when(ok, F.lit(1))).alias("n_valid"),
        _dim(vec).alias("dim"),
    )
    empty = (F.array_repeat(F.lit(float("-inf")), F.col("dim").cast("int")) if compat_inf
             else F.lit(None).cast("array<double>"))
    return agg.select("event", F.when(F.col("n_valid") > 0, F.col("m")).otherwise(empty).alias("vec"), "n_valid")


def cls_pool(posts: DataFrame, vec: str = "vec") -> DataFrame:
    """V3: the vector at the first position, valid or not.

    The first position per event is a fixed-width hash aggregate; the vector is
    fetched with a semi-join on (event, pos), never sorting the posts.
    """
    first = posts.groupBy("event").agg(F.min("pos").alias("pos"))
    found = posts.join(first, ["event", "pos"], "left_semi")
    if SP.is_sparse(posts, vec):
        return SP.as_struct(found, vec).select("event", SP.dense(vec).alias("vec"))
    return found.select("event", F.col(vec).alias("vec"))


def _salted(posts: DataFrame) -> DataFrame:
    return posts.withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(SALTS)).cast("int"))


def _softmax_parts(posts: DataFrame, score: F.Column, vec: str | None) -> DataFrame:
    """(event, _salt, _m, _z, _n[, _s]) for each salt of an event: the largest score, the sum of
    ``exp(score - _m)``, the number of posts and the sum of their vectors weighted alike.

    Posts meet their part's maximum on (event, salt), so no event's posts come together in one task.
    """
    rows = _salted(posts.withColumn("_score", score)).select("event", "_salt", "_score", *([F.col(vec).alias("_v")] if vec else []))
    top = rows.groupBy("event", "_salt").agg(F.max("_score").alias("_m"))
    weighted = rows.join(top, ["event", "_salt"]).withColumn("_w", F.exp(F.col("_score") - F.col("_m")))
    sums = [F.first("_m").alias("_m"), F.sum("_w").alias("_z"), F.count(F.lit(1)).alias("_n")]
    return weighted.groupBy("event", "_salt").agg(*sums, *([_vsum(F.col("_v"), F.col("_w")).alias("_s")] if vec else []))


def _masked(score: str, valid: str) -> F.Column:
    return F.when(F.col(valid), F.col(score)).otherwise(F.lit(MASK_SCORE))


def _merged_parts(parts: DataFrame, floor: F.Column | None = None) -> DataFrame:
    """Parts (at most SALTS rows per event) with the event's maximum ``_top`` and their factor ``_f``."""
    w = Window.partitionBy("event")
    top = F.max("_m").over(w) if floor is None else F.greatest(F.max("_m").over(w), floor)
    return parts.withColumn("_all", F.sum("_n").over(w)).withColumn("_top", top).withColumn("_f", F.exp(F.col("_m") - F.col("_top")))


def attentive_pool(posts: DataFrame, vec: str = "vec", valid: str = "valid", score: str = "score") -> DataFrame:
    """V4: masked softmax over posts (invalid -> -1e9), weighted sum of vectors.

    Softmax sums of each (event, salt) are brought to the event's maximum by
    ``exp(part maximum - maximum)`` and added up.
    """
    if SP.is_sparse(posts, vec):
        posts = SP.as_struct(posts, vec)
        values = SP.entries_of(_weighted(posts, _masked(score, valid), vec), vec, "event", "alpha")
        sums = values.groupBy("event", "i").agg(F.sum(F.col("alpha") * F.col("v")).alias("v"))
        return SP.event_vectors(sums, SP.sizes_of(posts, vec, valid)).select("event", "vec")
    parts = _merged_parts(_softmax_parts(posts, _masked(score, valid), vec))
    agg = parts.groupBy("event").agg(_vsum(F.col("_s"), F.col("_f")).alias("s"), F.sum(F.col("_z") * F.col("_f")).alias("z"))
    return agg.select("event", F.transform("s", lambda x: x / F.col("z")).alias("vec"))


def attention_weights(posts: DataFrame, valid: str = "valid", score: str = "score") -> DataFrame:
    """V4's second output: alpha per post. The event's maximum and sum are repeated for
    each salt, so the posts are joined on (event, salt)."""
    return _weighted(posts, _masked(score, valid)).select("event", "pos", "alpha")


def _weighted(posts: DataFrame, masked: F.Column, *keep: str) -> DataFrame:
    """(event, pos, kept columns, alpha): the softmax weight of every post."""
    parts = _merged_parts(_softmax_parts(posts, masked, None))
    total = parts.groupBy("event").agg(F.max("_top").alias("_top"), F.sum(F.col("_z") * F.col("_f")).alias("_z"))
    spread = total.select("event", "_top", "_z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = _salted(posts).select("event", "_salt", "pos", masked.alias("_score"), *keep)
    return rows.join(spread, ["event", "_salt"]).select("event", "pos", *keep, (F.exp(F.col("_score") - F.col("_top")) / F.col("_z")).alias("alpha"))


def attention_score(posts: DataFrame, weights: DataFrame, vec: str = "vec", out: str = "score", max_bytes: int = 64 << 20) -> DataFrame:
    """V4's score network: ``sum over units of v * tanh(w . x + b)`` for every post, in ``out``.

    ``weights(unit, w ARRAY<DOUBLE>, b DOUBLE, v DOUBLE)`` has a row for each hidden unit. They are
    sent to the tasks in blocks of at most ``max_bytes``; one block after the other adds its units' part,
    so a network of any size is scored. Posts may be arrays, sparse structs or ML vectors; a null
    vector has a null score.
    """
    known = SP.is_sparse(posts, vec)
    posts = SP.as_struct(posts, vec) if known else posts
    width = weights.agg(F.max(F.size("w"))).first()[0]
    if width is None:
        return posts.withColumn(out, F.when(F.col(vec).isNotNull(), F.lit(0.0)))
    per_block = max(1, max_bytes // (8 * (width + 2)))
    ordered = weights.orderBy("unit").select("w", "b", "v").toLocalIterator()
    scored = posts.withColumn(out, F.when(F.col(vec).isNotNull(), F.lit(0.0)))
    while block := list(islice(ordered, per_block)):
        matrix, bias, factor = (np.array([r[n] for r in block], float) for n in range(3))
        scored = _add_units(scored, vec, out, posts.sparkSession.sparkContext.broadcast((matrix, bias, factor)), known)
    return scored


def _add_units(posts: DataFrame, vec: str, out: str, shared, known: bool) -> DataFrame:
    at, to = posts.columns.index(vec), posts.columns.index(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, bias, factor = shared.value
        for batch in batches:
            total = batch.column(to).to_numpy(zero_copy_only=False).astype(float)
            filled = np.flatnonzero(np.asarray(batch.column(at).is_valid()))
            for n in range(0, len(filled), SCORED_ROWS):
                rows = filled[n:n + SCORED_ROWS]
                column = batch.column(at).take(pa.array(rows))
                if known:
                    x = np.zeros((len(rows), matrix.shape[1]))
                    lists = column.field("indices")
                    x[np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = column.field("values").flatten().to_numpy()
                else:
                    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
                total[rows] += np.tanh(x @ matrix.T + bias) @ factor
            columns = list(batch.columns)
            columns[to] = pa.array(total, pa.float64(), mask=np.isnan(total) & ~np.isin(np.arange(len(total)), filled))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return posts.mapInArrow(run, posts.schema)


def attentive_pool_unmasked(posts: DataFrame, n_slots: int, pad_score: float = 0.0,
                            vec: str = "vec", score: str = "score") -> DataFrame:
    """V5: softmax over all ``n_slots`` slots, the (n_slots - n_posts) padding
    slots being zero vectors with a constant score. Closed form, no padding rows."""
    parts = _softmax_parts(posts, F.col(score), vec)
    fewer = F.sum("_n").over(Window.partitionBy("event")) < n_slots
    parts = _merged_parts(parts, F.when(fewer, F.lit(float(pad_score))))  # greatest() skips null
    agg = parts.groupBy("event").agg(_vsum(F.col("_s"), F.col("_f")).alias("s"), F.sum(F.col("_z") * F.col("_f")).alias("z"),
                                     F.max("_all").alias("n"), F.max("_top").alias("m"))
    pad = F.greatest(F.lit(n_slots) - F.col("n"), F.lit(0)) * F.exp(F.lit(pad_score) - F.col("m"))
    return agg.select("event", F.transform("s", lambda x: x / (F.col("z") + pad)).alias("vec"))


def compact_slots(posts: DataFrame, n_slots: int, vec: str = "vec", valid: str = "valid") -> DataFrame:
    """V6: valid vectors first in ``pos`` order, then zero padding up to ``n_slots``.

    Returns the list view (event, vecs ARRAY<ARRAY<DOUBLE>>, n_valid); call it on
    capped posts so a list holds at most ``n_slots`` vectors.
    """
    from .windows import first_n
    ok = first_n(posts.where(F.col(valid)), n_slots)  # partial group limit; hot events in two stages
    lists = ok.groupBy("event").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(vec).alias("v")))).alias("l"),
        _dim(vec).alias("dim"))
    vecs = F.transform(F.slice("l", 1, n_slots), lambda e: e["v"])
    pad = F.array_repeat(_zeros(F.col("dim")), F.greatest(F.lit(n_slots) - F.size("l"), F.lit(0)))
    return lists.select("event", F.concat(vecs, pad).alias("vecs"), F.least(F.size("l"), F.lit(n_slots)).alias("n_valid"))


def concat_vectors(left: DataFrame, right: DataFrame, left_col: str = "vec", right_col: str = "vec",
                   out: str = "vec") -> DataFrame:
    """V7: event vector ⊕ another per-event vector (e.g. the 12 statistics)."""
    r = right.select("event", F.col(right_col).cast("array<double>").alias("_r"))
    return left.join(r, "event").select("event", F.concat(F.col(left_col).cast("array<double>"), F.col("_r")).alias(out))


def stats_array(features: DataFrame, cols: list[str]) -> DataFrame:
    """Per-event statistics as one DOUBLE array in the given order."""
    return features.select("event", F.array(*[F.col(c).cast("double") for c in cols]).alias("vec"))


def attach_topic_vector(posts: DataFrame, topic: DataFrame, vec: str = "vec") -> DataFrame:
    """Every post vector ⊕ its event's topic vector."""
    t = topic.select("event", F.col("vec").alias("_t"))
    return posts.join(t, "event").withColumn(vec, F.concat(F.col(vec), F.col("_t"))).drop("_t")


def long_form(df: DataFrame, vec: str = "vec", keys: tuple[str, ...] = ("event",)) -> DataFrame:
    """(keys..., i, v) rows of a vector column, for inspection and comparison."""
    return df.select(*keys, F.posexplode(vec).alias("i", "v")).withColumn("i", F.col("i").cast("int"))
