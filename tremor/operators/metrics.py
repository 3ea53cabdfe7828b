"""Evaluation metrics and losses.

Metrics come from the confusion counts (one partial aggregate on
(true, pred)); everything after that works on at most C*C rows. Losses are
row expressions reduced by partial aggregates; the class-weighted smoothed
loss is rewritten over per-(y, class) sums so no per-row weight lookup is
needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_softmax

LABEL_SMOOTHING = 0.1   # reference default
FOCAL_ALPHA = 1.0       # effective reference values (Q11)
FOCAL_GAMMA = 2.0


def label_set(pred: DataFrame) -> DataFrame:
    """U3 + O3: distinct labels seen in true or pred, in ascending order (one row per class)."""
    return (pred.select(F.explode(F.array(F.col("true").cast("int"), F.col("pred").cast("int"))).alias("label"))
            .distinct().orderBy("label"))


def confusion(pred: DataFrame) -> DataFrame:
    """Counts for every (true, pred) pair of U3 labels, zeros included.

    One partial aggregate on (true, pred); the pair grid comes from the (at
    most C) labels of those counts, exploded twice, and is left-joined with them.
    """
    counts = pred.groupBy("true", "pred").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.agg(F.array_sort(F.array_union(F.collect_set("true"), F.collect_set("pred"))).alias("ls"))
    grid = (labels.select(F.explode("ls").alias("true"), "ls")
            .select("true", F.explode("ls").alias("pred")))
    return (grid.join(counts, ["true", "pred"], "left")
            .select(F.col("true").cast("int"), F.col("pred").cast("int"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def per_class(cm: DataFrame) -> DataFrame:
    """Precision / recall / F1 / support per label; 0 where a denominator is 0.

    Each confusion cell feeds its true label (tp, support) and its predicted
    label (predicted) in one pass.
    """
    n = F.col("n").cast("long")
    zero = F.lit(0).cast("long")

    def side(label, tp, support, predicted):
        return F.struct(label.cast("int").alias("label"), tp.alias("tp"), support.alias("support"),
                        predicted.alias("predicted"))
    sides = cm.select(F.inline(F.array(
        side(F.col("true"), F.when(F.col("true") == F.col("pred"), n).otherwise(zero), n, zero),
        side(F.col("pred"), zero, zero, n))))
    t = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                   F.sum("predicted").alias("predicted"))

    def div(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    t = t.select("label", "tp", "support", "predicted", div(F.col("tp"), F.col("predicted")).alias("precision"),
                 div(F.col("tp"), F.col("support")).alias("recall"))
    return t.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_metrics(pred: DataFrame) -> DataFrame:
    """E1 + E3: accuracy and macro precision / recall / F1 over U3 labels."""
    pc = per_class(confusion(pred))
    return pc.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                  F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                  F.avg("f1").alias("macro_f1"))


def weighted_metrics(pred: DataFrame) -> DataFrame:
    """Support-weighted precision / recall / F1."""
    pc = per_class(confusion(pred))
    s = F.sum("support")
    return pc.agg((F.sum(F.col("precision") * F.col("support")) / s).alias("weighted_precision"),
                  (F.sum(F.col("recall") * F.col("support")) / s).alias("weighted_recall"),
                  (F.sum(F.col("f1") * F.col("support")) / s).alias("weighted_f1"))


def predictions_table(df: DataFrame, logits: str = "logits", y: str = "y") -> DataFrame:
    """Keyed (event, true, pred) rows."""
    from ..functions.scalars import argmax
    return df.select("event", F.col(y).cast("int").alias("true"), argmax(logits).alias("pred"))


def _nll_rows(df: DataFrame, logits: str, y: str) -> DataFrame:
    lp = log_softmax(logits)
    return df.select("*", lp.alias("_lp"), (-F.element_at(lp, F.col(y).cast("int") + 1)).alias("_nll"))


def cross_entropy(df: DataFrame, logits: str = "logits", y: str = "y") -> DataFrame:
    """E5: mean -log softmax(z)[y]."""
    return _nll_rows(df, logits, y).agg(F.avg("_nll").alias("loss"))


def smoothed_cross_entropy(df: DataFrame, eps: float = LABEL_SMOOTHING, logits: str = "logits",
                           y: str = "y") -> DataFrame:
    """(1-eps)*nll + eps/C * sum_c(-log p_c), mean over rows."""
    r = _nll_rows(df, logits, y)
    smooth = -F.aggregate("_lp", F.lit(0.0), lambda acc, x: acc + x) / F.size("_lp")
    return r.agg(F.avg((1.0 - eps) * F.col("_nll") + eps * smooth).alias("loss"))


def weighted_smoothed_cross_entropy(df: DataFrame, eps: float = LABEL_SMOOTHING, counts: list[int] | None = None,
                                    logits: str = "logits", y: str = "y") -> DataFrame:
    """Class-weighted CE with label smoothing, weights from class counts.

    loss = [(1-eps) * sum_c w_c S_c + eps/C * sum_c w_c L_c] / sum_c w_c n_c with
    T[y,c] = sum over rows of class y of -log p_c, S_c = T[c,c], L_c = sum_y T[y,c].
    Only the C*C table T is combined with the weights.
    """
    r = _nll_rows(df, logits, y)
    t = (r.select(F.col(y).cast("int").alias("y"), F.posexplode("_lp").alias("c", "lp"))
         .groupBy("y", "c").agg(F.sum(-F.col("lp")).alias("t"), F.count(F.lit(1)).alias("n")))
    one = Window.partitionBy(F.lit(0))  # over <= C*C rows
    if counts is None:
        n_c = t.where(F.col("y") == F.col("c")).select(F.col("c"), F.col("n").cast("double").alias("nc"))
    else:
        n_c = df.sparkSession.createDataFrame([(i, float(n)) for i, n in enumerate(counts)], "c int, nc double")
    w = n_c.select("c", (1.0 / F.col("nc")).alias("inv")).select(
        "c", (F.col("inv") / F.sum("inv").over(one) * F.count(F.lit(1)).over(one)).alias("w"))
    parts = t.join(w, "c").agg(
        F.sum(F.when(F.col("y") == F.col("c"), F.col("w") * F.col("t"))).alias("ws"),
        F.sum(F.col("w") * F.col("t")).alias("wl"),
        F.sum(F.when(F.col("y") == F.col("c"), F.col("w") * F.col("n"))).alias("wn"),
        F.count_distinct("c").alias("C"))
    return parts.select((((1.0 - eps) * F.col("ws") + eps / F.col("C") * F.col("wl")) / F.col("wn")).alias("loss"))


def focal_rows(df: DataFrame, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA,
               logits: str = "logits", y: str = "y") -> DataFrame:
    """E8 with reduction='none': alpha * (1 - pt)^gamma * ce per row."""
    r = _nll_rows(df, logits, y)
    pt = F.exp(-F.col("_nll"))
    return r.select(*df.columns, (F.lit(alpha) * F.pow(1.0 - pt, gamma) * F.col("_nll")).alias("loss"))


def focal_loss(df: DataFrame, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA, reduction: str = "mean",
               logits: str = "logits", y: str = "y") -> DataFrame:
    """Reduction mean / sum / none."""
    rows = focal_rows(df, alpha, gamma, logits, y)
    if reduction == "none":
        return rows
    if reduction == "sum":
        return rows.agg(F.sum("loss").alias("loss"))
    if reduction == "mean":
        return rows.agg(F.avg("loss").alias("loss"))
    raise ValueError(f"unknown reduction: {reduction}")


def batched_loss(df: DataFrame, batch: str = "batch", logits: str = "logits", y: str = "y") -> DataFrame:
    """Epoch loss = mean of per-batch mean CE; also the plain row mean."""
    r = _nll_rows(df, logits, y)
    per_batch = r.groupBy(batch).agg(F.avg("_nll").alias("b"), F.sum("_nll").alias("s"), F.count(F.lit(1)).alias("n"))
    return per_batch.agg(F.avg("b").alias("loss"), (F.sum("s") / F.sum("n")).alias("row_mean_loss"),
                         F.count(F.lit(1)).alias("n_batches"))
